"""BPE encoding and decoding.

Encoding is a backtracking search: an Aho-Corasick automaton finds the longest vocabulary token at
each position of a pre-token; a token may follow another only if the pair is compatible, that is, if
merging the bytes of the two by rank gives just these two tokens. The first path of compatible
tokens that reaches the end is the exact result of the merges, and no position is entered twice.
Decoding gathers token bytes through an offset table.

Null texts count as empty and give no ids. Repeated rows are encoded each on its own; texts of any
length are encoded whole. Other columns of the input are not looked at, so their names cannot clash. A
table without rows gives none.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterable
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from stackwright.llm.common import groups_of, list_array, texts_of, tidy
from stackwright.llm.pieces import Ids, PieceEncoder

#: The public pre-tokenizer pattern of byte-level BPE (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Texts are worked on in groups of about so many characters, and decoded in groups of so many ids.
GROUP_CHARS, GROUP_IDS = 500_000, 250_000
#: Slots of the memo of pieces (see pieces.Memo).
MEMO_SLOTS = 1 << 21
#: Entries of the pair-compatibility table that a worker keeps.
PAIRS = 100_000
#: Words beside marks or digits that are remembered: their number and their longest length.
SHORT_WORDS, SHORT = 25_000, 24


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes stand for
    themselves, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class BpeTable:
    """Vocabulary, merge ranks, automaton and the pair-compatibility table of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab: dict[str, int] = spec["model"]["vocab"]
        size = 1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])])
        self.data: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.data[i] = bytes(letters[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranked = {i: r for r, i in enumerate(sorted(vocab[c] for c in letters if c in vocab))}
        n_base = len(ranked)
        self.rank: list[int] = [-1] * size
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for i, r in ranked.items():
            self.rank[i] = r
        for r, merge in enumerate(spec["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.merged.setdefault((left, right), whole)
            if self.rank[whole] < 0:
                self.rank[whole], self.halves[whole] = n_base + r, (left, right)
        ids = {self.data[i]: i for i in vocab.values() if self.rank[i] >= 0}
        self.lengths = [len(x) for x in self.data]
        self.shorter: list[int] = [-1] * size
        self.automaton = ahocorasick.Automaton()
        for data, i in ids.items():
            self.automaton.add_word(data.decode("latin-1"), i)
            for n in range(len(data) - 1, 0, -1):
                if data[:n] in ids:
                    self.shorter[i] = ids[data[:n]]
                    break
        self.automaton.make_automaton()
        self.one_token = {data: i for data, i in ids.items()}
        self.size = size
        self.pairs: dict[int, bool] = {}
        self.short: dict[str, list[int]] = {}
        self.words = regex.compile(PATTERN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        for content, i in self.special.items():
            self.data[i] = content.encode()
        self.offsets = np.zeros(size + 1, np.int64)
        np.cumsum([len(x) for x in self.data], out=self.offsets[1:])
        self.bytes = np.frombuffer(b"".join(self.data), np.uint8)

    def compatible(self, left: int, right: int) -> bool:
        """The pair's entry in the table, made when it is first asked for."""
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        known = self.pairs[left * self.size + right] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        """Undo merges beside the border, latest first, and see whether the two parts that then touch
        would have merged with each other before the merge that was undone. Of equal ranks the merge
        further left comes first, so the right part's own merge must be strictly later to be beaten."""
        rank, halves, merged = self.rank, self.halves, self.merged
        before = 1 << 60
        while True:
            both = merged.get((left, right))
            if both is not None and rank[both] < before:
                return False
            if rank[left] > rank[right]:
                if left not in halves:  # two single bytes
                    return True
                before, left = rank[left], halves[left][1]
            else:
                if right not in halves:
                    return True
                before, right = rank[right] + 1, halves[right][0]

    def encode_word(self, data: bytes) -> list[int]:
        """The ids of one pre-token."""
        whole = self.one_token.get(data)
        if whole is not None and self._reachable(whole):
            return [whole]
        n, lengths, shorter, known, size = len(data), self.lengths, self.shorter, self.pairs.get, self.size
        longest = [-1] * n
        for end, i in self.automaton.iter(data.decode("latin-1")):
            longest[end + 1 - lengths[i]] = i  # later ends are longer
        out: list[int] = []
        dead = bytearray(n + 1)
        at, token, last = 0, longest[0], -1
        while at < n:
            end = at + lengths[token]
            fits = not dead[end]
            if fits and last >= 0:
                fits = known(last * size + token)
                if fits is None:
                    fits = self.compatible(last, token)
            if fits:
                out.append(token)
                at, last = end, token
                if at < n:
                    token = longest[at]
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                dead[at] = 1
                token = out.pop()
                last = out[-1] if out else -1
                at -= lengths[token]
        return out

    @lru_cache(maxsize=None)  # noqa: B019  one table lives as long as its worker
    def _reachable(self, token: int) -> bool:
        """True if merging a token's own bytes ends in the token."""
        if token not in self.halves:
            return True
        left, right = self.halves[token]
        return self._reachable(left) and self._reachable(right) and self._compatible_until(left, right, self.rank[token])

    def _compatible_until(self, left: int, right: int, rank: int) -> bool:
        """No merge over the border comes before the one of this rank."""
        blocked = self.merged.pop((left, right))
        try:
            return self._compatible(left, right)
        finally:
            self.merged[left, right] = blocked

    def encode_piece(self, text: str) -> list[int]:
        ids: list[int] = []
        for part in self.cut.split(text) if self.cut and any(s in text for s in self.special) else (text,):
            special = self.special.get(part)
            if special is not None:
                ids.append(special)
            elif part[1:].isalpha() and (part[0] == " " or part[0].isalpha()):  # one run of letters
                ids += self.encode_word(part.encode("utf-8"))
            else:
                for word in self.words.findall(part):
                    found = self.short.get(word)
                    if found is None:
                        found = self.encode_word(word.encode("utf-8", "surrogatepass"))
                        if len(word) <= SHORT:
                            if len(self.short) > SHORT_WORDS:
                                self.short.clear()
                            self.short[word] = found
                    ids += found
        return ids

    def encode_many(self, texts: Iterable[str]) -> Ids:
        """The ids of texts in one array, and how many each has."""
        ids, counts = array("I"), []
        for t in texts:
            found = self.encode_piece(t)
            ids.extend(found)
            counts.append(len(found))
        return np.array(ids, np.uint32), np.array(counts, np.int64)

    def decode_flat(self, ids: np.ndarray) -> bytes:
        """The bytes of all ids, through the offset table."""
        starts = self.offsets[ids]
        lengths = self.offsets[ids.astype(np.int64) + 1] - starts
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)
        return self.bytes[at].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """Broken UTF-8 reads as U+FFFD, as libraries decode."""
        return b"".join(self.decode_flat(ids[i : i + GROUP_IDS]) for i in range(0, len(ids), GROUP_IDS)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> BpeTable:
    return BpeTable(path)


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    table = load(path)
    return PieceEncoder(lambda pieces: table.encode_many(" " + p for p in pieces), table.encode_many, table.data, MEMO_SLOTS)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each text and decode its ids: (doc_id, n_tokens long, ids array<int>, decoded string).

    One narrow Arrow pass, no shuffle. A task keeps the tables and a bounded memo of pieces.
    """

    def work(batches):
        table, pieces = load(path), encoder(path)
        for batch in batches:
            doc_ids = batch.column(id_col)
            for a, b in groups_of(pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_pylist(), GROUP_CHARS):
                ids, counts = pieces.encode(texts_of(batch.slice(a, b - a)))
                stops = np.cumsum(counts)
                decoded = [table.decode(ids[e - n : e]) for n, e in zip(counts, stops, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.slice(a, b - a), pa.array(counts), list_array(ids.astype(np.int32), counts, pa.int32()), pa.array(decoded, pa.string())],
                    names=[id_col, "n_tokens", "ids", "decoded"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, docs[text_col].alias("text")).mapInArrow(tidy(work), f"{id_col} {kind}, n_tokens long, ids array<int>, decoded string")
