"""SentencePiece encoding and decoding of BPE models with byte fallback, by vectorised merge rounds.

All distinct words of a group of texts lie one after the other in flat symbol arrays. Each round takes the
smallest pair rank of every word at once, merges that pair wherever it stands, leftmost first where pairs
overlap, closes the gaps and drops the words in which no pair is left, until there is none. Where a merge
could make a pair that comes before the next equal one, only the word's leftmost pair is merged in a
round, as merging one pair at a time would do. A text is cut into words between characters that stand
beside each other in no piece: no merge can cross such a place. Characters that no piece holds become
the byte pieces of their UTF-8. Decoding gathers piece bytes through an offset table.

Null texts count as empty: they give the begin and end ids alone. Repeated rows are encoded each on its own;
texts of any length are encoded whole, in slices that end where words do. Other columns of the input are not
looked at, so their names cannot clash. A table without rows gives none. The model must be of the
kind named, with the identity normaliser; others are refused.
"""

from __future__ import annotations

import codecs
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from stackwright.llm.common import groups_of, list_array, texts_of
from stackwright.llm.hashing import ragged

#: What stands for a space in pieces (fixed value).
SPACE = "▁"
#: Texts are worked on in groups of about so many characters; longer ones in slices of such a length.
GROUP_CHARS = 2_000_000
#: Words that a worker remembers: their number and their longest length.
MEMO_WORDS, MEMO_CHARS = 300_000, 48
#: Rank of a pair that no piece holds.
NEVER = np.int32(2**31 - 1)
WORDS = regex.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")

codecs.register_error("stackwright-each-byte", lambda e: ("�", e.start + 1))


class PieceTable:
    """Pieces, pair ranks and places to cut of one model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.vocab_size())
        self.begin, self.end = model.bos_id(), model.eos_id()
        byte_ids = [i for i in ids if model.is_byte(i)]
        normal = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        if len(byte_ids) != 256 or any(model.is_unused(i) for i in ids) or model.normalize("AÅﬁ ① ") != f"{SPACE}AÅﬁ{SPACE}①{SPACE}":
            raise ValueError(f"{path}: only BPE models with byte fallback and the identity normaliser are known")
        pieces = {model.id_to_piece(i): i for i in normal}
        self.byte_ids = np.zeros(256, np.uint32)
        for i in byte_ids:
            self.byte_ids[int(model.id_to_piece(i)[3:-1], 16)] = i
        # symbols: all pieces, then the characters that are parts of pieces without being any
        parts = sorted({c for p in pieces for c in p} - set(pieces))
        symbols = pieces | {c: len(ids) + k for k, c in enumerate(parts)}
        self.size = len(ids) + len(parts)
        self.letters = dict(sorted((ord(s), i) for s, i in symbols.items() if len(s) == 1))
        self._letter_codes = np.array([*self.letters], np.int32)
        self._letter_ids = np.array([*self.letters.values()], np.int32)
        scores = sorted({model.get_score(i) for i in normal}, reverse=True)
        rank_of = {s: r for r, s in enumerate(scores)}
        rank = {p: rank_of[model.get_score(i)] for p, i in pieces.items()}
        pairs = [(symbols[p[:k]] * self.size + symbols[p[k:]], rank[p], i, p, k) for p, i in pieces.items() for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols]
        pairs.sort()
        self.pair_keys = np.array([x[0] for x in pairs], np.int64)
        self.pair_ranks = np.array([x[1] for x in pairs], np.int32)
        self.pair_ids = np.array([x[2] for x in pairs], np.int32)
        # ranks after whose merge a pair may stand that comes first or at the same time
        self.one_by_one = np.zeros(len(scores), bool)
        for _, r, _, p, k in pairs:
            for part in (p[:k], p[k:]):
                if rank.get(part, -1) >= r:
                    self.one_by_one[rank[part]] = True
        self.inner = {p[k : k + 2] for p in pieces for k in range(len(p) - 1)}
        self._inner_keys = np.array(sorted((ord(a) << 21) + ord(b) for a, b in self.inner), np.int64)
        shown = [b"" if model.is_control(i) else bytes([int(model.id_to_piece(i)[3:-1], 16)]) if model.is_byte(i) else " ⁇ ".encode() if model.is_unknown(i) else model.id_to_piece(i).replace(SPACE, " ").encode() for i in ids]
        self.offsets = np.zeros(len(shown) + 1, np.int64)
        np.cumsum([len(x) for x in shown], out=self.offsets[1:])
        self.bytes = np.frombuffer(b"".join(shown), np.uint8)
        self.hidden = np.array([model.is_control(i) for i in ids])
        self.spaced = np.array([model.id_to_piece(i).startswith(SPACE) for i in ids])
        self.memo: dict[str, bytes] = {}

    def pairs_of(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged symbol) of pairs of symbols; NEVER where they don't merge. -1 is no symbol."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        held = (self.pair_keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(held, self.pair_ranks[at], NEVER), np.where(held, self.pair_ids[at], -1)

    def merge(self, codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rounds over characters that lie one after the other, in words that begin at `starts`: (symbols, the
        place of the first character of each); -1 is a character that no piece holds."""
        at = np.minimum(np.searchsorted(self._letter_codes, codes), len(self._letter_codes) - 1)
        result = np.where(self._letter_codes[at] == codes, self._letter_ids[at], np.int32(-1))  # by place; -2 once merged away
        key = (codes[:-1].astype(np.int64) << 21) + codes[1:]
        found = np.minimum(np.searchsorted(self._inner_keys, key), len(self._inner_keys) - 1)
        joined = self._inner_keys[found] == key
        joined[starts[starts > 0] - 1] = False
        word = np.concatenate([[0], np.cumsum(~joined)]) if len(codes) else np.zeros(0, np.int64)
        place, symbol = np.arange(len(codes)), result.copy()
        # the pair of a symbol and the next one stands at the first of the two
        rank, merged = np.full(len(codes), NEVER), np.full(len(codes), -1, np.int32)
        if len(codes) > 1:
            rank[:-1], merged[:-1] = self.pairs_of(symbol[:-1], symbol[1:])
            rank[:-1][~joined] = NEVER
        while len(word):
            heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            sizes = np.diff(np.append(heads, len(word)))
            least = np.minimum.reduceat(rank, heads)
            alive = least < NEVER
            if not alive.all():  # words that are done leave
                keep = np.repeat(alive, sizes)
                result[place[~keep]] = symbol[~keep]
                word, place, symbol, rank, merged = word[keep], place[keep], symbol[keep], rank[keep], merged[keep]
                heads, sizes, least = np.cumsum(sizes[alive]) - sizes[alive], sizes[alive], least[alive]
                if not len(word):
                    break
            hits = np.flatnonzero(rank == np.repeat(least, sizes))
            fresh = np.concatenate([[True], word[hits[1:]] != word[hits[:-1]]])
            # of pairs that overlap every other one is merged, from the left
            start = fresh | np.concatenate([[True], np.diff(hits) > 1])
            odd = (np.arange(len(hits)) - np.maximum.accumulate(np.where(start, np.arange(len(hits)), 0))) % 2
            taken = hits[(odd == 0) & (fresh | ~self.one_by_one[rank[hits]])]
            symbol[taken] = merged[taken]
            gone = np.zeros(len(word), bool)
            gone[taken + 1] = True
            result[place[gone]] = -2
            stay = ~gone
            touched = (np.cumsum(stay) - 1)[taken]
            word, place, symbol, rank, merged = word[stay], place[stay], symbol[stay], rank[stay], merged[stay]
            # pairs beside what was merged are looked up anew
            beside = np.zeros(len(word), bool)
            beside[touched] = beside[touched[touched > 0] - 1] = True
            ask = np.flatnonzero(beside)
            rank[ask], merged[ask] = NEVER, -1
            ask = ask[ask + 1 < len(word)]
            ask = ask[word[ask] == word[ask + 1]]
            rank[ask], merged[ask] = self.pairs_of(symbol[ask], symbol[ask + 1])
        kept = np.flatnonzero(result != -2)
        return result[kept], kept

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words that begin and end at places to cut, one after the other, and how many each has."""
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.int32)
        lengths = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(lengths)
        symbols, at = self.merge(codes, ends - lengths)
        owner = np.searchsorted(ends, at, "right")
        odd = np.flatnonzero((symbols < 0) | (symbols >= len(self.offsets) - 1))
        if not len(odd):
            return symbols.astype(np.uint32), np.bincount(owner, minlength=len(words))
        spelt = [chr(c).encode("utf-8", "surrogatepass") for c in codes[at[odd]].tolist()]
        counts = np.ones(len(symbols), np.int64)
        counts[odd] = [len(s) for s in spelt]
        out = np.repeat(symbols, counts).astype(np.uint32)
        out[ragged((np.cumsum(counts) - counts)[odd], counts[odd])] = self.byte_ids[np.frombuffer(b"".join(spelt), np.uint8)]
        return out, np.bincount(owner, counts, len(words)).astype(np.int64)

    def slices(self, text: str, size: int = GROUP_CHARS):
        """Parts of about `size` characters of a long text that end at places to cut."""
        start = 0
        while start < len(text):
            stop = min(start + size, len(text))
            while stop < len(text) and text[stop - 1 : stop + 1] in self.inner:
                stop += 1
            yield text[start:stop]
            start = stop

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, with begin and end ids, and how many each text has."""
        words: list[str] = []
        cuts = [0]
        ids, counts = [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if len(text) > GROUP_CHARS:
                # a long text stands alone in its group
                parts = [self._known(WORDS.findall(s)) for s in self.slices(SPACE + text.replace(" ", SPACE))]
                return np.concatenate([[self.begin], *[flat[ragged((np.cumsum(n) - n)[code], n[code])] for flat, n, code in parts], [self.end]]).astype(np.uint32), np.array([2 + sum(int(n[code].sum()) for _, n, code in parts)])
            if text:
                words += WORDS.findall(SPACE + text.replace(" ", SPACE))
            cuts.append(len(words))
        flat, n, code = self._known(words)
        # the begin and end ids are two more words
        flat, n = np.concatenate([flat, np.array([self.begin, self.end], np.uint32)]), np.concatenate([n, [1, 1]])
        units = np.insert(code, np.array(cuts[:-1]), len(n) - 2)
        heads = np.array(cuts[:-1]) + np.arange(len(texts))
        units = np.insert(units, np.append(heads[1:], len(units)), len(n) - 1)
        counts = np.add.reduceat(n[units], np.array(cuts[:-1]) + 2 * np.arange(len(texts)))
        ids = flat[ragged((np.cumsum(n) - n)[units], n[units])]
        return ids, counts

    def _known(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of the distinct words, how many each has, which distinct word each word is), through the memo."""
        coded = pa.array(words, pa.string()).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        memo = self.memo
        if len(memo) > MEMO_WORDS:
            memo.clear()
        found = [memo.get(w) for w in distinct]
        new = [k for k, f in enumerate(found) if f is None]
        if new:
            made, counts = self.encode_words([distinct[k] for k in new])
            stops = np.cumsum(counts)
            raw, ends = made.tobytes(), (4 * stops).tolist()
            for k, a, b in zip(new, [0, *ends], ends, strict=False):
                found[k] = raw[a:b]
                if len(distinct[k]) <= MEMO_CHARS:
                    memo[distinct[k]] = raw[a:b]
        return np.frombuffer(b"".join(found), np.uint32), np.array([len(f) // 4 for f in found], np.int64), coded.indices.to_numpy().astype(np.int64)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids. The space in front of the first piece is the model's own; each byte that is
        no part of a character reads as U+FFFD, also where a control id stands inside a character."""
        at = ids.astype(np.int64)
        hidden = np.flatnonzero(self.hidden[at])
        runs = [run for run in np.split(at, hidden) if len(run)]
        text = "".join(b"".join(self._bytes_of(run[k : k + GROUP_CHARS]) for k in range(0, len(run), GROUP_CHARS)).decode("utf-8", "stackwright-each-byte") for run in runs)
        shown = np.delete(at, hidden)
        return text[1:] if len(shown) and self.spaced[shown[0]] else text

    def _bytes_of(self, at: np.ndarray) -> bytes:
        starts = self.offsets[at]
        return self.bytes[ragged(starts, self.offsets[at + 1] - starts)].tobytes()


@lru_cache(maxsize=2)
def load(path: str) -> PieceTable:
    return PieceTable(path)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", packed: bool = False) -> DataFrame:
    """Encode each text and decode its ids: (doc_id, n_tokens long, ids, decoded string). ids is array<int>, or if packed
    binary, as little-endian unsigned 32-bit integers.

    One narrow Arrow pass, no shuffle. A task keeps the tables and a bounded memo of words.
    """

    def work(batches):
        table = load(path)
        for batch in batches:
            texts, doc_ids = texts_of(batch), batch.column(id_col)
            for a, b in groups_of([len(t) for t in texts], GROUP_CHARS):
                ids, counts = table.encode(texts[a:b])
                stops = np.cumsum(counts)
                each = [ids[e - n : e] for n, e in zip(counts.tolist(), stops.tolist(), strict=True)]
                shown = pa.array([x.astype("<u4").tobytes() for x in each], pa.binary()) if packed else list_array(ids.astype(np.int32), counts, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.slice(a, b - a), pa.array(counts, pa.int64()), shown, pa.array([table.decode(x) for x in each], pa.string())],
                    names=[id_col, "n_tokens", "ids", "decoded"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, docs[text_col].alias("text")).mapInArrow(work, f"{id_col} {kind}, n_tokens long, ids {'binary' if packed else 'array<int>'}, decoded string")
