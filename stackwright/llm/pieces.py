"""Split texts where byte-level BPE may be cut, and remember what each piece encodes to.

The pre-tokenizer's pattern never lets a token reach over a single space that stands between two
non-space characters: every alternative that takes the space starts at it. So a text may be cut in
front of each such space and encoded piece by piece with the same result. Pieces are mostly words,
which repeat: a group's distinct pieces are looked up at once in a memo of flat arrays, and only those
that it does not hold are encoded.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from stackwright.llm.hashing import ragged, range_hashes

#: Slots of the memo (a power of two, at most 5 of 8 are filled), and the longest piece that is kept, in bytes.
MEMO_SLOTS, MEMO_BYTES = 1 << 22, 64
#: Pieces beside which a cut may not be safe: empty, or white space at an end. Some control characters
#: that are no white space for the pre-tokenizer count too, which costs time but no correctness.
OPEN = r"^$|^[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]|[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]$"
#: One run of letters and one mark after it are tokens apart.
MARKS, MARKED = ".,;:!?", r"^\p{Latin}+[.,;:!?]$"

Ids = tuple[np.ndarray, np.ndarray]


class Memo:
    """Token ids of pieces after a space, in an open-addressing table of 64-bit hashes. A hit counts only if
    the ids' bytes are those of the space and the piece, so two pieces with one hash are told apart. A full
    table is emptied."""

    def __init__(self, token_bytes: list[bytes], slots: int = MEMO_SLOTS):
        self.slots = slots
        self.lengths = np.array([len(t) for t in token_bytes], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(token_bytes), np.uint8)
        self.keys: np.ndarray | None = None
        self.used = self.end = 0

    def _reset(self) -> None:
        self.keys = np.zeros(self.slots, np.uint64)
        self.at, self.count = np.zeros(self.slots, np.uint32), np.zeros(self.slots, np.uint8)
        self.store = np.zeros(1 << 16, np.uint16 if len(self.lengths) <= 1 << 16 else np.uint32)
        self.used = self.end = 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each hash, -1 if there is none."""
        out = np.full(len(hashes), -1, np.int64)
        if self.keys is None:
            return out
        mask = np.uint64(self.slots - 1)
        left, place = np.arange(len(hashes)), hashes & mask
        while len(left):
            held = self.keys[place]
            hit = held == hashes[left]
            out[left[hit]] = place[hit].astype(np.int64)
            on = ~hit & (held != 0)
            left, place = left[on], (place[on] + np.uint64(1)) & mask
        return out

    def add(self, hashes: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Enter pieces that are not held yet; hashes are distinct."""
        if self.keys is None or self.used + len(hashes) > self.slots * 5 // 8:
            self._reset()
            if len(hashes) > self.slots * 5 // 8:
                return
        n = int(counts.sum())
        if self.end + n > len(self.store):
            grown = np.zeros(2 * (self.end + n), self.store.dtype)
            grown[: self.end] = self.store[: self.end]
            self.store = grown
        self.store[self.end : self.end + n] = ids
        at = self.end + np.cumsum(counts) - counts
        self.end += n
        self.used += len(hashes)
        mask = np.uint64(self.slots - 1)
        left, place = np.arange(len(hashes)), hashes & mask
        while len(left):
            free = self.keys[place] == 0
            self.keys[place[free]] = hashes[left[free]]  # of several that claim a slot one gets it
            won = free & (self.keys[place] == hashes[left])
            self.at[place[won]], self.count[place[won]] = at[left[won]], counts[left[won]]
            left, place = left[~won], (place[~won] + np.uint64(1)) & mask

    def known(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """Which of the pieces, given by their places in raw, are what their slots hold."""
        found = np.flatnonzero(slots >= 0)
        counts = self.count[slots[found]].astype(np.int64)
        ids = self.store[ragged(self.at[slots[found]].astype(np.int64), counts)].astype(np.int64)
        owner = np.repeat(np.arange(len(found)), counts)
        same = np.bincount(owner, self.lengths[ids], len(found)).astype(np.int64) == lengths[found] + 1
        ids, found = ids[same[owner]], found[same]
        n = lengths[found]
        theirs = self.bytes[ragged(self.starts[ids], self.lengths[ids])]  # a space, then the piece
        wrong = theirs[ragged(np.cumsum(n + 1) - n, n)] != raw[ragged(starts[found], n)]
        out = np.zeros(len(slots), bool)
        out[found] = np.bincount(np.repeat(np.arange(len(found)), n), wrong, len(found)) == 0
        return out


class PieceEncoder:
    """Encode texts to token ids. encode_spaced gives the ids of pieces that each stand after a space, in
    one array with the number of ids of each; encode_whole those of texts as they are."""

    def __init__(self, encode_spaced: Callable[[list[str]], Ids], encode_whole: Callable[[list[str]], Ids], token_bytes: list[bytes], slots: int = MEMO_SLOTS):
        self.encode_spaced, self.encode_whole = encode_spaced, encode_whole
        self.memo = Memo(token_bytes, slots)
        self.mark = np.zeros(256, np.uint32)
        for m in MARKS:
            self.mark[ord(m)] = encode_whole([m])[0][0]

    def encode(self, texts: list[str]) -> Ids:
        """The ids of all texts in one array, and how many each text has."""
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        split = pc.split_pattern(pa.array(texts, pa.string()), " ")
        cuts = split.offsets.to_numpy().astype(np.int64)
        coded = split.flatten().dictionary_encode()
        code, piece = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        cuts -= cuts[0]
        heads, sizes = cuts[:-1], np.diff(cuts)
        is_open = pc.match_substring_regex(piece, OPEN).to_numpy(zero_copy_only=False)
        careful = (np.add.reduceat(is_open[code].astype(np.int64), heads) > 0) & (sizes > 1)
        plain = np.repeat(~careful, sizes)
        plain[heads] = False
        wanted = np.zeros(len(piece), bool)
        wanted[code[plain]] = True
        ids, counts = self._spaced(piece.filter(pa.array(wanted)))
        length = np.zeros(len(piece) + len(texts), np.int64)
        length[: len(piece)][wanted] = counts
        # what stands first in a text, or the whole text if it can't be cut everywhere, is a unit of its own
        first = [self._careful(texts[i]) if careful[i] else None for i in range(len(texts))]
        whole, whole_counts = self.encode_whole([piece[c].as_py() for c, f in zip(code[heads].tolist(), first, strict=True) if f is None])
        stops = np.cumsum(whole_counts)
        rest = iter(np.split(whole, stops[:-1]) if len(stops) else [])
        units = [next(rest) if f is None else f for f in first]
        length[len(piece) :] = [len(u) for u in units]
        store = np.concatenate([ids, *units])
        unit = np.where(plain, code, len(piece))
        unit[heads] = len(piece) + np.arange(len(texts))
        taken = length[unit]
        inner = ~plain
        inner[heads] = False
        taken[inner] = 0  # inside a text that is a unit as a whole
        start = np.cumsum(length) - length
        return store[ragged(start[unit], taken)], np.add.reduceat(taken, heads)

    def _spaced(self, pieces: pa.Array) -> Ids:
        """The ids of distinct pieces, each after a space."""
        marked = pc.match_substring_regex(pieces, MARKED)
        coded = pc.if_else(marked, pc.utf8_slice_codeunits(pieces, 0, -1), pieces).dictionary_encode()
        ids, counts = self._remembered(coded.dictionary)
        body, has_mark = coded.indices.to_numpy().astype(np.int64), marked.to_numpy(zero_copy_only=False).astype(np.int64)
        total = counts[body] + has_mark
        out = np.zeros(int(total.sum()), np.uint32)
        at = np.cumsum(total) - total
        out[ragged(at, counts[body])] = ids[ragged((np.cumsum(counts) - counts)[body], counts[body])]
        if has_mark.any():
            offsets, data = _buffers(pieces)
            with_mark = np.flatnonzero(has_mark)
            out[(at + total - 1)[with_mark]] = self.mark[data[offsets[with_mark + 1] - 1]]
        return out, total

    def _remembered(self, pieces: pa.Array) -> Ids:
        """The same, through the memo."""
        offsets, raw = _buffers(pieces)
        starts, lengths = offsets[:-1], np.diff(offsets)
        memo, hashes = self.memo, np.maximum(range_hashes(raw, starts, offsets[1:]), np.uint64(1))
        slots = memo.find(hashes)
        known = memo.known(raw, starts, lengths, slots) if (slots >= 0).any() else np.zeros(len(slots), bool)
        fresh = np.flatnonzero(~known)
        counts = np.zeros(len(slots), np.int64)
        old = slots[known]
        if len(old):
            counts[known] = memo.count[old]
            kept = memo.store[ragged(memo.at[old].astype(np.int64), counts[known])].astype(np.uint32)
        else:
            kept = np.zeros(0, np.uint32)
        made, made_counts = self.encode_spaced(pieces.take(pa.array(fresh)).to_pylist()) if len(fresh) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        counts[fresh] = made_counts
        at = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), np.uint32)
        out[ragged(at[known], counts[known])] = kept
        out[ragged(at[fresh], made_counts)] = made
        keep = np.zeros(len(fresh), bool)
        keep[np.unique(hashes[fresh], return_index=True)[1]] = True
        keep &= (slots[fresh] < 0) & (lengths[fresh] <= MEMO_BYTES)
        if keep.any():
            memo.add(hashes[fresh][keep], made[ragged((np.cumsum(made_counts) - made_counts)[keep], made_counts[keep])], made_counts[keep])
        return out, counts

    def _careful(self, text: str) -> np.ndarray:
        """A text whose parts touch at an unsafe place somewhere: they are joined there before they are encoded."""
        parts = text.split(" ")
        pieces, run = [], [parts[0]]
        for left, right in zip(parts, parts[1:], strict=False):
            if not left or not right or left[-1].isspace() or right[0].isspace():
                run.append(right)
            else:
                pieces.append(" ".join(run))
                run = [right]
        pieces.append(" ".join(run))
        ids, counts = self.encode_whole(pieces[:1])
        if len(pieces) == 1:
            return ids
        coded = pa.array(pieces[1:], pa.string()).dictionary_encode()
        inner = pc.match_substring(coded.dictionary, " ").to_numpy(zero_copy_only=False)
        # pieces with spaces inside are encoded as they are; others like any
        plain, plain_counts = self._spaced(coded.dictionary.filter(pa.array(~inner)))
        odd, odd_counts = self.encode_whole([" " + p for p in coded.dictionary.filter(pa.array(inner)).to_pylist()])
        n = np.zeros(len(inner), np.int64)
        n[~inner], n[inner] = plain_counts, odd_counts
        start = np.zeros(len(inner), np.int64)
        start[~inner] = np.cumsum(plain_counts) - plain_counts
        start[inner] = len(plain) + np.cumsum(odd_counts) - odd_counts
        code = coded.indices.to_numpy()
        return np.concatenate([ids, np.concatenate([plain, odd])[ragged(start[code], n[code])]])


def _buffers(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of a string array."""
    strings = pa.concat_arrays([strings])  # no slice
    _, offsets, data = strings.buffers()
    if not len(strings):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    at = np.frombuffer(offsets, np.int32, len(strings) + 1, 4 * strings.offset).astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return at - at[0], raw
