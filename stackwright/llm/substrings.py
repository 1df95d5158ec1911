"""Substring dedup by super-k-mers.

A window is `WINDOW` consecutive words of one document. Each window's minimiser is the smallest hash of
its `GRAM`-word runs; consecutive windows that share it travel as one packed string, a super-k-mer, to
the minimiser's bucket. Equal windows have equal minimisers and so meet in one bucket, where sorting
their hashes brings them together; runs of candidates are then compared byte by byte, so windows are
told apart exactly. Every window but the first (smallest doc_id, then start) is a repeat, and the words
it covers go.

Before anything is sent, equal windows of one working group are reduced to the first of them, so a
passage that a third of all documents share reaches its bucket once per group and not once per row.
Packed strings of a group and bucket travel in one row. Buckets and partitions grow in number with the
table's bytes. A bucket is worked through in runs of HELD_BYTES, of which only the first of equal windows
are kept; where the distinct windows alone are more than that, as under a minimiser that many share, they
are dealt again by bits of their own hashes, so equal windows still meet, until all buckets are settled.

Null and empty texts have no words. Documents with fewer words than a window lose nothing. Texts of any
length are worked on in bounded slices that overlap by a window less one word. Rows are told apart by
(doc_id, hash of text), null ids first; rows that repeat both are the same document and get the same
result, of equal ids the smaller hash comes first. A table without rows gives none. Other columns are not
looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackwright.llm.common import bytes_of, groups_of, stage
from stackwright.llm.hashing import Powers, mix, range_hashes

WINDOW, GRAM = 20, 4
#: Bytes worked on at once, and the longest slice of one document.
GROUP_BYTES, SLICE_BYTES = 1_500_000, 750_000
#: Text bytes of a partition, buckets of a partition, and most partitions (beyond, partitions grow).
PART_BYTES, BUCKETS, MOST_PARTS = 8 << 20, 8, 100_000
#: Unpacked bytes of a bucket that are settled at once, and buckets that a larger one is dealt to.
HELD_BYTES, FAN = 10_000_000, 1 << 10
#: Id that stands for null: sorts first.
NULL_ID = -(1 << 63)

_A = np.uint64(0x94D049BB133111EB)
_WORD_POWERS = Powers(0xBF58476D1CE4E5B9)


class Words:
    """Words of a buffer in which single blanks stand between words and newlines between documents."""

    def __init__(self, joined: bytes):
        self.data = joined
        raw = np.frombuffer(joined, np.uint8)
        gap = np.flatnonzero(SEPARATORS[raw])
        starts = np.concatenate([[0], gap + 1])
        ends = np.concatenate([gap, [len(raw)]])
        full = ends > starts
        self.starts, self.ends = starts[full], ends[full]
        self.hashes = range_hashes(raw, self.starts, self.ends)

    def window_hashes(self) -> np.ndarray:
        """A hash of the WINDOW words from each word on."""
        n = len(self.hashes)
        if n < WINDOW:
            return np.zeros(0, np.uint64)
        up, down = _WORD_POWERS.get(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.hashes * up[:n], out=sums[1:])
        return mix((sums[WINDOW:] - sums[:-WINDOW]) * down[: n - WINDOW + 1])

    def minimisers(self) -> np.ndarray:
        h = self.hashes
        g = h[: len(h) - GRAM + 1]
        for k in range(1, GRAM):
            g = g * _A + h[k : len(h) - GRAM + 1 + k]
        g, n = mix(g), WINDOW - GRAM + 1
        low, size = g, 1
        while size * 2 <= n:
            low, size = np.minimum(low[:-size], low[size:]), size * 2
        out = len(g) - n + 1
        return np.minimum(low[:out], low[n - size : n - size + out])

    def text(self, first: int, last: int) -> bytes:
        return self.data[self.starts[first] : self.ends[last]]


SEPARATORS = np.zeros(256, bool)
SEPARATORS[[32, 10]] = True


def first_equal(words: Words, hashes: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """For each of the windows (word indexes, in order of precedence) the place in the list of the first
    window with the same words."""
    if not len(windows):
        return np.zeros(0, np.int64)
    h = hashes[windows]
    order = np.argsort(h, kind="stable")
    new = np.concatenate([[True], h[order][1:] != h[order][:-1]])
    source = np.empty(len(windows), np.int64)
    source[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    again = np.flatnonzero(source != np.arange(len(windows)))
    if not len(again):
        return source
    # runs of windows whose sources run along with them are compared as one stretch of bytes
    a, b = windows[again], windows[source[again]]
    cut = np.flatnonzero(np.concatenate([[True], (np.diff(a) != 1) | (np.diff(b) != 1)]))
    stops = np.append(cut[1:], len(a))
    wrong = [k for i, j in zip(cut.tolist(), stops.tolist(), strict=True) if words.text(a[i], a[j - 1] + WINDOW - 1) != words.text(b[i], b[j - 1] + WINDOW - 1) for k in range(i, j)]
    if wrong:  # different words with one hash: settle all windows with these hashes by their bytes
        seen: dict[bytes, int] = {}
        for k in np.flatnonzero(np.isin(h, h[again[wrong]])).tolist():
            source[k] = seen.setdefault(words.text(windows[k], windows[k] + WINDOW - 1), k)
    return source


def slices(data: bytes):
    """(words before, bytes) of overlapping slices that hold each window once."""
    at = before = 0
    while len(data) - at > SLICE_BYTES:
        end = at + SLICE_BYTES
        while True:
            end = data.find(b" ", end)
            if end < 0 or data.count(b" ", at, end) >= 2 * WINDOW:
                break
            end += SLICE_BYTES
        if end < 0:
            break
        yield before, data[at:end]
        gaps = np.flatnonzero(np.frombuffer(data, np.uint8, end - at, at) == 32)
        n = len(gaps) + 1
        before += n - WINDOW + 1
        at += int(gaps[n - WINDOW]) + 1
    yield before, data[at:]


def _pack(*arrays: np.ndarray, text: bytes = b"") -> bytes:
    """The unpacked size, negative if the rest is not compressed, and the arrays and text."""
    n = len(arrays[0])
    raw = np.array([n, len(text)], "<i8").tobytes() + b"".join(np.ascontiguousarray(a, "<i8").tobytes() for a in arrays) + text
    if len(raw) < 256:
        return np.array([-len(raw)], "<i8").tobytes() + raw
    return np.array([len(raw)], "<i8").tobytes() + pa.Codec("zstd", compression_level=6).compress(raw, asbytes=True)


def _size(blob: bytes) -> int:
    return abs(int.from_bytes(blob[:8], "little", signed=True))


def _unpack(blob: bytes, n_arrays: int) -> tuple[list[np.ndarray], bytes]:
    size = int.from_bytes(blob[:8], "little", signed=True)
    raw = blob[8:] if size < 0 else pa.decompress(blob[8:], size, codec="zstd", asbytes=True)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    return [np.frombuffer(raw, "<i8", n, 16 + 8 * n * k) for k in range(n_arrays)], raw[16 + 8 * n * n_arrays :]


def _spans(ids: np.ndarray, keys: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Repeated windows as word ranges (id, key, start, stop), neighbours joined."""
    order = np.lexsort((starts, keys, ids))
    ids, keys, starts = ids[order], keys[order], starts[order]
    cut = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1]) | (np.diff(starts) > 1)])) if len(ids) else np.zeros(0, np.int64)
    last = np.append(cut[1:], len(ids)) - 1 if len(ids) else cut
    return ids[cut], keys[cut], starts[cut], starts[last] + WINDOW


class Items:
    """Stretches of words (id, key, words before, bytes), in order, and the first of their equal windows."""

    def __init__(self, ids: np.ndarray, keys: np.ndarray, before: np.ndarray, texts: list[bytes]):
        order = np.lexsort((before, keys, ids))
        self.ids, self.keys, self.before = ids[order], keys[order], before[order]
        texts = [texts[k] for k in order.tolist()]
        self.words = Words(b"\n".join(texts))
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        item = np.searchsorted(ends, self.words.starts, side="right")
        begins = np.searchsorted(item, np.arange(len(texts)))
        n = max(0, len(item) - WINDOW + 1)
        self.windows = np.flatnonzero(item[:n] == item[WINDOW - 1 :]) if n else np.zeros(0, np.int64)
        self.owner = item[self.windows]
        self.place = self.windows - begins[self.owner] + self.before[self.owner]
        self.hashes = self.words.window_hashes()
        source = first_equal(self.words, self.hashes, self.windows)
        self.first = source == np.arange(len(self.windows))
        id_, key = self.ids[self.owner], self.keys[self.owner]
        gone = (id_ != id_[source]) | (key != key[source]) | (self.place != self.place[source])
        self.spans = _spans(id_[gone], key[gone], self.place[gone]) if gone.any() else None

    def runs(self, label: np.ndarray):
        """(label, ids, keys, words before, bytes) of runs of first windows with one label, by label."""
        kept, owner, place, label = self.windows[self.first], self.owner[self.first], self.place[self.first], label[self.first]
        if not len(kept):
            return
        cut = np.flatnonzero(np.concatenate([[True], (np.diff(kept) != 1) | (owner[1:] != owner[:-1]) | (label[1:] != label[:-1])]))
        last = np.append(cut[1:], len(kept)) - 1
        order = np.argsort(label[cut], kind="stable")
        a, b = self.words.starts[kept[cut]][order].tolist(), self.words.ends[kept[last] + WINDOW - 1][order].tolist()
        texts = [self.words.data[x:y] for x, y in zip(a, b, strict=True)]
        who, where, names = owner[cut][order], place[cut][order], label[cut][order]
        bounds = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]])).tolist() + [len(order)]
        for x, y in zip(bounds, bounds[1:], strict=False):
            yield int(names[x]), self.ids[who[x:y]], self.keys[who[x:y]], where[x:y], texts[x:y]


def pack_group(items: list[tuple[int, int, int, bytes]], n_buckets: int):
    """(bucket, is_spans, payload) rows of one working group; items: (id, key, words before, bytes)."""
    ids, keys, before = (np.array([x[k] for x in items], np.int64) for k in range(3))
    found = Items(ids, keys, before, [x[3] for x in items])
    if not len(found.windows):
        return
    if found.spans:
        yield int(found.ids[0] % n_buckets), True, _pack(*found.spans)
    bucket = found.words.minimisers()[found.windows] % np.uint64(n_buckets)
    for name, ids, keys, before, texts in found.runs(bucket.astype(np.int64)):
        yield name, False, _pack(ids, keys, before, text=b"\n".join(texts))


class Bucket:
    """Settles a bucket's windows as its payloads come in, holding the first of equal windows only. What
    has to be dealt again comes out as (bucket, payload) rows."""

    def __init__(self, name: int, level: int):
        self.name, self.level = name, level
        self.parts: list[tuple] = []
        self.size, self.over = 0, False

    def add(self, payload: bytes):
        arrays, text = _unpack(payload, 3)
        self.parts.append((*arrays, text.split(b"\n")))
        self.size += _size(payload)
        if self.size > HELD_BYTES:
            yield from self.settle()

    def settle(self, last: bool = False):
        """(spans, None) and (None, (bucket, payload))."""
        if not self.parts:
            return
        found = Items(*(np.concatenate([p[k] for p in self.parts]) for k in range(3)), [t for p in self.parts for t in p[3]])
        self.parts, self.size = [], 0
        if found.spans:
            yield found.spans, None
        if last and not self.over:
            return
        if not self.over:
            held = list(found.runs(np.zeros(len(found.windows), np.int64)))
            size = sum(24 * len(h[1]) + sum(map(len, h[4])) for h in held)
            if size <= HELD_BYTES // 2 or len(found.windows[found.first]) < 2:
                self.parts, self.size = [h[1:] for h in held], size
                return
            self.over = True
        part = (found.hashes[found.windows] >> np.uint64(10 * (self.level % 6))) % np.uint64(FAN)
        for name, ids, keys, before, texts in found.runs(part.astype(np.int64)):
            yield None, ((self.name * FAN + name) % (1 << 62), _pack(ids, keys, before, text=b"\n".join(texts)))


SETTLED = "_id long, _key long, start long, stop long, bucket long, payload binary"


def _settler(level: int):
    """For mapInArrow over (bucket, is_spans, payload) sorted by bucket: spans, and rows to be dealt again."""

    def rows(found):
        for spans, again in found:
            if spans is not None:
                n = len(spans[0])
                yield pa.RecordBatch.from_arrays([*(pa.array(s.astype(np.int64)) for s in spans), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], names=["_id", "_key", "start", "stop", "bucket", "payload"])
            else:
                yield pa.RecordBatch.from_arrays([*(pa.nulls(1, pa.int64()) for _ in range(4)), pa.array([again[0]], pa.int64()), pa.array([again[1]], pa.binary())], names=["_id", "_key", "start", "stop", "bucket", "payload"])

    def settle(batches):
        bucket = None
        for batch in batches:
            for k, is_spans, payload in zip(*(batch.column(c).to_pylist() for c in ("bucket", "is_spans", "payload")), strict=True):
                if is_spans:
                    yield from rows([(_unpack(payload, 4)[0], None)])
                    continue
                if bucket is None or bucket.name != k:
                    if bucket is not None:
                        yield from rows(bucket.settle(last=True))
                    bucket = Bucket(k, level)
                yield from rows(bucket.add(payload))
        if bucket is not None:
            yield from rows(bucket.settle(last=True))

    return settle


def repeated_spans(rows: DataFrame) -> DataFrame:
    """(_id, _key, start, stop) word ranges, from (_id, _key, text); ranges may come up several times."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-size // PART_BYTES), MOST_PARTS))
    n_buckets = max(n * BUCKETS, -(-size * BUCKETS // PART_BYTES))

    def send(batches):
        for batch in batches:
            ids, keys = batch.column("_id").to_pylist(), batch.column("_key").to_pylist()
            texts = bytes_of(batch)
            for a, b in groups_of([len(t) for t in texts], GROUP_BYTES):
                items = [(i, k, w, part) for i, k, t in zip(ids[a:b], keys[a:b], texts[a:b], strict=True) for w, part in slices(b" ".join(t.split()))]
                for x, y in groups_of([len(i[3]) for i in items], GROUP_BYTES):
                    found = list(pack_group(items[x:y], n_buckets))
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.bool_()), pa.array([f[2] for f in found], pa.binary())], names=["bucket", "is_spans", "payload"])

    packed, out, level = rows.mapInArrow(send, "bucket long, is_spans boolean, payload binary"), None, 0
    while True:
        dealt = packed.repartition(n, "bucket").sortWithinPartitions("bucket")
        # a written table, so that the super-k-mers' shuffle files can go before the texts are joined
        settled = stage(dealt.mapInArrow(_settler(level), SETTLED), "spans")
        spans = settled.where("payload is null").select("_id", "_key", "start", "stop")
        out = spans if out is None else out.unionByName(spans)
        again = settled.where("payload is not null").select("bucket", F.lit(False).alias("is_spans"), "payload")
        if again.isEmpty():
            return out
        packed, level = again, level + 1


def _cut(data: bytes, starts: list[int] | None, stops: list[int] | None) -> tuple[int, int, bytes]:
    words = data.split()
    if not starts:
        return len(words), 0, b" ".join(words)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, stops, -1)
    keep = np.cumsum(edges[:-1]) == 0
    kept = [words[i] for i in np.flatnonzero(keep).tolist()]
    return len(words), len(words) - len(kept), b" ".join(kept)


def dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept string): each text without the words that repeat earlier windows."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    rows = rows.withColumns({"_id": F.coalesce("doc_id", F.lit(NULL_ID)), "_key": F.xxhash64("text")})
    spans = repeated_spans(rows.select("_id", "_key", "text"))
    # sets: a document that stands in many rows has its spans once
    by_doc = spans.groupBy("_id", "_key").agg(F.collect_set(F.struct("start", "stop")).alias("_spans"))
    by_doc = by_doc.select("_id", "_key", F.col("_spans.start").alias("starts"), F.col("_spans.stop").alias("stops"))
    joined = rows.join(by_doc, ["_id", "_key"], "left").select("doc_id", "text", "starts", "stops")

    def work(batches):
        for batch in batches:
            found = [_cut(*x) for x in zip(bytes_of(batch), batch.column("starts").to_pylist(), batch.column("stops").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept"],
            )

    return joined.mapInArrow(work, "doc_id long, n_words long, n_removed long, kept string")
