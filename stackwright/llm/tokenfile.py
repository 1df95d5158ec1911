"""Token-ID files: patched frame-of-reference blocks.

A file is a run of segments, each for itself complete: fixed header, document table, block index,
blocks. A block holds 128 ids: its minimum is subtracted, the differences are packed at the width that
covers a chosen percentile of them, and the larger ones stand whole in the block's exception list. The
index has each block's start, so any block can be read alone.

Files are written through Spark's committer into the shared folder, so a lost executor's half-written
file is never seen, and any file system that Spark writes will do. A byte 0x0A follows each segment.

A file holds what FILE_BYTES of text encode to, whatever the table's size, so no task and no file grows
with it. Texts are shuffled, not ids: four bytes an id are 1.6 bytes for a byte of text.

Null and empty texts give the end id alone. Documents are ordered by doc_id, null ids first; rows that
share one stand in order of their texts' hashes, so a hot id spreads over files; repeated rows are written
each on its own. Texts of any length are encoded whole and a document is never split between segments. A
table without rows gives no files' rows. Other columns are not looked at.
"""

from __future__ import annotations

import os
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stackwright.llm.bpe import byte_letters
from stackwright.llm.common import fresh_path, groups_of, stage, texts_of
from stackwright.llm.pieces import Ids, PieceEncoder

MAGIC = b"PFR1"
BLOCK = 128
#: The share of a block's differences that its packed width must hold.
PERCENTILE = 0.9
#: A segment is closed when it has this many ids; texts are encoded in groups of so many characters.
SEGMENT_IDS, GROUP_CHARS = 2_000_000, 4_000_000
#: Bytes of text that go into one file, about.
FILE_BYTES = 48 << 20
#: Files whose sizes one task adds up.
FILES_PER_SUM = 2_000
HEADER = np.dtype([("magic", "S4"), ("n_docs", "<u4"), ("n_ids", "<u8"), ("n_blocks", "<u4"), ("size", "<u8")])
DOC = np.dtype([("doc_id", "<i8"), ("null", "<u1"), ("n_ids", "<u4")])


@lru_cache(maxsize=2)
def library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task has one core
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


#: Pieces that the library encodes in one text.
JOINED = 20_000


@lru_cache(maxsize=2)
def library_pieces(path: str) -> PieceEncoder:
    """Pieces encoded by the library, many at once: joined by single spaces they encode as they do alone,
    and the tokens that start with a space tell where each begins."""
    tok = library(path)
    letters = byte_letters()
    data = [b""] * tok.get_vocab_size(with_added_tokens=True)
    special = tok.get_added_tokens_decoder()
    for token, i in tok.get_vocab(with_added_tokens=True).items():
        data[i] = token.encode() if i in special else bytes(letters[c] for c in token)
    begins = np.array([t[:1] == b" " for t in data])

    def whole(texts: list[str]) -> Ids:
        found = [np.array(e.ids, np.uint32) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *found]), np.array([len(f) for f in found], np.int64)

    def spaced(pieces: list[str]) -> Ids:
        ids, counts = [], []
        for i in range(0, len(pieces), JOINED):
            part = pieces[i : i + JOINED]
            found = np.array(tok.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            at = np.flatnonzero(begins[found])
            if len(at) != len(part):
                raise ValueError("pieces must not hold spaces")
            ids.append(found)
            counts.append(np.diff(np.append(at, len(found))))
        return np.concatenate([np.zeros(0, np.uint32), *ids]), np.concatenate([np.zeros(0, np.int64), *counts])

    return PieceEncoder(spaced, whole, data)


def widths_of(values: np.ndarray) -> np.ndarray:
    """Bits that each unsigned value needs."""
    return np.ceil(np.log2(values.astype(np.float64) + 1)).astype(np.int64)


def pack_ids(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Blocks of ids: (bytes, start of each block and the end)."""
    n = len(ids)
    n_blocks = -(-n // BLOCK)
    if not n_blocks:
        return b"", np.zeros(1, "<u8")
    full = np.empty(n_blocks * BLOCK, np.uint32)
    full[:n] = ids
    full[n:] = ids[-1]
    full = full.reshape(n_blocks, BLOCK)
    low = full.min(axis=1)
    diff = full - low[:, None]
    rank = min(BLOCK - 1, int(PERCENTILE * BLOCK))
    width = widths_of(np.partition(diff, rank, axis=1)[:, rank])
    over = diff >= (np.uint64(1) << width.astype(np.uint64))[:, None]
    n_over = over.sum(axis=1)
    sizes = 4 + 1 + 1 + (BLOCK // 8) * width + 5 * n_over
    starts = np.zeros(n_blocks + 1, np.int64)
    np.cumsum(sizes, out=starts[1:])
    out = np.zeros(starts[-1], np.uint8)
    at = starts[:-1]
    out[at[:, None] + np.arange(4)] = low.astype("<u4").view(np.uint8).reshape(-1, 4)
    out[at + 4], out[at + 5] = width, n_over
    bits = np.unpackbits(diff.astype("<u4").view(np.uint8).reshape(n_blocks, BLOCK * 4), axis=1, bitorder="little").reshape(n_blocks, BLOCK, 32)
    for w in np.unique(width):
        if w:
            rows = np.flatnonzero(width == w)
            packed = np.packbits(bits[rows, :, :w].reshape(len(rows), BLOCK * w), axis=1, bitorder="little")
            out[(at[rows] + 6)[:, None] + np.arange(packed.shape[1])] = packed
    row, col = np.nonzero(over)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(n_over) - n_over, n_over)
    place = at[row] + 6 + (BLOCK // 8) * width[row] + 5 * nth
    out[place] = col
    out[place[:, None] + np.arange(1, 5)] = diff[row, col].astype("<u4").view(np.uint8).reshape(-1, 4)
    return out.tobytes(), starts.astype("<u8")


def unpack_ids(data: bytes, starts: np.ndarray, n: int) -> np.ndarray:
    """The ids of pack_ids."""
    raw = np.frombuffer(data, np.uint8)
    at = starts[:-1].astype(np.int64)
    n_blocks = len(at)
    if not n_blocks:
        return np.zeros(0, np.uint32)
    low = np.ascontiguousarray(raw[at[:, None] + np.arange(4)]).view("<u4").ravel()
    width, n_over = raw[at + 4].astype(np.int64), raw[at + 5].astype(np.int64)
    diff = np.zeros((n_blocks, BLOCK), np.uint32)
    for w in np.unique(width):
        if w:
            rows = np.flatnonzero(width == w)
            bits = np.unpackbits(raw[(at[rows] + 6)[:, None] + np.arange((BLOCK // 8) * w)], axis=1, bitorder="little")
            wide = np.zeros((len(rows), BLOCK, 32), np.uint8)
            wide[:, :, :w] = bits.reshape(len(rows), BLOCK, w)
            diff[rows] = np.packbits(wide.reshape(len(rows), -1), axis=1, bitorder="little").view("<u4")
    row = np.repeat(np.arange(n_blocks), n_over)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(n_over) - n_over, n_over)
    place = at[row] + 6 + (BLOCK // 8) * width[row] + 5 * nth
    diff[row, raw[place]] = np.ascontiguousarray(raw[place[:, None] + np.arange(1, 5)]).view("<u4").ravel()
    return (diff + low[:, None]).ravel()[:n]


#: Blocks packed at once: bounds the bit matrices.
SLAB = 2048 * BLOCK


def build_segment(doc_ids: list[int | None], coded: list[bytes]) -> bytes:
    table = np.zeros(len(doc_ids), DOC)
    table["doc_id"] = [0 if d is None else d for d in doc_ids]
    table["null"] = [d is None for d in doc_ids]
    table["n_ids"] = [len(c) // 4 for c in coded]
    ids = np.frombuffer(b"".join(coded), "<u4")
    parts, starts, base = [], [np.zeros(1, "<u8")], 0
    for i in range(0, len(ids), SLAB):
        data, at = pack_ids(ids[i : i + SLAB])
        parts.append(data)
        starts.append(at[1:] + np.uint64(base))
        base += len(data)
    index = np.concatenate(starts).astype("<u8")
    head = np.zeros(1, HEADER)
    head["magic"], head["n_docs"], head["n_ids"], head["n_blocks"] = MAGIC, len(table), len(ids), len(index) - 1
    head["size"] = HEADER.itemsize + table.nbytes + index.nbytes + base
    return head.tobytes() + table.tobytes() + index.tobytes() + b"".join(parts)


def read_segments(content: bytes):
    """(document table, ids of each slab in turn) of each segment of a file."""
    at = 0
    while at < len(content):
        head = np.frombuffer(content, HEADER, 1, at)[0]
        if head["magic"] != MAGIC:
            raise ValueError(f"no segment at byte {at}")
        p = at + HEADER.itemsize
        table = np.frombuffer(content, DOC, int(head["n_docs"]), p)
        p += table.nbytes
        index = np.frombuffer(content, "<u8", int(head["n_blocks"]) + 1, p)
        p += index.nbytes
        yield table, slabs(content, p, index, int(head["n_ids"]))
        at += int(head["size"]) + 1


def slabs(content: bytes, base: int, index: np.ndarray, n_ids: int):
    per = SLAB // BLOCK
    for b in range(0, len(index) - 1, per):
        part = index[b : b + per + 1]
        lo, hi = int(part[0]), int(part[-1])
        yield unpack_ids(content[base + lo : base + hi], part - part[0], min(n_ids - b * BLOCK, SLAB))


def write_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, partitions: int | None = None) -> None:
    """Encode texts with the library, append end_id to each document and write the files in doc_id order.

    One range shuffle on doc_id spreads rows evenly; the file's part number follows the order.
    """

    def work(batches):
        pieces, end = library_pieces(tokenizer), array("I", [end_id]).tobytes()
        ids, coded, total = [], [], 0
        for batch in batches:
            texts, doc_ids = texts_of(batch), batch.column("doc_id").to_pylist()
            for a, b in groups_of([len(t) for t in texts], GROUP_CHARS):
                flat, counts = pieces.encode(texts[a:b])
                raw, stops = memoryview(flat.tobytes()), (4 * np.cumsum(counts)).tolist()
                for d, x, y in zip(doc_ids[a:b], [0, *stops], stops, strict=False):
                    c = raw[x:y]
                    if total and total + len(c) // 4 > SEGMENT_IDS:
                        yield pa.RecordBatch.from_arrays([pa.array([build_segment(ids, coded)], pa.binary())], names=["segment"])
                        ids, coded, total = [], [], 0
                    ids.append(d)
                    coded.append(b"".join((c, end)))
                    total += len(c) // 4 + 1
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([build_segment(ids, coded)], pa.binary())], names=["segment"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    if not partitions:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))
    order = ["doc_id", "_key", "_nth"]  # the last spreads repeated rows
    rows = rows.withColumns({"_key": F.xxhash64("text"), "_nth": F.monotonically_increasing_id()})
    ordered = rows.repartitionByRange(partitions, *order).sortWithinPartitions(*order).select("doc_id", "text")
    ordered.mapInArrow(work, "segment binary").select(F.col("segment").cast("string")).write.text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document in file order: (file, segment, nth, doc_id, before, n_tokens, ids_crc32);
    before counts the ids of earlier documents of the same segment."""

    def work(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                for s, (table, parts) in enumerate(read_segments(content)):
                    n = table["n_ids"].astype(np.int64)
                    stops = np.cumsum(n)
                    crcs, doc, seen = [0] * len(n), 0, 0
                    for ids in parts:
                        raw = memoryview(ids.astype("<u4").tobytes())
                        at = 0
                        while at < len(ids) and doc < len(n):
                            take = min(len(ids) - at, int(stops[doc]) - seen)
                            crcs[doc] = zlib.crc32(raw[4 * at : 4 * (at + take)], crcs[doc])
                            at, seen = at + take, seen + take
                            while doc < len(n) and seen == stops[doc]:
                                doc += 1
                    k = len(n)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * k, pa.string()), pa.array(np.full(k, s, np.int64)), pa.array(np.arange(k)), pa.array(table["doc_id"].astype(np.int64), mask=table["null"] > 0), pa.array(stops - n), pa.array(n), pa.array(np.array(crcs, np.int64))],
                        names=["file", "segment", "nth", "doc_id", "before", "n_tokens", "ids_crc32"],
                    )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(work, "file string, segment long, nth long, doc_id long, before long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write the files, read them back: (doc_id, start, n_tokens, ids_crc32)."""
    spark = docs.sparkSession
    path = fresh_path(spark, "token-files")
    write_files(docs, path, tokenizer, end_id)
    back = stage(read_files(spark, path), "token-rows")
    # part numbers follow the order of rows. One row per segment; files are added up in groups, then groups
    totals = back.groupBy("file", "segment").agg(F.sum("n_tokens").alias("ids")).withColumn("part", F.regexp_extract("file", r"part-([0-9]+)", 1).cast("long"))
    totals = stage(totals.withColumn("many", F.floor(F.col("part") / FILES_PER_SUM)), "token-totals")

    def before(w):
        return F.coalesce(F.sum("ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    groups = totals.groupBy("many").agg(F.sum("ids").alias("ids")).select("many", before(Window.orderBy("many")).alias("base"))
    inner = totals.select("file", "segment", "many", before(Window.partitionBy("many").orderBy("part", "segment")).alias("inner"))
    bases = inner.join(F.broadcast(groups), "many").select("file", "segment", (F.col("base") + F.col("inner")).alias("base"))
    return back.join(bases, ["file", "segment"]).select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
