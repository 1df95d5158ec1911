"""Token counts with the tokenizers library: overlap resynchronisation for huge documents.

Documents up to `whole` characters are encoded where they are read, each distinct piece between stable
boundaries once. Longer ones are cut into chunks that overlap by `margin` characters on both sides; each chunk is a row of its own, so one huge document
spreads over many tasks. Neighbouring chunks are spliced at the first stable boundary at or after
their border: a single space between two non-space characters, at which the pre-tokenizer always
starts a token whatever stands before or after. Both neighbours find the same place, and each checks
with its own offsets that a token starts there. Where the overlap holds no such place, the document is
encoded again with overlaps eight times as wide, and in the end whole.

Null and empty texts have 0 bytes and 0 tokens. Texts of any length are counted whole. Repeated rows, and
rows without doc_id, are counted each on its own. A table without rows gives none. Other columns are not
looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackwright.llm.common import groups_of, stage, texts_of
from stackwright.llm.tokenfile import library, library_pieces

WHOLE, CHUNK, MARGIN = 32_768, 16_384, 256
GROUP_CHARS = 2_000_000
STABLE = regex.compile(r"(?<=\P{White_Space}) (?=\P{White_Space})")
#: A special token must not be cut: its text has no space, so a stable boundary never lies inside it.


def count_chunk(tok, text: str, left: int, right: int, first: bool, last: bool) -> int | None:
    """Tokens of the chunk between its splices. left, right: where its borders lie in the text.
    None if a border has no stable boundary in the overlap."""
    begin, end = 0, len(text)
    if not first:
        m = STABLE.search(text, max(1, left), len(text))
        if m is None or m.start() >= 2 * left - 1:
            return None
        begin = m.start()
    if not last:
        m = STABLE.search(text, max(1, right))
        if m is None or m.start() >= len(text) - 1:
            return None
        end = m.start()
    starts = np.array([a for a, _ in tok.encode(text, add_special_tokens=False).offsets], np.int64)
    if begin and not (starts == begin).any() or end < len(text) and not (starts == end).any():
        return None
    return int(((starts >= begin) & (starts < end)).sum())


def _library_counts(df: DataFrame, tokenizer: str) -> DataFrame:
    def work(batches):
        pieces = library_pieces(tokenizer)
        for batch in batches:
            texts, rest = texts_of(batch), [batch.column(n) for n in ("doc_id", "n_bytes")]
            for a, b in groups_of([len(t) for t in texts], GROUP_CHARS):
                _, counts = pieces.encode(texts[a:b])
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in rest), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return df.mapInArrow(work, "doc_id long, n_bytes long, n_tokens long")


def _chunk_counts(df: DataFrame, tokenizer: str) -> DataFrame:
    def work(batches):
        tok = library(tokenizer)
        for batch in batches:
            texts = texts_of(batch)
            lefts, rights, firsts, lasts = (batch.column(n).to_pylist() for n in ("left", "right", "first", "last"))
            counts = [count_chunk(tok, *x) for x in zip(texts, lefts, rights, firsts, lasts, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("doc_id", "n_bytes", "text_key", "nth")), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "text_key", "nth", "n"])

    return df.mapInArrow(work, "doc_id long, n_bytes long, text_key long, nth long, n long")


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512, whole: int = WHOLE, chunk: int = CHUNK, margin: int = MARGIN) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each text."""
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    n_chars = F.length("text")
    parts = [_library_counts(rows.where(n_chars <= whole), tokenizer)]
    pending = rows.where(n_chars > whole).withColumn("text_key", F.xxhash64("text"))
    while True:
        # overlaps of at most half a chunk; a document that is one chunk has no border
        last = F.ceil(n_chars / F.lit(chunk)) - 1
        nth = F.explode(F.sequence(F.lit(0).cast("long"), last))
        cut = pending.select("doc_id", "n_bytes", "text_key", "text", last.alias("n_last"), nth.alias("nth"))
        start = F.greatest(F.col("nth") * chunk - margin, F.lit(0))
        stop = F.least((F.col("nth") + 1) * chunk + margin, n_chars)
        pieces = cut.select(
            "doc_id", "n_bytes", "text_key", "nth",
            F.substring(F.col("text"), start.cast("int") + 1, (stop - start).cast("int")).alias("text"),
            (F.col("nth") * chunk - start).cast("int").alias("left"),
            ((F.col("nth") + 1) * chunk - start).cast("int").alias("right"),
            (F.col("nth") == 0).alias("first"), (F.col("nth") == F.col("n_last")).alias("last"),
        )
        counted = _chunk_counts(pieces.repartition("doc_id", "nth"), tokenizer)
        # equal rows share a key: each has one chunk 0, so that counts them
        sums = counted.groupBy("doc_id", "n_bytes", "text_key").agg(F.sum("n").alias("n"), F.count_if(F.col("nth") == 0).alias("copies"), F.count_if(F.col("n").isNull()).alias("bad"))
        sums = stage(sums, "token-chunks")
        done = sums.where("bad = 0").select("doc_id", "n_bytes", F.expr("n div copies").alias("n_tokens"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy"))
        parts.append(done.drop("_copy"))
        redo = sums.where("bad > 0")
        if redo.isEmpty():
            break
        keys = redo.select(F.col("doc_id").alias("_d"), F.col("n_bytes").alias("_b"), F.col("text_key").alias("_k"))
        pending = pending.join(keys, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("n_bytes") == F.col("_b")) & (F.col("text_key") == F.col("_k")), "left_semi")
        chunk, margin = chunk * 8, margin * 8
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
