"""What the corpus operators share: the shared folder, staged tables, Arrow helpers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's setting that removes a query's shuffle files when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: A-Z and a-z for F.translate: contracts lower ASCII letters only.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A temporary one only where none is named and the
    executors are the driver, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        named = _OWN[app] = _OWN.get(app) or "file://" + tempfile.mkdtemp(prefix="stackwright-")
    return named.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/stackwright/{tag}-{uuid.uuid4().hex}"


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: cuts the lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, tag)
    conf, before = df.sparkSession.conf, df.sparkSession.conf.get(CLEANUP, None)
    if before is not None:
        conf.set(CLEANUP, "true")  # nothing reads this write's shuffle files again
    try:
        df.write.parquet(path)
    finally:
        if before is not None:
            conf.set(CLEANUP, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def drop(*staged: DataFrame) -> None:
    """Delete staged tables that no later plan reads."""
    for df in staged:
        delete_path(df.sparkSession, df._staged_at)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def free_name(columns: list[str], base: str) -> str:
    """A name that starts with base and starts no column's name."""
    while any(c.lower().startswith(base.lower()) for c in columns):
        base += "_"
    return base


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as text, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def unit_hash(*cols: Column) -> Column:
    """A stable pseudo-random number in [0, 1) from the columns."""
    return F.pmod(F.xxhash64(*cols), F.lit(1_000_003)) / F.lit(1_000_003.0)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch; null reads as empty."""
    return ["" if x is None else x for x in batch.column(name).to_pylist()]


def bytes_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The texts of a batch as UTF-8; null reads as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def tidy(work):
    """An Arrow task that gives the memory it no longer uses back to the machine when it ends: workers are kept for
    other tasks, and what each holds back adds up beside the JVM."""

    @wraps(work)
    def run(batches):
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return run


def list_array(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


def groups_of(sizes: list[int], most: int):
    """Index ranges whose sizes add up to about `most`, at least one item each: bounds working memory."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)
