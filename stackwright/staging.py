"""The folder that driver and executors share, and tables staged in it.

A staged table cuts the lineage and survives lost executors. It stays until `clear` is called, for a plan that is not run
yet may read it; jobs call it when their output is written.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_STAGED: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. A temporary one only where none is named and the executors are the
    driver, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        named = _OWN[app] = _OWN.get(app) or "file://" + tempfile.mkdtemp(prefix="stackwright-")
    return named.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/stackwright/{tag}-{uuid.uuid4().hex}"


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write df into the shared folder and read it again."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    _STAGED.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete the tables staged in this session; no plan over them can run afterwards."""
    for path in _STAGED.pop(spark.sparkContext.applicationId, []):
        delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Delete on leaving what was staged inside: for jobs that have written their output by then."""
    staged = _STAGED.setdefault(spark.sparkContext.applicationId, [])
    before = len(staged)
    try:
        yield
    finally:
        while len(staged) > before:
            delete(spark, staged.pop())
