"""Statistics of a run as appended tables, and the views over them."""

from __future__ import annotations

import json
import subprocess
import threading
import time
from collections import deque
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stackwright.operators import sequence


def append(spark: SparkSession, path: str, rows: list[dict]) -> None:
    """Time series grow by appended files; a row is a dict of numbers and strings."""
    spark.createDataFrame(rows).write.mode("append").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(path)


def series(stat: DataFrame, x: str, y: str, smooth: int = 1) -> DataFrame:
    """(x, y) in order of x, with a moving average if wanted."""
    rows = stat.select(x, y).where(F.col(y).isNotNull())
    return rows if smooth <= 1 else sequence.moving_average(rows, y, smooth, [], [x], y)


def dataset_size(batches: DataFrame, size: int) -> DataFrame:
    """(n): the batches of the first epoch times their size."""
    return batches.agg((F.count_if(F.col("epoch") == 0) * size).alias("n"))


def sampling_speedups(stat: DataFrame, dataset: str, x: str = "iteration") -> DataFrame:
    """(x, name, value): how many times fewer points than the domain's were evaluated, for each domain."""
    prefix = f"{dataset}_is_speedup_"
    return by_prefix(stat, prefix, [x]).select(x, F.regexp_replace("name", f"^{prefix}", "").alias("name"), "value")


def likelihood_quantiles(stat: DataFrame, dataset: str, x: str = "iteration") -> DataFrame:
    """(x, percent, full, mini): quantiles over all images seen and over the minibatch, a row for each."""
    both = F.arrays_zip(F.col(f"{dataset}_full_like_quantiles").alias("full"), F.col(f"{dataset}_mini_like_quantiles").alias("mini"))
    return stat.select(x, F.posexplode(both).alias("percent", "q")).select(x, "percent", "q.full", "q.mini")


def save_latest(spark: SparkSession, path: str, rows: list[dict]) -> None:
    """State of which the last value alone counts: a new version is written whole and then named as current,
    so a reader sees the old one or the new one."""
    version = f"{path}/{time.time_ns():020d}"
    spark.createDataFrame(rows).write.parquet(version)
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("append").parquet(f"{path}/versions")


def load_latest(spark: SparkSession, path: str) -> DataFrame:
    version = spark.read.parquet(f"{path}/versions").agg(F.max("version")).first()[0]
    return spark.read.parquet(version)


def newer_files(spark: SparkSession, path: str, since: datetime) -> DataFrame:
    """(path, modificationTime, length) of the files written after a moment, in any store that Spark lists."""
    files = spark.read.format("binaryFile").option("modifiedAfter", since.strftime("%Y-%m-%dT%H:%M:%S")).load(path)
    return files.select("path", "modificationTime", "length")


class Background:
    """Calls `turn` until it returns False, in a thread of its own, which can be paused. Results go to `sink`
    in a second thread, one after the other. At most `most` of them wait: a slow sink holds the turns back. An error in
    the sink ends the turns; an error in either is raised by `end`."""

    def __init__(self, turn: Callable[[], object], sink: Callable[[object], None] | None = None, most: int = 4):
        self.turn, self.sink = turn, sink
        self.going, self.stopped = threading.Event(), False
        # one thread each: what is handed to the sink stays in order
        self.pool, self.saver = ThreadPoolExecutor(1), ThreadPoolExecutor(1)
        self.jobs: deque[Future] = deque()
        self.room = threading.Semaphore(most)

    def begin(self) -> None:
        self.going.set()
        self.loop = self.pool.submit(self._run)

    def _run(self) -> None:
        while not self.stopped:
            self.going.wait()
            found = None if self.stopped else self.turn()
            if found is False or found is None:
                return
            if self.sink:
                self.room.acquire()
                while self.jobs and self.jobs[0].done():
                    self.jobs.popleft().result()  # raises what the sink raised
                self.jobs.append(self.saver.submit(self._save, found))

    def _save(self, found: object) -> None:
        try:
            self.sink(found)
        finally:
            self.room.release()

    def pause(self) -> None:
        self.going.clear()

    def resume(self) -> None:
        self.going.set()

    def end(self, wait: bool = True) -> None:
        """Wait for the last turn (wait: for all turns) and for what was handed to the sink."""
        self.stopped = not wait
        self.going.set()
        self.loop.result()
        for job in self.jobs:
            job.result()
        self.pool.shutdown()
        self.saver.shutdown()


def by_prefix(stat: DataFrame, prefix: str, keys: list[str]) -> DataFrame:
    """Columns whose names share a prefix, as (keys, name, value)."""
    names = [c for c in stat.columns if c.startswith(prefix)]
    return stat.unpivot(keys, names, "name", "value")


def parameters(defaults: dict, *files: str, overrides: dict | None = None) -> dict:
    """JSON files laid over the defaults, later ones first; nothing is evaluated as code."""
    out = dict(defaults)
    for name in files:
        with open(name) as f:
            out |= json.load(f)
    return out | (overrides or {})


def typed(defaults: dict, values: dict) -> dict:
    """The defaults with the values laid over them: unknown names and values of another type are errors, so a
    parameter has one default and one type wherever it is read."""
    for k, v in values.items():
        if k not in defaults:
            raise KeyError(f"unknown parameter {k!r}")
        if defaults[k] is not None and not isinstance(v, (int, float) if isinstance(defaults[k], float) else type(defaults[k])):
            raise TypeError(f"parameter {k!r} is {type(v).__name__}, not {type(defaults[k]).__name__}")
    return defaults | values


def key_values(arguments: list[str]) -> dict:
    """key=value arguments; values are JSON where they can be read as such."""
    out = {}
    for a in arguments:
        k, _, v = a.partition("=")
        try:
            out[k] = json.loads(v)
        except ValueError:
            out[k] = v
    return out


def schedule(spark: SparkSession, expressions: dict[str, str], variables: dict) -> dict:
    """Parameters given as SQL expressions over the run's variables (epoch, iteration, ...)."""
    row = spark.createDataFrame([variables]).select(*[F.expr(e).alias(k) for k, e in expressions.items()]).first()
    return row.asDict()


def revision() -> str:
    try:
        return subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, check=True).stdout.strip()
    except (OSError, subprocess.CalledProcessError):
        return "unknown"


def append_log(rows: DataFrame, path: str, at: str, line: Column) -> None:
    """Append a line for each row to a text log, with a number that orders the log; tasks write side by side."""
    text = F.concat_ws("\t", F.lpad(F.col(at).cast("string"), 20, "0"), F.regexp_replace(line, "[\r\n]", " "))
    rows.select(text.alias("value")).sortWithinPartitions("value").write.mode("append").text(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(at, line) of a log."""
    cut = F.instr("value", "\t")
    return spark.read.text(path).select(F.left("value", cut - 1).cast("long").alias("at"), F.substring(F.col("value"), cut + 1, F.length("value")).alias("line"))
