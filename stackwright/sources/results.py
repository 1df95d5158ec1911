"""A stream of the files of running experiments: what is new in a folder, and what was written anew.

A run writes its results again and again under the same names. Spark's file stream takes every name once; this source takes
a file whenever its time of modification is another than when it was last taken, so a monitor sees each version that
stood when it looked. The offset is the table of names and times, a line for each file of the runs that are watched; it lies in
the query's checkpoint, so a monitor that starts again goes on where it stopped.
"""

from __future__ import annotations

import fnmatch
import os

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition


class _File(InputPartition):
    def __init__(self, path: str, name: str, modified: int):
        self.path, self.name, self.modified = path, name, modified


class _Reader(DataSourceStreamReader):
    def __init__(self, path: str, pattern: str):
        self.path, self.pattern = path.removeprefix("file://"), pattern

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        """Every file that is there whole: names that begin with a dot or an underscore are still being written."""
        found = {}
        for folder, inner, files in os.walk(self.path):
            inner[:] = [d for d in inner if d[0] not in "._"]
            for name in files:
                if name[0] not in "._" and fnmatch.fnmatch(name, self.pattern):
                    full = os.path.join(folder, name)
                    try:
                        found[os.path.relpath(full, self.path)] = str(os.stat(full).st_mtime_ns)
                    except FileNotFoundError:  # replaced while we looked: the next look finds it
                        continue
        return found

    def partitions(self, start: dict, end: dict) -> list[_File]:
        return [_File(os.path.join(self.path, n), n, int(t)) for n, t in sorted(end.items()) if start.get(n) != t]

    def read(self, part: _File):
        with open(part.path, "rb") as f:
            yield part.name, part.modified, f.read()

    def commit(self, end: dict) -> None:
        pass


class ResultsDataSource(DataSource):
    """spark.readStream.format("results").load(folder): (file, modified, content). option pattern: which names. The folder must be
    open to driver and executors by its path; a file fits a row."""

    @classmethod
    def name(cls):
        return "results"

    def schema(self):
        return "file string, modified bigint, content binary"

    def streamReader(self, schema):  # noqa: N802
        return _Reader(self.options["path"], self.options.get("pattern", "*"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ResultsDataSource)
