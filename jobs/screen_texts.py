"""Screen the texts that come in with a project's data: notes, logs, annotations.

    python -m jobs.screen_texts --input 'texts/*.parquet' --output screened --checkpoint screened_log

Each run takes the files that are new since the last one, in micro-batches of bounded size; Spark's stream log in `checkpoint`
is the mark. Every text is measured (characters, words, lines, a digest), and a text is marked as unusual
if its number of words lies further from its group's median than `bound` scaled median deviations: the
robust statistic that image stacks are screened by.

Writes, all as Parquet:
  records/part=.../batch=k   one row a text with its measures, in partitions by source and micro-batch
  counts/batch=k             how many texts of each group have how many words
  series/batch=k             sums by source: texts, characters, words, lines
  bounds                     (group, mean, std, n) over all texts so far, made anew by each run that finds new texts

Medians are exact, for the counts of distinct values of all batches add up. A micro-batch that is
repeated after a failure replaces its own partitions, so every file counts once; a run that finds nothing new
changes nothing. Output and checkpoint belong together: remove both or none. Each row that comes in is a text of its own, also
if its id came before. Null texts have 0 characters, words and lines. A null group or source is a group like
others; rows with a null or empty source are in the partition part=none.
"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command_line
from stackwright.functions.text import n_lines, n_words
from stackwright.operators import robust
from stackwright.staging import scope

LOG = logging.getLogger("jobs.screen_texts")
MEASURES = "n_chars long, n_words long, n_lines long, text_md5 string"


def run(spark: SparkSession, input: str, output: str, checkpoint: str, group_column: str, part_column: str, files_per_batch: int, writers_per_part: int, bound: float) -> dict:
    """The job; returns how many micro-batches and texts were new."""
    wanted = f"doc_id long, text string, {group_column} string, {part_column} string"
    stream = spark.readStream.schema(wanted).option("maxFilesPerTrigger", files_per_batch).parquet(input)
    done = {"batches": 0, "texts": 0}

    def take(batch: DataFrame, number: int) -> None:
        text = F.coalesce("text", F.lit(""))
        measured = batch.select(
            "doc_id", F.col(group_column), F.col(part_column), F.length(text).cast("long").alias("n_chars"), n_words(text).cast("long").alias("n_words"), n_lines(text).cast("long").alias("n_lines"),
            F.md5(text.cast("binary")).alias("text_md5"), F.coalesce(F.nullif(F.col(part_column), F.lit("")), F.lit("none")).alias("part"), F.lit(number).cast("long").alias("batch"),
        )
        # a hot source is spread over several writers; each source has at most so many files a batch
        spread = measured.repartition("part", F.pmod(F.xxhash64("doc_id"), F.lit(writers_per_part)))
        replace(spread, f"{output}/records", "part", "batch")
        mine = read_records(batch.sparkSession, output, group_column, part_column).where(F.col("batch") == number)
        replace(mine.groupBy("batch", group_column, "n_words").agg(F.count(F.lit(1)).alias("times")), f"{output}/counts", "batch")
        sums = mine.groupBy("batch", part_column).agg(F.count(F.lit(1)).alias("texts"), *[F.sum(f"n_{x}").alias(x) for x in ("chars", "words", "lines")])
        replace(sums, f"{output}/series", "batch")
        n = batch.sparkSession.read.schema("batch long, texts long").parquet(f"{output}/series").where(F.col("batch") == number).agg(F.sum("texts")).first()[0] or 0
        LOG.info("batch %d: read %d texts of %s, wrote their measures to %s/records", number, n, input, output)
        done["batches"] += 1
        done["texts"] += n

    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if done["batches"]:
        with scope(spark):
            counts = spark.read.schema(f"batch long, {group_column} string, n_words long, times long").parquet(f"{output}/counts")
            found = robust.mean_std(counts, "n_words", [group_column], weight="times")
            found.withColumn("bound", F.lit(bound)).write.mode("overwrite").parquet(f"{output}/bounds")
        LOG.info("wrote bounds of all groups to %s/bounds", output)
    else:
        LOG.info("nothing new in %s", input)
    return done


def replace(rows: DataFrame, path: str, *partitions: str) -> None:
    """Write rows in place of the partitions that they belong to."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def read_records(spark: SparkSession, output: str, group_column: str, part_column: str) -> DataFrame:
    return spark.read.schema(f"doc_id long, {group_column} string, {part_column} string, {MEASURES}, part string, batch long").parquet(f"{output}/records")


def screened(spark: SparkSession, output: str, group_column: str = "lang", part_column: str = "source") -> DataFrame:
    """All texts so far with their group's median, deviation and whether they are unusual."""
    records = read_records(spark, output, group_column, part_column)
    bounds = spark.read.parquet(f"{output}/bounds").select(F.col(group_column).alias("_group"), "mean", "std", "bound")
    unusual = F.abs(F.col("n_words") - F.col("mean")) > F.col("bound") * F.col("std")
    return records.join(bounds, F.col(group_column).eqNullSafe(F.col("_group"))).withColumn("unusual", unusual).drop("_group", "bound")


def arguments() -> argparse.ArgumentParser:
    spec = argparse.ArgumentParser(prog="screen_texts", description=__doc__.splitlines()[0])
    for name, kind in {"input": str, "output": str, "checkpoint": str, "group_column": str, "part_column": str, "files_per_batch": int, "writers_per_part": int, "bound": float}.items():
        spec.add_argument(f"--{name}", type=kind)
    return spec


if __name__ == "__main__":
    command_line(run, arguments())
