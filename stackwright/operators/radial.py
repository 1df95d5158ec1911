"""Averages over circles and shells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stackwright.operators.grid import explode_array, radius2


def default_bins(n: int, dims: int) -> int:
    return math.ceil(math.sqrt(dims) * n / dims)


def radial_average(cells: DataFrame, key: str, n: int, dims: int = 2, bins: int | None = None, value: Column | None = None) -> DataFrame:
    """(key, bin, total, weight, mean): each cell is split linearly between the two bins around its
    radius; cells whose upper bin is out of range are left out; empty bins give mean 0. One partial and
    one final aggregation, whatever the number of images."""
    bins = bins or default_bins(n, dims)
    r = F.sqrt(radius2(dims).cast("double"))
    low = F.floor(r)
    part = r - low
    rows = cells.where(low + 1 < bins).select(key, (value if value is not None else F.col("v")).alias("v"), F.inline(F.array(F.struct(low.cast("int").alias("bin"), (1 - part).alias("w")), F.struct((low + 1).cast("int").alias("bin"), part.alias("w")))))
    sums = rows.groupBy(key, "bin").agg(F.sum(F.col("w") * F.col("v")).alias("total"), F.sum("w").alias("weight"))
    return sums.withColumn("mean", F.coalesce(F.try_divide("total", "weight"), F.lit(0.0)))


def radial_average_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    cells = explode_array(images, "embedding", 8, 2, ["vec_id"])
    return radial_average(cells, "vec_id", 8).select("vec_id", "bin", F.round("mean", 6).alias("mean"))


def expand_profile(profile: DataFrame, cells: DataFrame, key: str, dims: int) -> DataFrame:
    """A radial profile (key, bin, mean) laid back on the grid, linear between bins, the last bin beyond."""
    r = F.sqrt(radius2(dims).cast("double"))
    # a profile is one short array per image, so cells need one join and no look-up by bin
    line = profile.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "mean"))), lambda s: s["mean"]).alias("_line"))
    at = cells.join(line, key).withColumn("_lo", F.least(F.floor(r).cast("int"), F.size("_line") - 1))
    f, high = r - F.floor(r), F.least(F.col("_lo") + 1, F.size("_line") - 1)
    return at.withColumn("v", (1 - f) * F.get("_line", F.col("_lo")) + f * F.get("_line", high)).drop("_line", "_lo")


def shell_correlation(pairs: DataFrame, key: str, dims: int, shells: int) -> DataFrame:
    """(key, shell, fsc) of cells with columns v1, v2: shells of width 1 whose first edge is 1.5."""
    shell = F.greatest(F.floor(F.sqrt(radius2(dims).cast("double")) - 0.5), F.lit(0)).cast("int")
    sums = pairs.withColumn("shell", shell).where(F.col("shell") < shells).groupBy(key, "shell").agg(F.sum(F.col("v1") * F.col("v2")).alias("c"), F.sum(F.col("v1") * F.col("v1")).alias("a"), F.sum(F.col("v2") * F.col("v2")).alias("b"))
    return sums.select(key, "shell", F.try_divide(F.col("c"), F.sqrt(F.col("a") * F.col("b"))).alias("fsc"))


def shell_resolution(fsc: DataFrame, key: str, threshold: float) -> DataFrame:
    """(key, radius) where the curve first falls below the threshold, linear between shells; the last
    shell's edge if it never does, infinity if the first shell is below already."""
    before = W.partitionBy(key).orderBy("shell")
    edge = F.col("shell") + 1.5
    steps = fsc.select(key, "shell", "fsc", F.lag("fsc").over(before).alias("previous"))
    cross = edge - 1 + (F.col("previous") - threshold) / (F.col("previous") - F.col("fsc"))
    place = F.when(F.col("fsc") < threshold, F.when(F.col("previous").isNull(), F.lit(float("inf"))).otherwise(cross))
    first = F.min_by(place, F.when(F.col("fsc") < threshold, F.col("shell")))
    return steps.groupBy(key).agg(F.coalesce(first, F.max(edge)).alias("radius"))
