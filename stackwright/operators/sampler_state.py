"""State of the importance sampler: one row per image and domain point of the latest generation.

Generations are tables; a commit is a latest-wins union, so a failed iteration changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stackwright.operators.pairs import fisher_density
from stackwright.operators.probability import posterior


def record_update(samples: DataFrame, temperature: float = 1.0, log: bool = False) -> DataFrame:
    """(image, point, p): posterior values at sampled points (image, point, value, weight), freed of the weights they
    were sampled with, tempered and normalised per image. log: value is a logarithm."""
    value = F.col("value") if log else F.ln(F.abs("value"))
    rows = samples.select("image", "point", ((value - F.ln("weight")) / temperature).alias("_e"))
    return posterior(rows, "_e", ["image"]).select("image", "point", "p")


def commit(state: DataFrame, updates: DataFrame) -> DataFrame:
    """Images with an update have it instead of what the state held."""
    kept = state.join(updates.select("image").distinct(), "image", "left_anti")
    return kept.unionByName(updates)


def global_distribution(state: DataFrame, points: DataFrame, uniform: float = 1.0, test_images: DataFrame | None = None) -> DataFrame:
    """(point, p) over all points: a uniform mass and the sum over images, without the test images."""
    if test_images is not None:
        state = state.join(test_images.select("image"), "image", "left_anti")
    sums = state.groupBy("point").agg(F.sum("p").alias("s"))
    share = F.lit(uniform) / F.count(F.lit(1)).over(W.partitionBy())
    mass = points.join(sums, "point", "left").select("point", (F.coalesce("s", F.lit(0.0)) + share).alias("m"))
    return mass.crossJoin(F.broadcast(mass.agg(F.sum("m").alias("_t")))).select("point", (F.col("m") / F.col("_t")).alias("p"))


def refine(distribution: DataFrame, old_points: DataFrame, new_points: DataFrame, kappa: float) -> DataFrame:
    """(id, p): a distribution over old directions carried to new ones by the Fisher kernel."""
    samples = old_points.join(distribution.withColumnRenamed("point", "id"), "id").withColumnRenamed("p", "w")
    return fisher_density(new_points, samples, kappa)


def product_domain(slices: DataFrame, turns: DataFrame) -> DataFrame:
    """(point, slice, turn, weight): every direction with every in-plane turn, numbered turn by turn."""
    n = turns.count()
    both = slices.select(F.col("i").alias("slice"), F.col("weight").alias("ws")).crossJoin(F.broadcast(turns.select(F.col("i").alias("turn"), F.col("weight").alias("wt"))))
    return both.select((F.col("slice") * n + F.col("turn")).alias("point"), "slice", "turn", (F.col("ws") * F.col("wt")).alias("weight"))


def marginals(state: DataFrame, turns: int) -> tuple[DataFrame, DataFrame]:
    """Distributions over slices and over turns of a distribution over their product."""
    by_slice = state.groupBy("image", F.floor(F.col("point") / turns).alias("slice")).agg(F.sum("p").alias("p"))
    by_turn = state.groupBy("image", (F.col("point") % turns).alias("turn")).agg(F.sum("p").alias("p"))
    return by_slice, by_turn


def coverage(state: DataFrame) -> DataFrame:
    """(image, share): how many of an image's points have mass."""
    return state.groupBy("image").agg(F.avg((F.col("p") > 0).cast("double")).alias("share"))
