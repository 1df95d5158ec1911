"""Running sums of what the expectation step finds at each frequency, and the noise and envelope that follow from them.

A history is a table with a row per run, generation, minibatch and frequency: (run, gen, batch, x, y, error, corr, power, mask). The
latest generation of a minibatch counts. Generations are appended, so a turn that fails changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackwright.operators import likelihood, radial

SUMS = ("error", "corr", "power", "mask")


def means(history: DataFrame) -> DataFrame:
    """(run, x, y, error, corr, power, mask, batches): the mean over minibatches of their latest generation, and how many there
    are. Two aggregations with partial sums."""
    latest = history.groupBy("run", "batch", "x", "y").agg(F.max_by(F.struct(*SUMS), "gen").alias("s"))
    return latest.groupBy("run", "x", "y").agg(*[F.avg(f"s.{k}").alias(k) for k in SUMS], F.count(F.lit(1)).alias("batches"))


def rotationally(found: DataFrame, n: int) -> DataFrame:
    """The same with every sum averaged over rings and laid back; the mask is added up over rings, for a ring is seen as
    often as its frequencies together."""
    rows = found.select("run", "x", "y", "batches")
    for name in SUMS:
        profile = radial.radial_average(found.withColumn("v", F.col(name)), "run", n)
        profile = profile.select("run", "bin", F.col("total" if name == "mask" else "mean").alias("mean"))
        rows = radial.expand_profile(profile, rows, "run", 2).withColumnRenamed("v", name)
    return rows


def noise_and_envelope(history: DataFrame, n: int, images: float, base_variance: float, noise_prior: float, envelope_prior: float, expected: Column | None = None, low: float | None = None, high: float | None = None, fixed: Column | None = None, white: bool = False, rotational: bool = True) -> DataFrame:
    """(run, x, y, noise, envelope) for the next generation. images: of a minibatch. The noise is drawn to the base variance
    as by noise_prior observations, one value a run if white; the envelope to the expected one (a column over x and
    y; 1 if none). fixed: where the envelope is 1; low, high: its bounds."""
    found = means(history)
    found = rotationally(found, n) if rotational else found
    rows = likelihood.noise_map(found.withColumn("sigma2", F.col("error")), noise_prior, base_variance, F.col("batches") * images)
    if white:
        rows = rows.drop("noise").join(likelihood.white(rows, "noise", ["run"]), "run")
    rows = likelihood.envelope_map(rows, envelope_prior, F.col("batches") * images, expected, low, high, fixed)
    return rows.select("run", "x", "y", "noise", "envelope")
