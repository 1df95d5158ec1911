"""Means, scales and noise statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stackwright.operators.grid import radius2
from stackwright.operators.pairs import look_up
from stackwright.operators.sequence import order_statistics, share_of_quantile, value_counts

#: Scales a median absolute deviation to a standard deviation of a normal distribution (fixed value).
MAD_TO_STD = 1.4826


def mean_std(df: DataFrame, value: str, keys: list[str], kind: str = "robust", weight: str | None = None) -> DataFrame:
    """(keys, mean, std, n): median and scaled MAD, or mean and population standard deviation, of the values that are
    not null, and their number. The robust kind reads the rows once: the deviations come from the counts of
    distinct values. weight (robust): a column with how often each row counts."""
    if kind == "mle":
        return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("n"))
    counts = value_counts(df, value, keys, weight)
    part = share_of_quantile(0.5)
    middle = counts.where(part > 0).groupBy(*keys).agg(F.sum(part * F.col(value)).alias("mean"), F.max("_all").alias("n"))
    renamed = middle.select(*[F.col(k).alias(f"_m{i}") for i, k in enumerate(keys)], "mean", "n")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_m{i}"))
    off = counts.join(renamed if keys else F.broadcast(renamed), same).select(*keys, "mean", "n", F.abs(F.col(value) - F.col("mean")).alias("off"), F.col("_n").alias("_times"))
    return median(off, "off", [*keys, "mean", "n"], "std", "_times").select(*keys, "mean", (MAD_TO_STD * F.col("std")).alias("std"), "n")


def median(df: DataFrame, value: str, keys: list[str], out: str, weight: str | None = None) -> DataFrame:
    """(keys, out): the exact median."""
    return order_statistics(df, value, keys, [0.5], weight).select(*keys, F.col("quantile").alias(out))


def dc_observations(means: DataFrame, responses: DataFrame, key: str, n: int) -> DataFrame:
    """(dc): each image's mean (key, mean) times sqrt(n), over its optics' response at frequency 0 (key, dc),
    which is computed once for each optics and looked up."""
    return look_up(means, responses, key).select((F.col("mean") * math.sqrt(n) / F.col("dc")).alias("dc"))


def dc_estimate(observations: DataFrame, kind: str = "robust") -> DataFrame:
    """(mean, std, error) of the observations: one row, which a run keeps for later."""
    return mean_std(observations, "dc", [], kind).withColumn("error", F.col("std") / F.sqrt("n")).drop("n")


def scale_images(cells: DataFrame, factor: float) -> DataFrame:
    return cells.withColumn("v", F.col("v") * factor)


def clamp(cells: DataFrame, low: float, high: float, scale: float = 1.0) -> DataFrame:
    """Values held within bounds that are given in units of the scale."""
    return cells.withColumn("v", F.least(F.greatest("v", F.lit(low * scale)), F.lit(high * scale)))


def to_mass(cells: DataFrame, keys: list[str], mass: float = 1.0) -> DataFrame:
    """Negative values become 0, and each volume's sum the mass."""
    rows = cells.withColumn("v", F.greatest("v", F.lit(0.0)))
    return rows.withColumn("v", F.try_divide(F.col("v") * mass, F.sum("v").over(W.partitionBy(*keys))))


def corners(n: int, rad: float) -> Column:
    """Cells outside the radius rad * n / 2 - 1.5."""
    return radius2(2) > (rad * n / 2 - 1.5) ** 2


def float_images(cells: DataFrame, key: str, n: int, rad: float = 0.99) -> DataFrame:
    """Subtract each image's mean corner value; adds corner_mean."""
    mean = F.avg(F.when(corners(n, rad), F.col("v"))).over(W.partitionBy(key))
    return cells.withColumn("corner_mean", mean).withColumn("v", F.col("v") - F.col("corner_mean"))


def window_images(cells: DataFrame, n: int, rad: float = 0.99) -> DataFrame:
    """Corner cells become 0."""
    return cells.withColumn("v", F.when(corners(n, rad), F.lit(0.0)).otherwise(F.col("v")))


def data_variance(cells: DataFrame, key: str) -> DataFrame:
    """The mean over images of the mean square."""
    return cells.groupBy(key).agg(F.avg(F.col("v") * F.col("v")).alias("p")).agg(F.avg("p").alias("variance"))


def noise_variance(cells: DataFrame, n: int, kind: str = "robust", centred: bool = False, rad: float = 1.0) -> DataFrame:
    """Variance of the corner cells. robust: the scaled median of |v|, about the median if centred."""
    rows = cells.where(corners(n, rad))
    if kind == "mle":
        out = F.var_pop("v") if centred else F.avg(F.col("v") * F.col("v"))
        return rows.agg(out.alias("variance"))
    if centred:
        return mean_std(rows, "v", []).select((F.col("std") * F.col("std")).alias("variance"))
    scale = MAD_TO_STD * F.col("off")
    return median(rows.select(F.abs("v").alias("off")), "off", [], "off").select((scale * scale).alias("variance"))


def snr(data: DataFrame, noise: DataFrame) -> DataFrame:
    """(data, noise, signal, percent, decibel): signal is what the noise does not explain."""
    both = data.select(F.col("variance").alias("data")).crossJoin(noise.select(F.col("variance").alias("noise")))
    both = both.withColumn("signal", F.col("data") - F.col("noise"))
    ratio = F.try_divide("signal", "noise")
    return both.withColumns({"percent": 100 * ratio, "decibel": F.when(ratio > 0, 10 * F.log10(ratio))})


def normalise(cells: DataFrame, noise: DataFrame) -> DataFrame:
    """Divide by the noise's standard deviation."""
    return cells.crossJoin(F.broadcast(noise.select(F.sqrt("variance").alias("_s")))).withColumn("v", F.try_divide("v", "_s")).drop("_s")


def data_sign(estimate: DataFrame) -> DataFrame:
    """1 or -1 if the mean is two standard errors from 0, else 0."""
    return estimate.withColumn("sign", F.when(F.col("mean") > 2 * F.col("error"), 1).when(F.col("mean") < -2 * F.col("error"), -1).otherwise(0))


def density_stats(cells: DataFrame, keys: list[str]) -> DataFrame:
    return cells.groupBy(*keys).agg(F.sum("v").alias("total"), F.count_if(F.col("v") == 0).alias("zeros"), F.avg("v").alias("mean"), F.max("v").alias("most"), F.min("v").alias("least"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))


def quantiles(df: DataFrame, value: str, parts: int = 100) -> DataFrame:
    """Exact quantiles of the finite values: (percent, quantile)."""
    finite = df.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")))
    found = order_statistics(finite, value, [], [i / parts for i in range(parts + 1)])
    return found.select(F.round(F.col("level") * parts).cast("int").alias("percent"), "quantile")


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n): equal bins over [low, high], the last closed above."""
    at = F.least(F.floor((F.col(value) - low) / (high - low) * bins), F.lit(bins - 1))
    return df.where(F.col(value).between(low, high)).groupBy(at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def moments(cells: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Centre of mass and covariance weighted by the square of the value, in one pass over sums. The
    covariance is over n**3, the number of cells of a volume."""
    w = F.col("v") * F.col("v")
    axes = "xyz"
    sums = cells.groupBy(*keys).agg(F.sum(w).alias("w"), *[F.sum(w * F.col(a)).alias(a) for a in axes], *[F.sum(w * F.col(a) * F.col(b)).alias(a + b) for i, a in enumerate(axes) for b in axes[i:]])
    mean = {f"m{a}": F.try_divide(F.col(a), F.col("w")) for a in axes}
    cov = {f"c{a}{b}": (F.try_divide(F.col(a + b), F.col("w")) - mean[f"m{a}"] * mean[f"m{b}"]) / n**3 for i, a in enumerate(axes) for b in axes[i:]}
    return sums.select(*keys, *[c.alias(k) for k, c in (mean | cov).items()])


def update_norms(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, step_size, grad_size, norm_density, inc_ratio) of cells with the value before, after and the
    gradient."""
    norms = cells.groupBy(*keys).agg(F.sqrt(F.sum((F.col("after") - F.col("before")) ** 2)).alias("step_size"), F.sqrt(F.sum(F.col("gradient") ** 2)).alias("grad_size"), F.sqrt(F.sum(F.col("after") ** 2)).alias("norm_density"))
    return norms.withColumn("inc_ratio", F.try_divide("step_size", "norm_density"))


def batch_info(results: DataFrame, keys: list[str], noise_variance: float) -> DataFrame:
    """(keys, n, like, rmse, signal, ess, speedup) of images' results: nll, error and signal power, effective
    size, and the share of the domain that was sampled. In one aggregation."""
    n, noise = F.count(F.lit(1)), math.sqrt(noise_variance)
    return results.groupBy(*keys).agg(n.alias("n"), F.avg("nll").alias("like"), (F.sqrt(F.avg("error")) / noise).alias("rmse"), (F.sqrt(F.avg("signal")) / noise).alias("signal"), F.avg("ess").alias("ess"), F.try_divide(n, F.sum("sampled")).alias("speedup"))


def principal_axes(covariance: list[list[float]]):
    """Eigenvectors of a 3 x 3 covariance as columns, by rising eigenvalue, turned to a right hand."""
    import numpy as np

    _, vectors = np.linalg.eigh(np.array(covariance, float))
    if np.linalg.det(vectors) < 0:
        vectors[:, 0] = -vectors[:, 0]
    return vectors
