"""Priors and penalties: a loss per volume and a gradient per cell, over exploded cells (id, x, y, z, v).

Each objective is a pair of column expressions, so losses are one aggregation and gradients a projection.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackwright.operators.probability import log_add_exp


@dataclass(frozen=True)
class Prior:
    loss: Callable[[Column], Column]
    gradient: Callable[[Column], Column]

    def evaluate(self, cells: DataFrame, key: str = "id") -> DataFrame:
        """(key, loss)."""
        return cells.groupBy(key).agg(F.sum(self.loss(F.col("v"))).alias("loss"))

    def with_gradient(self, cells: DataFrame) -> DataFrame:
        return cells.withColumn("g", self.gradient(F.col("v")))


def gaussian(sigma: float) -> Prior:
    return Prior(lambda v: 0.5 * v * v / sigma**2 + math.log(sigma) + 0.5 * math.log(2 * math.pi), lambda v: v / sigma**2)


def gaussian_fourier(coefficients: DataFrame, sigma: float, images: float, key: str = "id") -> DataFrame:
    """(key, loss) of complex coefficients (key, re, im) under a Gaussian, an image's share of it: the transform keeps lengths, so
    this is the loss of the volume."""
    power = F.sum(F.col("re") ** 2 + F.col("im") ** 2)
    return coefficients.groupBy(key).agg(((power / (2 * sigma**2) + F.count(F.lit(1)) * (math.log(sigma) + 0.5 * math.log(2 * math.pi))) / images).alias("loss"))


def gaussian_fourier_gradient(coefficients: DataFrame, sigma: float, images: float) -> DataFrame:
    """Adds g_re, g_im: the derivative by each coefficient."""
    return coefficients.withColumns({f"g_{p}": F.col(p) / (sigma**2 * images) for p in ("re", "im")})


def gaussian_curvature(sigma: float, images: float) -> float:
    """The second derivative by any coordinate, for preconditioners."""
    return 1 / (sigma**2 * images)


def learned_widths(cells: DataFrame, key: str = "id") -> DataFrame:
    """(key, sigma, rate): the widths under which a volume's values are likeliest: the root of the mean square for the Gaussian,
    one over the mean of the positive values for the sparsity prior."""
    return cells.groupBy(key).agg(F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("sigma"), F.try_divide(F.lit(1.0), F.avg(F.when(F.col("v") > 0, F.col("v")))).alias("rate"))


def sparsity(rate: float, positive: bool = False) -> Prior:
    """Exponential of the size (of the value itself if it is taken to be positive), with its normaliser."""
    log_rate = math.log(rate) if rate > 0 else 0.0
    if positive:
        return Prior(lambda v: rate * v - log_rate, lambda v: F.lit(rate))
    return Prior(lambda v: rate * F.abs(v) - log_rate, lambda v: rate * F.signum(v))


def negative(power: int, penalty: float, scale: float, n: int) -> Prior:
    """(-1)^power * penalty / (scale^3 * n) * v^power over the cells below zero."""
    factor = (-1) ** power * penalty / (scale**3 * n)
    return Prior(lambda v: F.when(v < 0, factor * F.pow(v, F.lit(float(power)))).otherwise(0.0), lambda v: F.when(v < 0, factor * power * F.pow(v, F.lit(float(power - 1)))).otherwise(0.0))


def _mixture(v: Column, share: float, gamma: float, mu: float, sigma: float) -> tuple[Column, Column]:
    e = math.log(share) - math.log(2 * gamma) - v / gamma
    return e, math.log(1 - share) - 0.5 * math.log(2 * math.pi * sigma**2) - 0.5 * (v - mu) ** 2 / sigma**2


def exponential_gaussian(share: float, gamma: float, mu: float, sigma: float) -> Prior:
    """Mixture of 1 / (2 gamma) * exp(-v / gamma), over all values, and a Gaussian about mu."""

    def grad(v: Column) -> Column:
        e, g = _mixture(v, share, gamma, mu, sigma)
        both = log_add_exp(e, g)
        return F.exp(e - both) / gamma + (v - mu) / sigma**2 * F.exp(g - both)

    return Prior(lambda v: -log_add_exp(*_mixture(v, share, gamma, mu, sigma)), grad)


def mixture_sigma(cells: DataFrame, share: float, gamma: float, mu: float, sigma: float) -> DataFrame:
    """One EM step for the Gaussian's width: (sigma)."""
    v = F.col("v")
    e, g = _mixture(v, share, gamma, mu, sigma)
    r = F.exp(g - log_add_exp(e, g))
    return cells.agg(F.sqrt(F.try_divide(F.sum(r * (v - mu) ** 2), F.sum(r))).alias("sigma"))


def sparsity_rate(cells: DataFrame, scale: float = 1.0) -> DataFrame:
    """1 / mean of the positive cells, scaled."""
    return cells.agg((scale / F.avg(F.when(F.col("v") > 0, F.col("v")))).alias("rate"))


def centre_penalty(cells: DataFrame, weight: float, key: str = "id") -> DataFrame:
    """(key, loss, mx, my, mz): half the weighted squared distance of the centre of mass from the origin."""
    sums = cells.groupBy(key).agg(F.sum("v").alias("w"), *[F.sum(F.col("v") * F.col(a)).alias(f"m{a}") for a in "xyz"])
    means = [F.try_divide(F.col(f"m{a}"), F.col("w")) for a in "xyz"]
    return sums.select(key, "w", *[m.alias(f"m{a}") for a, m in zip("xyz", means, strict=True)]).withColumn("loss", 0.5 * weight * (F.col("mx") ** 2 + F.col("my") ** 2 + F.col("mz") ** 2))


def centre_gradient(cells: DataFrame, weight: float, key: str = "id") -> DataFrame:
    """Derivative by each cell: weight * sum of m * (x - m) / total."""
    rows = cells.join(centre_penalty(cells, weight, key).drop("loss"), key)
    return rows.withColumn("g", weight * sum((F.col(f"m{a}") * (F.col(a) - F.col(f"m{a}")) for a in "xyz"), F.lit(0.0)) / F.col("w"))


def neighbour_errors(cells: DataFrame, n: int, width: float, key: str = "id") -> DataFrame:
    """Adds err: the value less its prediction, the Gaussian-weighted sum of the neighbours within three
    widths (rounded, half up). The kernel, without its centre, sums to 1; neighbours beyond the grid count as
    0. A Gaussian is a product of three, so values are spread along one axis after the other, and the
    centre is taken off at the end: 3 * (2 * r + 1) rows a cell are shuffled, not (2 * r + 1)**3."""
    r = math.floor(3 * width + 0.5)
    line = {a: math.exp(-(a * a) / (2 * width**2)) for a in range(-r, r + 1)}
    others = sum(line.values()) ** 3 - 1
    low, high = -(n // 2), n - n // 2 - 1
    spread = cells.select(key, *"xyz", F.col("v").alias("_p"))
    for axis in "xyz":
        steps = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(w).alias("w")) for a, w in line.items()]))
        sent = spread.withColumn("_o", steps).withColumns({axis: (F.col(axis) + F.col("_o.a")).cast("int"), "_p": F.col("_o.w") * F.col("_p")}).where(F.col(axis).between(low, high))
        spread = sent.groupBy(key, *"xyz").agg(F.sum("_p").alias("_p"))
    # a cell that only neighbours speak of has no row, as before
    return cells.join(spread, [key, "x", "y", "z"], "left").withColumn("err", F.col("v") - F.coalesce((F.col("_p") - F.col("v")) / others, F.lit(0.0))).drop("_p")


def neighbour_prior(cells: DataFrame, n: int, tau: float, width: float = 1.0, key: str = "id") -> DataFrame:
    """(key, loss): half the sum of value times error, over tau^2."""
    rows = neighbour_errors(cells, n, width, key)
    return rows.groupBy(key).agg((0.5 * F.sum(F.col("v") * F.col("err")) / tau**2).alias("loss"))


def neighbour_gradient(cells: DataFrame, n: int, tau: float, width: float = 1.0, key: str = "id") -> DataFrame:
    """Derivative by each cell: the error over tau^2, as the kernel is symmetric."""
    return neighbour_errors(cells, n, width, key).withColumn("g", F.col("err") / tau**2).drop("err")


def null_prior() -> Prior:
    return Prior(lambda v: F.lit(0.0), lambda v: F.lit(0.0))


PRIORS = {"gaussian": gaussian, "sparsity": sparsity, "negative": negative, "exponential_gaussian": exponential_gaussian, "null": null_prior}


def total(cells: DataFrame, terms: list[tuple[float, Prior]], key: str = "id") -> DataFrame:
    """(key, loss) of a weighted sum of priors, in one aggregation."""
    loss = sum((w * p.loss(F.col("v")) for w, p in terms), F.lit(0.0))
    return cells.groupBy(key).agg(F.sum(loss).alias("loss"))
