"""Marginal likelihood of images under projections turned and shifted in every way of the quadrature.

Two forms of one definition. `marginal_sql` states it with joins and log-space sums, for small domains and
as the check of `marginal_arrow`, which streams images through vectorised batches with the (bounded)
projections and weights in the closure. Results per image are partial sums, so gradients and noise
statistics are reduced by Spark's partial aggregation.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackwright.operators.grid import small
from stackwright.operators.probability import log_sum_exp


def residuals(images: DataFrame, projections: DataFrame, key: str, sigma2: float) -> DataFrame:
    """(key, r, i, s, logp): log density of each image's coefficients (c, re, im) under each projection
    (r, i, s, c, re, im, logw). Coefficients meet by an equi-join on c."""
    p = projections.select("r", "i", "s", "c", F.col("re").alias("pre"), F.col("im").alias("pim"), "logw")
    d2 = (F.col("re") - F.col("pre")) ** 2 + (F.col("im") - F.col("pim")) ** 2
    return images.join(small(p), "c").groupBy(key, "r", "i", "s").agg((F.first("logw") - F.sum(d2) / (2 * sigma2)).alias("logp"))


def marginal_sql(images: DataFrame, projections: DataFrame, key: str, sigma2: float) -> DataFrame:
    """(key, nll): shifts are summed out first, then in-plane turns, then directions."""
    e = residuals(images, projections, key, sigma2)
    e = log_sum_exp(e, "logp", [key, "r", "i"], out="ls")
    e = log_sum_exp(e, "ls", [key, "r"], out="li")
    return log_sum_exp(e, "li", [key], out="lr").select(key, (-F.col("lr")).alias("nll"))


def _lse(a: np.ndarray, axis) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(a - top).sum(axis=axis)) + top.squeeze(axis)


def marginal_arrow(images: DataFrame, key: str, projections: np.ndarray, logw: np.ndarray, sigma2: float) -> DataFrame:
    """(key, nll, ess_r, ess_i, ess_s, sigma2, corr, power, grad_re, grad_im) per image of packed
    coefficients (re, im).

    projections: complex (R, I, S, C); logw: (R, I, S). grad_*: the gradient by the projections' mean,
    weighted by the posterior, per direction: R x C values in one list."""
    shape = projections.shape[:3]
    flat, weights = projections.reshape(-1, projections.shape[3]), logw.ravel()
    energy = (np.abs(flat) ** 2).sum(axis=1)

    def work(batches):
        for batch in batches:
            f = np.stack([np.array(batch.column(n).to_pylist(), np.float64).reshape(batch.num_rows, -1) for n in ("re", "im")])
            d = f[0] + 1j * f[1]
            cross = (d @ flat.conj().T).real
            d2 = (np.abs(d) ** 2).sum(axis=1)[:, None] - 2 * cross + energy[None, :]
            e = weights[None, :] - d2 / (2 * sigma2)
            nll = -_lse(e, 1)
            p = np.exp(e + nll[:, None]).reshape(-1, *shape)
            ess = [1 / (p.sum(axis=axes) ** 2).sum(axis=1) for axes in ((2, 3), (1, 3), (1, 2))]
            q = p.reshape(len(p), -1)
            grad = np.einsum("nris,risc->nrc", p, projections) - p.sum(axis=(2, 3))[:, :, None] * d[:, None, :]
            grad = grad.reshape(len(p), -1) / sigma2
            cols = [nll, *ess, (q * d2).sum(axis=1), (q * cross).sum(axis=1), (q * energy).sum(axis=1)]
            lists = [pa.array(list(np.ascontiguousarray(g)), pa.list_(pa.float64())) for g in (grad.real, grad.imag)]
            yield pa.RecordBatch.from_arrays([batch.column(key), *map(pa.array, cols), *lists], names=[key, "nll", "ess_r", "ess_i", "ess_s", "sigma2", "corr", "power", "grad_re", "grad_im"])

    kind = images.schema[key].dataType.simpleString()
    out = f"{key} {kind}, nll double, ess_r double, ess_i double, ess_s double, sigma2 double, corr double, power double, grad_re array<double>, grad_im array<double>"
    return images.select(key, "re", "im").mapInArrow(work, out)


def summed_gradient(results: DataFrame) -> DataFrame:
    """(at, re, im): the mean over images of the gradients, summed by position with partial sums first."""
    rows = results.select(F.posexplode(F.arrays_zip("grad_re", "grad_im")).alias("at", "g"))
    return rows.groupBy("at").agg(F.avg("g.grad_re").alias("re"), F.avg("g.grad_im").alias("im"))


def outside_power(coefficients: DataFrame, key: str, inside: Column) -> DataFrame:
    """(key, n, power) of the coefficients beyond the truncation radius: they enter as a constant."""
    out = coefficients.where(~inside)
    return out.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("re") ** 2 + F.col("im") ** 2).alias("power"))


def running_moments(coefficients: DataFrame, at: list[str]) -> DataFrame:
    """(at, re, im, power): mean and mean power of the images' coefficients at each place."""
    return coefficients.groupBy(*at).agg(F.avg("re").alias("re"), F.avg("im").alias("im"), F.avg(F.col("re") ** 2 + F.col("im") ** 2).alias("power"))


def envelope_mle(df: DataFrame) -> DataFrame:
    """corr / power where the mask is set, else 1."""
    return df.withColumn("envelope", F.when(F.col("mask") > 0, F.try_divide("corr", "power")).otherwise(1.0))


def noise_mle(df: DataFrame, data_variance: Column | float) -> DataFrame:
    """mask * sigma2 + (1 - mask) * the variance of the data."""
    variance = F.lit(data_variance) if isinstance(data_variance, float) else data_variance
    return df.withColumn("noise", F.col("mask") * F.col("sigma2") + (1 - F.col("mask")) * variance)


def white(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """(keys, value): the mean over frequencies, for noise of one colour."""
    return df.groupBy(*keys).agg(F.avg(value).alias(value))


def noise_map(df: DataFrame, prior: float, base_variance: float, images: Column | float) -> DataFrame:
    """The noise estimate drawn to the base variance: it weighs as much as `prior` observations, the estimate
    as often as a coefficient was inside the mask, mask times the number of images."""
    weight = F.col("mask") * images
    return df.withColumn("noise", (F.col("sigma2") * weight + prior * base_variance) / (weight + prior))


def envelope_map(df: DataFrame, prior: float, images: Column | float, expected: Column | None = None, low: float | None = None, high: float | None = None, fixed: Column | None = None) -> DataFrame:
    """The envelope drawn to the expected one (1 if none): observations weigh mask times the number of images
    over the noise. Where `fixed` holds (low frequencies) it is 1; it is held within bounds."""
    weight = F.col("mask") * images / F.col("noise")
    expected = F.lit(1.0) if expected is None else expected
    out = (F.col("corr") * weight + expected * prior) / (F.col("power") * weight + prior)
    out = out if fixed is None else F.when(fixed, 1.0).otherwise(out)
    out = out if low is None else F.greatest(out, F.lit(low))
    return df.withColumn("envelope", out if high is None else F.least(out, F.lit(high)))
