"""The expectation step: images against turned, shifted and filtered slices, whole or by importance samples.

An image's coefficients d, turned by i, are compared with slice r under the image's optics c and the phases S of
shift s: the error is the sum over coefficients of |c_i S_s P_r - d_i|^2 / sigma2. The domain (slices, turns,
phases, weights) is bounded and lies in the tasks' closure; images stream through it in Arrow batches. Each image may have its
own candidates on every axis, with the weights they were drawn with; an axis without any is taken whole.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackwright.operators.blocks import BLOCK, flat, merge_blocks

AXES = ("r", "i", "s")


@dataclass(frozen=True)
class Domain:
    """slices (R, C) and phases (S, C) are complex; slices may be a function that makes them in the task, of a volume that is
    smaller than they are. turn_at, turn_weight (I, C, K): each turned coefficient is a sum of K weighted ones of the
    image. logw: three arrays of log quadrature weights. sigma2: noise variance, one or C."""

    slices: np.ndarray | Callable[[], np.ndarray]
    phases: np.ndarray
    turn_at: np.ndarray
    turn_weight: np.ndarray
    logw: tuple[np.ndarray, np.ndarray, np.ndarray]
    sigma2: np.ndarray | float

    def ready(self) -> Domain:
        return replace(self, slices=self.slices()) if callable(self.slices) else self

    def turned(self, image: np.ndarray, at: np.ndarray) -> np.ndarray:
        """(len(at), C): the image under the turns."""
        return (self.turn_weight[at] * image[self.turn_at[at]]).sum(axis=-1)


def candidates(images: DataFrame, samples: DataFrame, key: str) -> DataFrame:
    """The images with a column per axis: sampled points and weights from samples (key, axis, point, weight). A domain bounds
    how many points an image can have."""
    lists = [F.array_sort(F.collect_list(F.when(F.col("axis") == a, F.struct(F.col("point").cast("int").alias("point"), F.col("weight").cast("double").alias("weight"))))).alias(f"on_{a}") for a in AXES]
    by_image = samples.groupBy(F.col(key).alias("_key")).agg(*lists)
    return images.join(by_image, images[key].eqNullSafe(by_image["_key"]), "left").drop("_key")


def expected(d: np.ndarray, c: np.ndarray, p: np.ndarray, s: np.ndarray, logw: np.ndarray, sigma2: np.ndarray) -> dict:
    """One image: d, c (I, C), slices p (R, C), phases s (S, C), logw (R, I, S). Errors of all candidates by two matrix
    products."""
    shape = logw.shape
    weight = 1 / np.broadcast_to(sigma2, d.shape[1:])
    mixed = ((c * d)[:, None, :] * s.conj()[None, :, :]).reshape(-1, d.shape[1])
    cross = (p.conj() @ (mixed * weight).T).real.reshape(shape)
    energy = (np.abs(p) ** 2) @ (c**2 * weight).T
    e = logw - ((np.abs(d) ** 2) @ weight)[None, :, None] / 2 + cross - energy[:, :, None] / 2
    top = e.max()
    nll = -(top + np.log(np.exp(e - top).sum())) if np.isfinite(top) else np.inf
    q = np.exp(e + nll) if np.isfinite(nll) else np.full(shape, 1 / e.size)
    with np.errstate(divide="ignore"):
        phi = [np.log(q.sum(axis=axes)) for axes in ((1, 2), (0, 2), (0, 1))]
    drawn = q.reshape(len(p), -1) @ mixed
    filtered = q.sum(axis=2) @ c**2
    corr, power = (p.conj() * drawn).real.sum(axis=0), (np.abs(p) ** 2 * filtered).sum(axis=0)
    error = q.sum(axis=(0, 2)) @ np.abs(d) ** 2 - 2 * corr + power
    return {"nll": nll, "phi": phi, "error": error, "corr": corr, "power": power, "grad": (p * filtered - drawn) * weight}


def _images(batch: pa.RecordBatch, domain: Domain):
    """(row, points and log weights on each axis, what `expected` gives) for each image of a batch."""
    columns = {n: flat(batch.column(n)) for n in ("re", "im", "optics")}
    drawn = {a: batch.column(f"on_{a}").to_pylist() if f"on_{a}" in batch.schema.names else [None] * batch.num_rows for a in AXES}
    sigma2 = np.asarray(domain.sigma2, float)
    for row in range(batch.num_rows):
        re, im, optics = (data[at[row] : at[row + 1]] for data, at in columns.values())
        at, logw = [], []
        for a, whole in zip(AXES, domain.logw, strict=True):
            points = drawn[a][row]
            at.append(np.array([x["point"] for x in points]) if points else np.arange(len(whole)))
            logw.append(whole[at[-1]] + (np.log([x["weight"] for x in points]) if points else 0.0))
        w = logw[0][:, None, None] + logw[1][None, :, None] + logw[2][None, None, :]
        yield row, at, expected(domain.turned(re + 1j * im, at[1]), domain.turned(optics, at[1]), domain.slices[at[0]], domain.phases[at[2]], w, sigma2)


def _prepared(images: DataFrame, key: str) -> DataFrame:
    optics = F.col("optics") if "optics" in images.columns else F.transform("re", lambda _: F.lit(1.0))
    return images.select(key, "re", "im", optics.alias("optics"), *[f"on_{a}" for a in AXES if f"on_{a}" in images.columns])


def e_step(images: DataFrame, key: str, domain: Domain) -> DataFrame:
    """(key, nll, error, corr, power, and for each axis n_, ess_, at_, phi_): negative log likelihood, expected sums over
    coefficients, and the log posterior at the image's candidates, from packed images (key, re, im, optics if there are any,
    on_r, on_i, on_s if sampled). One narrow pass. The effective sizes are those of the posterior over the candidates."""

    def work(batches):
        ready = domain.ready()
        for batch in batches:
            rows = []
            for row, at, found in _images(batch, ready):
                sizes = [float(1 / np.exp(2 * phi).sum()) for phi in found["phi"]]
                sums = [float(found[k].sum()) for k in ("error", "corr", "power")]
                rows.append([row, float(found["nll"]), *sums, *(len(x) for x in at), *sizes, *(x.tolist() for x in at), *(x.tolist() for x in found["phi"])])
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([batch.column(key), *(pa.array(list(c), t) for c, t in zip(columns[1:], types, strict=True))], names=[key, *names])

    names = ["nll", "error", "corr", "power", *(f"{k}_{a}" for k in ("n", "ess", "at", "phi") for a in AXES)]
    kinds = ["double"] * 4 + ["int"] * 3 + ["double"] * 3 + ["array<int>"] * 3 + ["array<double>"] * 3
    arrow = {"double": pa.float64(), "int": pa.int32(), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64())}
    types = [arrow[k] for k in kinds]
    kind = images.schema[key].dataType.simpleString()
    return _prepared(images, key).mapInArrow(work, f"{key} {kind}, " + ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))


def posteriors(results: DataFrame, images: DataFrame, key: str) -> DataFrame:
    """(key, axis, point, value, weight): the log posterior at each candidate with the weight it was drawn with (1 if the axis
    was taken whole): what the sampler's state records. images: with their candidates."""
    drawn = images.select(F.col(key).alias("_key"), *[f"on_{a}" for a in AXES])
    both = results.join(drawn, results[key].eqNullSafe(drawn["_key"]))
    out = None
    for a in AXES:
        held = F.transform(F.coalesce(f"on_{a}", F.array().cast("array<struct<point:int,weight:double>>")), lambda x: x["weight"])
        rows = both.select(key, F.lit(a).alias("axis"), held.alias("_w"), F.posexplode(F.arrays_zip(F.col(f"at_{a}").alias("point"), F.col(f"phi_{a}").alias("value"))).alias("_i", "_x"))
        rows = rows.select(key, "axis", "_x.point", "_x.value", F.coalesce(F.get("_w", F.col("_i")), F.lit(1.0)).alias("weight"))
        out = rows if out is None else out.unionByName(rows)
    return out


def e_step_sums(images: DataFrame, key: str, domain: Domain, spread: Callable[[np.ndarray], np.ndarray] | None = None, block: int = BLOCK) -> DataFrame:
    """(what, block, re, im): sums over images in blocks of elements. what: `gradient` by the slices (R x C, or what `spread`, which
    is linear, makes of them in the task), `error`, `corr` and `power` of each coefficient, and `total`, the sum of the negative log
    likelihoods with the number of images beside it. One row per task and block is shuffled, and merged in a tree."""

    def work(batches):
        ready = domain.ready()
        n_r, n_c = ready.slices.shape
        grad, stats, total = np.zeros((n_r, n_c), complex), {k: np.zeros(n_c) for k in ("error", "corr", "power")}, np.zeros(2)
        for batch in batches:
            for _, at, found in _images(batch, ready):
                grad[at[0]] += found["grad"]
                for k, held in stats.items():
                    held += found[k]
                total += found["nll"], 1
        if not total[1]:
            return
        grad = (spread(grad) if spread else grad).ravel()
        rows = [("gradient", grad.real, grad.imag), *((k, v, np.zeros(n_c)) for k, v in stats.items()), ("total", total[:1], total[1:])]
        task = TaskContext.get().partitionId()
        for what, re, im in rows:
            cuts = range(0, len(re), block)
            lists = [pa.array([x[a : a + block] for a in cuts], pa.list_(pa.float64())) for x in (re, im)]
            yield pa.RecordBatch.from_arrays([pa.array([what] * len(cuts)), pa.array(range(len(cuts)), pa.int32()), pa.array([task] * len(cuts), pa.int32()), *lists], names=["what", "block", "_task", "re", "im"])

    parts = _prepared(images, key).mapInArrow(work, "what string, block int, _task int, re array<double>, im array<double>")
    return merge_blocks(parts, ["what"], ["re", "im"])


def prepare(images: DataFrame, key: str, n: int, rad: float, sigma2: float, base_variance: float, pixel_size: float = 1.0, bfactor: float | None = None) -> DataFrame:
    """Packed images (key, re, im, optics) of n x n coefficients made ready for the step, in one narrow pass: (key, at, re, im, optics,
    n_used, outside, constant). The coefficients within rad of the band stay, with their places; their optics fall off with the
    envelope exp(-bfactor / 4 * frequency^2) if there is one. outside: the power of the others, which are noise of the
    base variance. constant: what that power and the normal distributions' factors add to the negative log likelihood."""
    reach = (rad * n / 2) ** 2

    def r2(i: Column) -> Column:
        x, y = F.floor(i / n) - n // 2, i % n - n // 2
        return x * x + y * y

    within = lambda _, i: r2(i) < reach
    power = F.zip_with("re", "im", lambda a, b: a * a + b * b)
    fall = lambda v, i: v * F.exp(-bfactor / 4 * r2(i) / (pixel_size * n) ** 2) if bfactor else v
    rows = images.withColumn("outside", F.aggregate(F.filter(power, lambda v, i: r2(i) >= reach), F.lit(0.0), lambda s, v: s + v))
    rows = rows.withColumns({"at": F.filter(F.sequence(F.lit(0), F.lit(n * n - 1)), within), "optics": F.filter(F.transform("optics", fall), within), "re": F.filter("re", within), "im": F.filter("im", within)})
    used = F.size("at")
    constant = F.col("outside") / (2 * base_variance) + used / 2 * math.log(2 * math.pi * sigma2) + (n * n - used) / 2 * math.log(2 * math.pi * base_variance)
    return rows.select(key, "at", "re", "im", "optics", used.alias("n_used"), "outside", constant.alias("constant"))


def report(results: DataFrame, keys: list[str], sizes: dict[str, int], noise_variance: float, n: int) -> DataFrame:
    """(keys, n, like, rmse, signal, and for each axis the effective size ess_ and the speed-up speed_ of sampling, speed_total): what a
    minibatch's step says, in one aggregation. rmse and signal are roots of expected power a pixel, in units of the noise."""
    count = F.count(F.lit(1))
    part = {a: F.col(f"n_{a}") / size for a, size in sizes.items()}
    total = part["r"] * part["i"] * part["s"]
    return results.groupBy(*keys).agg(
        count.alias("n"), F.avg("nll").alias("like"), (F.sqrt(F.avg("error")) / (n * math.sqrt(noise_variance))).alias("rmse"), (F.sqrt(F.avg("power")) / (n * math.sqrt(noise_variance))).alias("signal"),
        *[F.avg(f"ess_{a}").alias(f"ess_{a}") for a in sizes], *[(count / F.sum(p)).alias(f"speed_{a}") for a, p in part.items()], (count / F.sum(total)).alias("speed_total"),
    )
