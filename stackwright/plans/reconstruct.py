"""Reconstruction: the expectation step on Spark, averaged-gradient steps on the driver.

The parameter is a real volume. Its Fourier slices over a direction grid, in-plane turns and shifts are the domain of the
expectation step; slices are made in the tasks, from the volume. Each evaluation is one Spark job over the minibatch, whose
gradient comes back as one sum per voxel.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackwright.operators import estep, probability, sampler_state
from stackwright.operators.fourier import centred_fft, centred_ifft, to_fourier
from stackwright.plans import optimizer
from stackwright.sources.synthetic import rotation, slice_of
from stackwright.staging import scope, stage


@dataclass(frozen=True)
class Sampling:
    """Importance sampling: an image's next candidates come from its last posterior, mixed with so much of the uniform
    distribution; ess_scale times the effective size are drawn on an axis, if that saves a twentieth of it."""

    ess_scale: float = 5.0
    prior: float = 0.05
    temperature: float = 1.0


@dataclass(frozen=True)
class NoiseModel:
    """Noise variances learned from the errors of the minibatches so far: drawn to the start value as by so many images; one
    value for all frequencies if white."""

    prior_images: float = 50.0
    white: bool = True


def direction_turns(n_directions: int, n_turns: int) -> np.ndarray:
    """Rotations (directions, in-plane turns, 3, 3) over a spiral of directions."""
    h = -1 + 2 * np.arange(n_directions) / max(n_directions - 1, 1)
    step = np.where(np.abs(h) < 1, 3.6 / math.sqrt(n_directions) / np.sqrt(np.maximum(1 - h * h, 1e-12)), 0.0)
    phi = np.where(np.abs(h) < 1, np.cumsum(step), 0.0)
    return np.array([[rotation(p, math.acos(z), 2 * math.pi * k / n_turns) for k in range(n_turns)] for p, z in zip(phi, np.clip(h, -1, 1), strict=True)])


def turn_taps(n: int, used: np.ndarray, n_turns: int) -> tuple[np.ndarray, np.ndarray]:
    """(at, weight), both (I, C, 4): the image's coefficients that make a turned one, by linear interpolation; 0 beyond the edge.
    An image whose slice was turned by psi is turned back by it."""
    gx, gy = used // n - n // 2, used % n - n // 2
    at, weight = np.zeros((2, n_turns, len(used), 4))
    for i in range(n_turns):
        c, s = math.cos(2 * math.pi * i / n_turns), math.sin(2 * math.pi * i / n_turns)
        x, y = c * gx + s * gy + n // 2, -s * gx + c * gy + n // 2
        # places that are whole up to rounding stay whole
        x, y = np.round(x, 9), np.round(y, 9)
        low_x, low_y = np.floor(x), np.floor(y)
        for k in range(4):
            px, py = low_x + (k >> 1), low_y + (k & 1)
            w = np.where(k >> 1, x - low_x, 1 - x + low_x) * np.where(k & 1, y - low_y, 1 - y + low_y)
            inside = (px >= 0) & (px < n) & (py >= 0) & (py < n)
            at[i, :, k], weight[i, :, k] = np.where(inside, px * n + py, 0), np.where(inside, w, 0.0)
    return at.astype(np.int64), weight


def scatter(turns: np.ndarray, grad: np.ndarray, n: int) -> np.ndarray:
    """The transpose of slicing: adds each coefficient's gradient to the voxels it was read from."""
    out = np.zeros((n, n, n), complex)
    axis = np.arange(n) - n // 2
    gx, gy = np.meshgrid(axis, axis, indexing="ij")
    for turn, g in zip(turns.reshape(-1, 3, 3), grad.reshape(-1, n, n), strict=True):
        p = gx[..., None] * turn[:, 0] + gy[..., None] * turn[:, 1] + n // 2
        low = np.floor(p).astype(int)
        part = p - low
        for corner in range(8):
            o = np.array([corner >> k & 1 for k in range(3)])
            at, w = low + o, np.prod(np.where(o, part, 1 - part), axis=-1)
            ok = ((at >= 0) & (at < n)).all(axis=-1)
            np.add.at(out, tuple(at[ok].T), (w * g)[ok])
    return out


def symmetric(directions: np.ndarray, group: np.ndarray | None) -> np.ndarray:
    """(G, R, 3, 3): the directions under each rotation of a symmetry group."""
    group = np.eye(3)[None] if group is None else np.asarray(group, float)
    return np.einsum("gij,rjk->grik", group, directions)


def slices_of(f: np.ndarray, turns: np.ndarray, used: np.ndarray) -> np.ndarray:
    """(R, C): slices of a Fourier volume, the mean over the symmetry group of turns (G, R, 3, 3)."""
    return np.mean([[slice_of(f, t).ravel()[used] for t in row] for row in turns], axis=0)


def spread_of(grad: np.ndarray, turns: np.ndarray, used: np.ndarray, n: int) -> np.ndarray:
    """The transpose of slices_of: (R, C) to a Fourier volume."""
    whole = np.zeros((grad.shape[0], n * n), complex)
    whole[:, used] = grad
    return sum(scatter(row, whole, n) for row in turns) / len(turns)


def shift_grid(reach: float, step: float, sigma: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(shifts (S, 2), log weights): a grid within a disc, weighed by a normal distribution if sigma is given."""
    axis = np.arange(-math.floor(reach / step), math.floor(reach / step) + 1) * step
    x, y = (a.ravel() for a in np.meshgrid(axis, axis, indexing="ij"))
    inside = x * x + y * y <= reach * reach + 1e-9
    points = np.stack([x[inside], y[inside]], axis=1)
    logw = np.zeros(len(points)) if sigma is None else -(points**2).sum(axis=1) / (2 * sigma**2)
    return points, logw - np.logaddexp.reduce(logw)


def sampled(images: DataFrame, state: DataFrame, sizes: dict[str, int], sampling: Sampling, seed: int) -> DataFrame:
    """The images with the candidates of their next step, drawn from the state (image, axis, point, p)."""
    def axis(name: str, size: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda p: F.struct(F.lit(name).alias("axis"), p.alias("point"), F.lit(size).alias("size")))

    points = F.inline(F.flatten(F.array(*[axis(a, n) for a, n in sizes.items()])))
    rows = images.select("image_id", points).join(state, ["image_id", "axis", "point"], "left")
    rows = rows.withColumn("q", (1 - sampling.prior) * F.coalesce("p", F.lit(0.0)) + sampling.prior / F.col("size"))
    ess = probability.effective_size(rows, "q", ["image_id", "axis", "size"])
    plan = ess.withColumn("n", probability.sample_size(F.col("ess"), F.col("size"), sampling.ess_scale)).where(probability.worth_sampling(F.col("ess"), F.col("n"), F.col("size")))
    draws = rows.join(plan.select("image_id", "axis", "n"), ["image_id", "axis"])
    return estep.candidates(images, probability.draw(draws, ["image_id", "axis"], "point", "q", "n", seed), "image_id")


def reconstruct(images: DataFrame, n: int, sigma: float, n_directions: int, n_turns: int, start: np.ndarray, iterations: int, n_batches: int = 4, seed: int = 0, prior_sigma: float = 10.0, radius: Callable[[int], float] | None = None, each: Callable[[dict, np.ndarray], None] | None = None,
                shifts: tuple[np.ndarray, np.ndarray] | None = None, symmetry: np.ndarray | None = None, sampling: Sampling | None = None, noise: NoiseModel | None = None, algorithm=None) -> tuple[np.ndarray, list[dict]]:
    """(volume, statistics) from (image_id, px) and, if there are any, optics: an image's transfer function on its n x n
    coefficients. Images are transformed once and persisted.

    An evaluation is one job: tasks make the slices, take the step on their images and lay gradients back on the volume,
    and n**3 sums come to the driver. shifts: points and log weights (see shift_grid). symmetry: the rotations of a group. radius:
    the share of the band that is used in an iteration, for frequency marching. sampling, noise: see there. each: called with
    every iteration's statistics and volume, to keep them."""
    packed = to_fourier(images.select("image_id", "px"), "image_id", "px", n, 2)
    if "optics" in images.columns:
        packed = packed.join(images.select("image_id", "optics"), "image_id")
    packed = packed.withColumn("batch", F.pmod(F.xxhash64("image_id"), F.lit(n_batches)).cast("int")).persist()
    directions = direction_turns(n_directions, 1)[:, 0]
    turns = symmetric(directions, symmetry)
    points, shift_logw = shifts if shifts is not None else (np.zeros((1, 2)), np.zeros(1))
    axis = np.arange(n) - n // 2
    gx, gy = (a.ravel() for a in np.meshgrid(axis, axis, indexing="ij"))
    logw = (np.full(n_directions, -math.log(n_directions)), np.full(n_turns, -math.log(n_turns)), shift_logw)
    sizes = dict(zip(estep.AXES, map(len, logw), strict=True))
    now = {"turn": 0, "drawn": None, "state": {}, "used": None}
    variances, errors = np.full(n * n, float(sigma) ** 2), optimizer.RunningSum()
    whole, known = np.zeros(n * n), optimizer.RunningSum()

    def domain(f: np.ndarray, used: np.ndarray) -> estep.Domain:
        if now["used"] is None or len(now["used"]) != len(used):
            now["used"], now["taps"] = used, turn_taps(n, used, n_turns)
        phases = np.exp(2j * math.pi / n * (np.outer(points[:, 0], gx[used]) + np.outer(points[:, 1], gy[used])))
        return estep.Domain(lambda: slices_of(f, turns, used), phases, *now["taps"], logw, variances[used])

    def candidates(batch: int) -> DataFrame:
        """The minibatch with this turn's candidates: all evaluations of a turn see the same."""
        rows = packed.where(F.col("batch") == batch)
        if sampling is None or batch not in now["state"]:
            return rows
        if now["drawn"] is None:
            now["drawn"] = stage(sampled(rows, now["state"][batch], sizes, sampling, seed + 1000 * now["turn"]), "candidates")
        return now["drawn"]

    def objective(x: np.ndarray, batch: int) -> tuple[float, np.ndarray]:
        f = centred_fft(x.reshape(n, n, n), 3)
        used = np.flatnonzero(gx**2 + gy**2 < ((radius(now["turn"]) if radius else 2.0) * n / 2) ** 2)
        d, rows = domain(f, used), candidates(batch)
        found = {}
        for r in estep.e_step_sums(rows, "image_id", d, lambda grad: spread_of(grad, turns, used, n)).collect():  # n**3 sums in blocks
            held = found.setdefault(r["what"], {})
            held[r["block"]] = np.array(r["re"]) + 1j * np.array(r["im"])
        if not found:
            return 0.0, np.zeros(n**3)
        sums = {what: np.concatenate([blocks[k] for k in sorted(blocks)]) for what, blocks in found.items()}
        nll, count = sums["total"][0].real, sums["total"][0].imag
        if now.get("recorded") != now["turn"]:  # the first evaluation of a turn is at its start
            now["recorded"] = now["turn"]
            record(rows, d, batch, used, sums["error"].real / count, count)
        return float(nll / count), centred_ifft(sums["gradient"].reshape(n, n, n) / count, 3).real.ravel()

    def record(rows: DataFrame, d: estep.Domain, batch: int, used: np.ndarray, error: np.ndarray, count: float) -> None:
        if sampling is not None:
            for a in estep.AXES:
                if f"on_{a}" not in rows.columns:
                    rows = rows.withColumn(f"on_{a}", F.array().cast("array<struct<point:int,weight:double>>"))
            found = estep.posteriors(estep.e_step(rows, "image_id", d), rows, "image_id")
            found = sampler_state.record_update(found.select(F.struct("image_id", "axis").alias("image"), "point", "value", "weight"), sampling.temperature, log=True)
            now["fresh"] = batch, stage(found.select("image.image_id", "image.axis", "point", "p"), "posterior")
        if noise is not None:
            row, seen = whole.copy(), whole.copy()
            row[used], seen[used] = error, count
            now["errors"] = batch, row, seen

    def prior(x: np.ndarray) -> tuple[float, np.ndarray]:
        return float((x**2).sum() / (2 * prior_sigma**2)), x / prior_sigma**2

    def noted(row: dict, x: np.ndarray) -> None:
        """The turn is over: what it found of posteriors and noise holds from the next one on."""
        if "fresh" in now:
            b, table = now.pop("fresh")
            now["state"][b] = table
        if "errors" in now:
            b, error, seen = now.pop("errors")
            errors.set(b, error * seen)
            known.set(b, seen)
            weight = known.mean() * len(known.values)
            total = errors.mean() * len(errors.values)
            drawn = (total + noise.prior_images * sigma**2) / (weight + noise.prior_images)
            variances[:] = (drawn * weight).sum() / weight.sum() if noise.white else drawn
            row["noise"] = float(variances.mean())
        now["turn"], now["drawn"] = row["iteration"] + 1, None
        if each:
            each(row, x.reshape(n, n, n))

    algorithm = algorithm or optimizer.AverageGradient(search_every=5)
    try:
        with scope(packed.sparkSession):
            x, stats = optimizer.minimise(objective, prior, start.ravel().astype(float), n_batches, iterations, algorithm, seed, each=noted)
    finally:
        packed.unpersist()
    return x.reshape(n, n, n), stats
