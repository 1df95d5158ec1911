"""Reconstruction with optics, shifts, symmetry, sampling and noise that is learned."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stackwright.operators import estep, fourier
from stackwright.plans import optimizer, reconstruct
from stackwright.sources import synthetic


def held_out_loss(images, n, sigma, x, n_directions, n_turns, shifts=None, symmetry=None):
    """Mean negative log likelihood of images that were not used, over the whole domain."""
    packed = fourier.to_fourier(images.select("image_id", "px"), "image_id", "px", n, 2)
    if "optics" in images.columns:
        packed = packed.join(images.select("image_id", "optics"), "image_id")
    used = np.arange(n * n)
    points, logw = shifts if shifts is not None else (np.zeros((1, 2)), np.zeros(1))
    axis = np.arange(n) - n // 2
    gx, gy = (a.ravel() for a in np.meshgrid(axis, axis, indexing="ij"))
    turns = reconstruct.symmetric(reconstruct.direction_turns(n_directions, 1)[:, 0], symmetry)
    f = fourier.centred_fft(x, 3)
    phases = np.exp(2j * math.pi / n * (np.outer(points[:, 0], gx) + np.outer(points[:, 1], gy)))
    d = estep.Domain(lambda: reconstruct.slices_of(f, turns, used), phases, *reconstruct.turn_taps(n, used, n_turns), (np.full(n_directions, -math.log(n_directions)), np.full(n_turns, -math.log(n_turns)), logw), sigma**2)
    return estep.e_step(packed, "image_id", d).agg(F.avg("nll")).first()[0]


def shells(a, b):
    """Correlation of two volumes on each Fourier shell."""
    n = a.shape[0]
    fa, fb = fourier.centred_fft(a, 3), fourier.centred_fft(b, 3)
    axis = np.arange(n) - n // 2
    r = np.sqrt(sum(g**2 for g in np.meshgrid(axis, axis, axis, indexing="ij"))).round().astype(int)
    return [(fa * fb.conj())[r == k].sum().real / max(1e-12, math.sqrt((abs(fa[r == k]) ** 2).sum() * (abs(fb[r == k]) ** 2).sum())) for k in range(1, n // 2)]


OPTICS = {"akv": 200.0, "cs": 2.0, "wgh": 0.07, "dscale": 1.0, "bfactor": 20.0, "df1": 9000.0, "df2": 8000.0, "angast": 0.4}


def with_optics(images, n, pixel):
    axis = np.arange(n) - n // 2
    gx, gy = np.meshgrid(axis, axis, indexing="ij")
    values = synthetic.transfer(gx, gy, pixel, OPTICS).ravel().tolist()
    return images.withColumn("optics", F.array(*map(F.lit, values)))


def test_slices_and_their_transpose():
    """<slices(V), G> = <V, spread(G)>, with a symmetry group."""
    rng = np.random.default_rng(0)
    n, used = 8, np.flatnonzero(np.arange(64) % 3)
    group = np.array([synthetic.rotation(a, 0, 0) for a in (0, math.pi / 2, math.pi, 3 * math.pi / 2)])
    turns = reconstruct.symmetric(reconstruct.direction_turns(5, 1)[:, 0], group)
    v = rng.normal(size=(n, n, n)) + 1j * rng.normal(size=(n, n, n))
    g = rng.normal(size=(5, len(used))) + 1j * rng.normal(size=(5, len(used)))
    assert (reconstruct.slices_of(v, turns, used) * g.conj()).sum() == pytest.approx((v * reconstruct.spread_of(g, turns, used, n).conj()).sum())


def test_turned_images_are_slices_of_turned_directions(spark):
    """An image whose slice was turned in its plane, turned back by the taps, is the slice of its direction."""
    n = 16
    volume = fourier.centred_fft(synthetic.blob_volume(n, 8, 2.0, 1), 3)
    used = np.flatnonzero(((np.arange(n * n) // n - 8) ** 2 + (np.arange(n * n) % n - 8) ** 2) < 9)
    at, weight = reconstruct.turn_taps(n, used, 8)
    direct = reconstruct.direction_turns(6, 8)
    for r in range(6):
        whole = synthetic.slice_of(volume, direct[r, 0]).ravel()
        for i in (0, 2, 3, 4):
            image = synthetic.slice_of(volume, direct[r, i]).ravel()
            back = (weight[i] * image[at[i]]).sum(axis=-1)
            assert np.corrcoef(np.abs(back), np.abs(whole[used]))[0, 1] > (0.999999 if i % 2 == 0 else 0.9)


def test_gradient_of_the_objective(spark):
    """Against finite differences, with optics, shifts and a symmetry group, through the whole chain of transforms."""
    n = 8
    volume = synthetic.blob_volume(n, 8, 1.5, 2)
    images = with_optics(synthetic.project(synthetic.poses(spark, 6, 1, 0.5), volume, 0.05, 1, OPTICS, 3.0), n, 3.0).cache()
    seen = {}

    class Probe:
        def step(self, f, prior, x, batch, turn):
            loss, grad = f(x, batch)
            at = np.argsort(-np.abs(grad))[[0, 5, 40]]
            for k in at:
                step = np.zeros_like(x)
                step[k] = 1e-4
                seen[k] = ((f(x + step, batch)[0] - f(x - step, batch)[0]) / 2e-4, grad[k])
            return x, {"iteration": turn, "batch": batch, "loss": loss}

    group = np.array([synthetic.rotation(a, 0, 0) for a in (0, math.pi)])
    reconstruct.reconstruct(images, n, 0.5, 6, 4, volume * 0.5, 1, 1, shifts=reconstruct.shift_grid(1.0, 1.0, 0.7), symmetry=group, algorithm=Probe())
    assert len(seen) == 3
    for slope, grad in seen.values():
        assert slope == pytest.approx(grad, rel=1e-3)


def test_reconstruction_with_everything(spark):
    """N = 16 with optics, shifts, symmetry, sampling and learned noise: the loss of held-out images falls, and shells
    correlate with the truth better than at the start."""
    n, sigma = 16, 0.3
    volume = synthetic.blob_volume(n, 16, 1.5, 3)
    group = np.array([synthetic.rotation(a, 0, 0) for a in (0, math.pi)])
    volume = (volume + np.flip(np.roll(np.roll(volume, -1, 0), -1, 1), (0, 1))) / 2  # symmetric under the half turn about z
    images = with_optics(synthetic.project(synthetic.poses(spark, 96, 1, 0.7), volume, sigma, 1, OPTICS, 3.0), n, 3.0).cache()
    shifts = reconstruct.shift_grid(1.5, 1.0, 0.7)
    rng = np.random.default_rng(0)
    blurred = fourier.centred_ifft(fourier.centred_fft(volume, 3) * (np.add.outer(np.add.outer(*[(np.arange(n) - 8) ** 2] * 2), (np.arange(n) - 8) ** 2) < 4), 3).real
    start = blurred + 0.02 * rng.normal(size=volume.shape)
    sizes = []
    algorithm = optimizer.AverageGradient(search_every=4, n_batches=2)
    x, stats = reconstruct.reconstruct(images.where("image_id < 72"), n, sigma, 20, 12, start, 8, 2, shifts=shifts, symmetry=group, sampling=reconstruct.Sampling(ess_scale=2.0), noise=reconstruct.NoiseModel(), algorithm=algorithm, each=lambda row, v: sizes.append(row["noise"]))
    held = images.where("image_id >= 72")
    assert held_out_loss(held, n, sigma, x, 20, 12, shifts, group) < held_out_loss(held, n, sigma, start, 20, 12, shifts, group)
    assert np.mean(shells(x, volume)) > np.mean(shells(start, volume))
    assert all(0 < s < 1 for s in sizes) and len(stats) == 8


def test_sampling_draws_fewer_candidates(spark):
    """The second generation's candidates are drawn around the first one's posteriors and save work."""
    images = spark.range(5).select(F.col("id").alias("image_id"), F.array(F.lit(0.0)).alias("re"), F.array(F.lit(0.0)).alias("im"))
    state = spark.createDataFrame([(k, "r", p, 0.5) for k in range(5) for p in (3, 4)], "image_id long, axis string, point int, p double")
    drawn = reconstruct.sampled(images, state, {"r": 100, "i": 4, "s": 1}, reconstruct.Sampling(ess_scale=5.0), 1).collect()
    for row in drawn:
        assert 2 <= len(row["on_r"]) <= 20 and {3, 4} <= {x["point"] for x in row["on_r"]}
        assert not row["on_i"] and not row["on_s"]  # uniform: nothing to save
    again = reconstruct.sampled(images, state, {"r": 100, "i": 4, "s": 1}, reconstruct.Sampling(ess_scale=5.0), 1).collect()
    assert sorted(map(str, drawn)) == sorted(map(str, again))
