"""Synthetic image stacks with known poses, reproducible by seed and image."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stackwright.operators.fourier import centred_fft, centred_ifft


def blob_volume(n: int, blobs: int, sigma: float, seed: int = 0, window: float | None = None) -> np.ndarray:
    """A random walk of Gaussian blobs. Widths vary by a log-normal factor; each blob is cut at three widths
    and at the window, a sphere (of n / 4 by default) at which the walk is reflected."""
    rng, window = np.random.default_rng(seed), n / 4 if window is None else window
    axis = np.arange(n) - n // 2
    x, y, z = np.meshgrid(axis, axis, axis, indexing="ij")
    seen = x**2 + y**2 + z**2 < window**2
    at, out = np.zeros(3), np.zeros((n, n, n))
    for _ in range(blobs):
        width = sigma * math.exp(0.25 * rng.normal())
        d2 = (x - at[0]) ** 2 + (y - at[1]) ** 2 + (z - at[2]) ** 2
        out += np.where(seen & (d2 < 9 * width**2), np.exp(-d2 / (2 * width**2)), 0.0)
        step = rng.normal(size=3)
        at = at + 2 * width * step / np.linalg.norm(step)
        while (far := np.linalg.norm(at)) > window:
            at = at * (2 * window - far) / far
    return out


def rotation(phi: float, theta: float, psi: float) -> np.ndarray:
    def z(t):
        return np.array([[math.cos(t), -math.sin(t), 0], [math.sin(t), math.cos(t), 0], [0, 0, 1]])

    y = np.array([[math.cos(theta), 0, math.sin(theta)], [0, 1, 0], [-math.sin(theta), 0, math.cos(theta)]])
    return z(phi) @ y @ z(psi)


def slice_of(volume: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Central slice of a Fourier volume, trilinear, 0 beyond its edge."""
    n = volume.shape[0]
    axis = np.arange(n) - n // 2
    gx, gy = np.meshgrid(axis, axis, indexing="ij")
    p = gx[..., None] * turn[:, 0] + gy[..., None] * turn[:, 1] + n // 2
    low = np.floor(p).astype(int)
    part = p - low
    out = np.zeros((n, n), complex)
    for corner in range(8):
        o = np.array([corner >> k & 1 for k in range(3)])
        at = low + o
        w = np.prod(np.where(o, part, 1 - part), axis=-1)
        ok = ((at >= 0) & (at < n)).all(axis=-1)
        at = np.clip(at, 0, n - 1)
        out += np.where(ok, w, 0) * volume[at[..., 0], at[..., 1], at[..., 2]]
    return out


def poses(spark: SparkSession, n_images: int, seed: int, shift_sigma: float) -> DataFrame:
    """(image_id, phi, theta, psi, sx, sy): directions uniform on the sphere, normal shifts. All are hashes of
    the image's id and the seed, so any layout of the table gives the same."""

    def uniform(k: int) -> Column:
        return (F.pmod(F.xxhash64(F.col("id"), F.lit(seed), F.lit(k)), F.lit(1 << 52)) + 0.5) / (1 << 52)

    far, turn = F.sqrt(-2 * F.ln(uniform(3))) * shift_sigma, uniform(4) * 2 * math.pi
    return spark.range(n_images).select(
        F.col("id").alias("image_id"), (uniform(0) * 2 * math.pi).alias("phi"), F.acos(uniform(1) * 2 - 1).alias("theta"), (uniform(2) * 2 * math.pi).alias("psi"),
        (far * F.cos(turn)).alias("sx"), (far * F.sin(turn)).alias("sy"),
    )


def transfer(gx: np.ndarray, gy: np.ndarray, pixel_size: float, ctf: dict) -> np.ndarray:
    """The contrast transfer function on an image's coefficients, from its parameters (see functions.optics)."""
    n = len(gx)
    freq, angle = np.hypot(gx, gy) / (n * pixel_size), np.arctan2(gy, gx)
    volts = ctf["akv"] * 1e3
    lam = 12.2643247 / math.sqrt(volts + volts * volts * 0.978466e-6)
    defocus = 0.5 * (ctf["df1"] + ctf["df2"] + np.cos(2 * (angle - ctf["angast"])) * (ctf["df1"] - ctf["df2"]))
    phase = math.pi * lam * freq**2 * (defocus - 0.5 * ctf["cs"] * 1e7 * (lam * freq) ** 2)
    out = -math.sqrt(1 - ctf["wgh"] ** 2) * ctf["dscale"] * np.sin(phase) - ctf["wgh"] * ctf["dscale"] * np.cos(phase)
    return out * np.exp(-(ctf.get("bfactor", 0.0) / 4) * freq**2)


def project(posed: DataFrame, volume: np.ndarray, sigma: float, seed: int, optics: dict | None = None, pixel_size: float = 1.0) -> DataFrame:
    """Adds px: turned slice, shifted, times the contrast transfer function if optics are given, back to real
    space, with Gaussian noise seeded by the image's id. optics: akv, cs, wgh, dscale, bfactor, and df1, df2,
    angast unless the table has columns of these names. The volume travels in the closure: one volume,
    whatever the number of images."""
    own = [c for c in ("df1", "df2", "angast") if optics and c in posed.columns]
    f = centred_fft(volume, 3)
    n = volume.shape[0]
    axis = np.arange(n) - n // 2
    gx, gy = np.meshgrid(axis, axis, indexing="ij")

    def work(batches):
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("image_id", "phi", "theta", "psi", "sx", "sy")]
            px, rows = [], zip(*(batch.column(c).to_pylist() for c in own), strict=True) if own else iter([()] * batch.num_rows)
            for (i, phi, theta, psi, sx, sy), mine in zip(zip(*cols, strict=True), rows, strict=True):
                s = slice_of(f, rotation(phi, theta, psi)) * np.exp(2j * math.pi / n * (gx * sx + gy * sy))
                if optics:
                    s = s * transfer(gx, gy, pixel_size, optics | dict(zip(own, mine, strict=True)))
                px.append((centred_ifft(s, 2).real + np.random.default_rng([seed, i]).normal(0, sigma, (n, n))).ravel())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(px, pa.list_(pa.float64()))], names=[*batch.schema.names, "px"])

    from pyspark.sql.types import ArrayType, DoubleType, StructType

    return posed.mapInArrow(work, StructType(list(posed.schema.fields)).add("px", ArrayType(DoubleType())))
