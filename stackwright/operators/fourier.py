"""Fourier transforms of packed images and volumes, in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def centred_fft(a: np.ndarray, dims: int) -> np.ndarray:
    """Unitary transform of the last axes, origin in the middle of both domains."""
    axes = tuple(range(-dims, 0))
    return np.fft.fftshift(np.fft.fftn(np.fft.ifftshift(a, axes), axes=axes, norm="ortho"), axes)


def centred_ifft(a: np.ndarray, dims: int) -> np.ndarray:
    axes = tuple(range(-dims, 0))
    return np.fft.fftshift(np.fft.ifftn(np.fft.ifftshift(a, axes), axes=axes, norm="ortho"), axes)


def _stack(column: pa.Array, n: int, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape((-1,) + (n,) * dims)


def _lists(a: np.ndarray) -> pa.ListArray:
    rows = a.reshape(len(a), -1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(np.ascontiguousarray(rows.ravel(), np.float64)))


def to_fourier(df: DataFrame, key: str, values: str, n: int, dims: int, pad: int = 0, multiplier: np.ndarray | None = None) -> DataFrame:
    """(key, re, im): packed coefficients. pad: zeros added on each side; multiplier: a separable factor
    along each axis of the padded array. Narrow, so any number of images streams through."""

    def work(batches):
        for batch in batches:
            a = np.pad(_stack(batch.column(values), n, dims), [(0, 0)] + [(pad, pad)] * dims)
            if multiplier is not None:
                for axis in range(1, dims + 1):
                    a = a * multiplier.reshape([-1 if k == axis else 1 for k in range(dims + 1)])
            f = centred_fft(a, dims)
            yield pa.RecordBatch.from_arrays([batch.column(key), _lists(f.real), _lists(f.imag)], names=[key, "re", "im"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, values).mapInArrow(work, f"{key} {kind}, re array<double>, im array<double>")


def to_real(df: DataFrame, key: str, n: int, dims: int) -> DataFrame:
    """(key, v): the real part of the inverse transform of (key, re, im)."""

    def work(batches):
        for batch in batches:
            f = _stack(batch.column("re"), n, dims) + 1j * _stack(batch.column("im"), n, dims)
            yield pa.RecordBatch.from_arrays([batch.column(key), _lists(centred_ifft(f, dims).real)], names=[key, "v"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, "re", "im").mapInArrow(work, f"{key} {kind}, v array<double>")


def premultiplier(n: int, kernel, half: int, oversampling: int = 64) -> np.ndarray:
    """1 / (n * transform of the interpolation kernel) along one axis: undoes the kernel's fall-off."""
    m = n * oversampling
    x = (np.arange(m) - m // 2) / oversampling
    samples = np.where(np.abs(x) <= half, kernel(x), 0.0)
    falloff = np.fft.fftshift(np.fft.fft(np.fft.ifftshift(samples))).real / oversampling
    return 1 / falloff[m // 2 - n // 2 : m // 2 - n // 2 + n]


def blur_taps(zoom: float) -> np.ndarray:
    """A Gaussian of width 0.66 / zoom, cut at four widths."""
    sigma = 0.66 / zoom
    radius = int(4 * sigma + 0.5)
    taps = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return taps / taps.sum()


def nearest(n: int, target: int) -> np.ndarray:
    """The element of n that each of `target` places takes, ends on ends, half up."""
    return np.minimum(np.floor(np.arange(target) * (n - 1) / max(target - 1, 1) + 0.5).astype(int), n - 1)


def resize(df: DataFrame, key: str, values: str, n: int, target: int, dims: int) -> DataFrame:
    """Blur by 0.66 of the shrinking factor, with zeros around the array, then take the nearest element."""
    taps, pick = blur_taps(target / n), nearest(n, target)

    def work(batches):
        radius = len(taps) // 2
        for batch in batches:
            a = _stack(batch.column(values), n, dims)
            for axis in range(1, dims + 1):
                padded = np.pad(a, [(radius, radius) if k == axis else (0, 0) for k in range(dims + 1)])
                a = sum(t * np.take(padded, np.arange(i, i + n), axis=axis) for i, t in enumerate(taps))
            for axis in range(1, dims + 1):
                a = np.take(a, pick, axis=axis)
            yield pa.RecordBatch.from_arrays([batch.column(key), _lists(a)], names=[key, "v"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, values).mapInArrow(work, f"{key} {kind}, v array<double>")
