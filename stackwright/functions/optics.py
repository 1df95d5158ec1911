"""Microscope optics as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def wavelength(kilovolts: Column) -> Column:
    """Relativistic electron wavelength in Angstrom."""
    volts = kilovolts * 1e3
    return 12.2643247 / F.sqrt(volts + volts * volts * 0.978466e-6)


def envelope(freq: Column, bfactor: Column) -> Column:
    """B-factor envelope."""
    return F.exp(-(bfactor / 4) * freq * freq)


def envelope_curve(spark: SparkSession, n: int, pixel_size: float, bfactor: float) -> DataFrame:
    """(i, freq, envelope) from 0 to the highest frequency of an n x n image."""
    freq = F.col("id") / (n * pixel_size)
    return spark.range(n // 2 + 1).select(F.col("id").cast("int").alias("i"), freq.alias("freq"), envelope(freq, F.lit(bfactor)).alias("envelope"))


def scaled(optics: DataFrame, factor: float) -> DataFrame:
    """Optics whose amplitude, dscale, is multiplied; -1 flips the sign."""
    return optics.withColumn("dscale", F.col("dscale") * factor)


def with_sign(optics: DataFrame, sign: int) -> DataFrame:
    return optics.withColumn("dscale", sign * F.abs("dscale"))


def contrast_transfer(freq: Column, angle: Column, akv: Column, cs: Column, wgh: Column, df1: Column, df2: Column, angast: Column, dscale: Column, bfactor: Column | None = None, turned: Column | None = None) -> Column:
    """Contrast transfer function. freq in 1/Angstrom, angles in radians, cs in mm, defocus in Angstrom;
    turned: in-plane rotation added to the angle."""
    if turned is not None:
        angle = F.pmod(angle + turned, F.lit(2 * math.pi))
    lam = wavelength(akv)
    plf2 = math.pi * lam * freq * freq
    defocus = 0.5 * (df1 + df2 + F.cos(2 * (angle - angast)) * (df1 - df2))
    phase = plf2 * defocus - 0.5 * plf2 * (cs * 1e7) * (lam * freq) * (lam * freq)
    out = -F.sqrt(1 - wgh * wgh) * dscale * F.sin(phase) - wgh * dscale * F.cos(phase)
    return out if bfactor is None else out * envelope(freq, bfactor)


def shift_phase(x: Column, y: Column, sx: Column, sy: Column, n: int) -> tuple[Column, Column]:
    """Real and imaginary part of the phase by which a translation multiplies a Fourier coefficient."""
    t = (x * sx + y * sy) * (2 * math.pi / n)
    return F.cos(t), F.sin(t)


def max_angle(n: int, radius: float, oversampling: float = 1.0) -> float:
    """Largest angular step that resolves frequencies up to the radius."""
    r2 = (radius * n / 2) ** 2
    return 0.5 * math.acos((r2 - 1) / (r2 + 1)) * oversampling
