"""Interpolation kernels in closed form, chosen by name."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sinc(x: Column) -> Column:
    t = x * math.pi
    return F.when(F.abs(x) < 1e-9, F.lit(1.0)).otherwise(F.sin(t) / F.when(F.abs(x) < 1e-9, F.lit(1.0)).otherwise(t))


def linear(x: Column, size: int = 2) -> Column:
    return F.greatest(1 - F.abs(x), F.lit(0.0))


def sinc(x: Column, size: int) -> Column:
    return F.when(F.abs(x) < size / 2, _sinc(x)).otherwise(F.lit(0.0))


def lanczos(x: Column, size: int) -> Column:
    """Windowed by the sinc's main lobe stretched to the kernel's half size (real halves for odd sizes)."""
    return F.when(F.abs(x) < size / 2, _sinc(x) * _sinc(x / (size / 2))).otherwise(F.lit(0.0))


def quadratic(x: Column, size: int = 2) -> Column:
    """Two parabolas that meet at half a unit; 1 at 0 and 0 from one unit on."""
    a = F.abs(x)
    return F.when(a <= 0.5, 1 - 2 * a * a).when(a < 1, 2 * (1 - a) * (1 - a)).otherwise(F.lit(0.0))


KERNELS: dict[str, Callable[..., Column]] = {"linear": linear, "sinc": sinc, "lanczos": lanczos, "quad": quadratic}


def taps(coord: Column, size: int) -> Column:
    """The integer places that a kernel of this size weighs: from the floor for even sizes, around the
    nearest place for odd ones."""
    base = F.floor(coord) if size % 2 == 0 else F.round(coord)
    first = base - ((size - 1) // 2)
    return F.sequence(first.cast("int"), (first + size - 1).cast("int"))
