"""Image operators on packed rows: one array an image, no row per pixel and no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackwright.operators.robust import MAD_TO_STD, median


def corner_values(px: Column, n: int, rad: float) -> Column:
    """The values of an n x n image outside the radius rad * n / 2 - 1.5, in the array's order."""
    least = (rad * n / 2 - 1.5) ** 2

    def outside(_: Column, i: Column) -> Column:
        x, y = F.floor(i / n) - n // 2, i % n - n // 2
        return x * x + y * y > least

    return F.filter(px, outside)


def mean_of(values: Column) -> Column:
    """Mean of an array; null if it is empty."""
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda s, v: s + v), F.size(values))


def float_packed(images: DataFrame, px: str, n: int, rad: float = 0.99) -> DataFrame:
    """Subtract each image's mean corner value. The mean is an argument of zip_with: in a lambda's body Spark would make it
    anew for each pixel, which is quadratic in the pixels, also if it is a column of its own before."""
    mean = mean_of(corner_values(F.col(px), n, rad))
    return images.withColumn(px, F.zip_with(px, F.array_repeat(mean, F.size(px)), lambda v, c: v - c))


def noise_variance_packed(images: DataFrame, px: str, n: int, kind: str = "robust", rad: float = 1.0) -> DataFrame:
    """(variance): of the corner values about 0, as the squared scaled median of their size, or their mean square (mle).
    Equal values are counted before the shuffle."""
    corners = images.select(F.explode(corner_values(F.col(px), n, rad)).alias("v"))
    if kind == "mle":
        return corners.agg(F.avg(F.col("v") * F.col("v")).alias("variance"))
    scale = MAD_TO_STD * F.col("off")
    return median(corners.select(F.abs("v").alias("off")), "off", [], "off").select((scale * scale).alias("variance"))


def data_variance_packed(images: DataFrame, px: str) -> DataFrame:
    """(variance): the mean over images of the mean square."""
    return images.agg(F.avg(mean_of(F.transform(px, lambda v: v * v))).alias("variance"))
