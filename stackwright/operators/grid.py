"""Dense arrays in two forms: packed (one row, C-order array) and exploded (one row per element)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

AXES = "xyz"


def explode_array(df: DataFrame, values: str, n: int, dims: int, keep: list[str]) -> DataFrame:
    """(kept columns, x.., v): coordinates run from -n/2, the last axis fastest."""
    rows = df.select(*keep, F.posexplode(values).alias("_at", "v"))
    coords = {AXES[k]: (F.floor(F.col("_at") / n ** (dims - 1 - k)) % n - n // 2).cast("int") for k in range(dims)}
    return rows.select(*keep, *[c.alias(a) for a, c in coords.items()], F.col("v").cast("double").alias("v"))


def pack_array(df: DataFrame, n: int, dims: int, keys: list[str]) -> DataFrame:
    """The inverse of explode_array; absent elements are 0."""
    at = sum((F.col(AXES[k]) + n // 2) * n ** (dims - 1 - k) for k in range(dims))
    found = df.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(at.cast("int"), "v"))).alias("_m"))
    cells = F.sequence(F.lit(0), F.lit(n**dims - 1))
    return found.select(*keys, F.transform(cells, lambda i: F.coalesce(F.try_element_at(F.col("_m"), i), F.lit(0.0))).alias("v"))


def grid(spark: SparkSession, n: int, dims: int) -> DataFrame:
    """All coordinates [-n/2, n/2)**dims."""
    at = F.col("id")
    return spark.range(n**dims).select(*[(F.floor(at / n ** (dims - 1 - k)) % n - n // 2).cast("int").alias(AXES[k]) for k in range(dims)])


def radius2(dims: int) -> Column:
    return sum((F.col(AXES[k]) * F.col(AXES[k]) for k in range(1, dims)), F.col("x") * F.col("x"))


def inside(n: int, dims: int, rad: float, kind: str = "circ") -> Column:
    """Truncation mask: within the radius rad * n / 2, or within the square of that half side."""
    if kind == "circ":
        return radius2(dims) < (rad * n / 2) ** 2
    return F.greatest(*[F.abs(AXES[k]) for k in range(dims)]) < rad * n / 2


#: Rows of tables that describe the grid or the domain, not the data, up to which they are broadcast.
SMALL_ROWS = 1_000_000


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """The table with a broadcast hint if it has few rows (counted, unless the number is known)."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= SMALL_ROWS else df


def numbered_inside(spark: SparkSession, n: int, dims: int, rad: float) -> DataFrame:
    """(x.., at): the cells inside the radius, numbered in the order of the packed array."""
    cells = grid(spark, n, dims).where(inside(n, dims, rad))
    w = W.orderBy(*AXES[:dims])  # a grid's cells, whatever the data
    return cells.withColumn("at", F.row_number().over(w) - 1)


def full_to_truncated(spark: SparkSession, cells: DataFrame, n: int, dims: int, rad: float, key: str, values: tuple[str, ...] = ("v",)) -> DataFrame:
    """(key, at, values): the cells inside the radius as a vector."""
    return cells.join(small(numbered_inside(spark, n, dims, rad), n**dims), list(AXES[:dims])).select(key, "at", *values)


def truncated_to_full(spark: SparkSession, values: DataFrame, n: int, dims: int, keys: DataFrame, key: str) -> DataFrame:
    """Scatter coefficients inside a mask to the whole grid, 0 elsewhere."""
    axes = list(AXES[:dims])
    return keys.crossJoin(small(grid(spark, n, dims), n**dims)).join(values, [key, *axes], "left").select(key, *axes, F.coalesce("v", F.lit(0.0)).alias("v"))
