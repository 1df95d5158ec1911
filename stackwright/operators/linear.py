"""Sparse operators as coordinate tables, interpolation, symmetrisation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stackwright.functions import geometry
from stackwright.functions.kernels import KERNELS, taps
from stackwright.operators.grid import AXES, numbered_inside, small


def matvec(matrix: DataFrame, vector: DataFrame, transposed: bool = False, values: tuple[str, ...] = ("x",)) -> DataFrame:
    """Sums of val * x: matrix (row, col, val), vector (col, values...); transposed: from rows to columns.
    Partial sums are made before the shuffle; complex vectors give two values."""
    on, out = ("row", "col") if transposed else ("col", "row")
    found = matrix.join(vector.withColumnRenamed("at", on), on)
    return found.groupBy(out).agg(*[F.sum(F.col("val") * F.col(v)).alias(v) for v in values])


def interpolation_taps(points: DataFrame, dims: int, n: int, kernel: str = "linear", size: int = 2, keep: list[str] | None = None) -> DataFrame:
    """One row per point and grid cell that its kernel weighs: (kept columns, x.., weight). Points have
    coordinates p0..; taps outside the grid are dropped."""
    keep = keep or ["id"]
    rows = points
    weight = F.lit(1.0)
    for k in range(dims):
        rows = rows.withColumn(AXES[k], F.explode(taps(F.col(f"p{k}"), size)))
        rows = rows.where(F.col(AXES[k]).between(-(n // 2), n - n // 2 - 1))
        weight = weight * KERNELS[kernel](F.col(f"p{k}") - F.col(AXES[k]), size)
    return rows.withColumn("weight", weight).where("weight != 0").select(*keep, *AXES[:dims], "weight")


def held(points: DataFrame, dims: int, n: int) -> DataFrame:
    """The points that lie in the grid, its outermost cells included."""
    ok = F.lit(True)
    for k in range(dims):
        ok = ok & F.col(f"p{k}").between(-(n // 2), n - n // 2 - 1)
    return points.where(ok)


def sample_at(cells: DataFrame, points: DataFrame, dims: int, n: int, kernel: str = "linear", size: int = 2, key: str | None = None, values: tuple[str, ...] = ("v",)) -> DataFrame:
    """Interpolated values at points, taps beyond the grid left out; complex cells have two values. With key,
    for each volume of a stack: the taps are a property of the points, so they are computed once and joined
    to all volumes."""
    t = interpolation_taps(points, dims, n, kernel, size)
    found = cells.join(small(t), list(AXES[:dims]))
    return found.groupBy(*([key] if key else []), "id").agg(*[F.sum(F.col("weight") * F.col(v)).alias(v) for v in values])


def turned_points(points: DataFrame, rotations: DataFrame, dims: int = 3) -> DataFrame:
    """Every point under every rotation (op, r00..): the group's order is a small constant."""
    rows = points.crossJoin(F.broadcast(rotations))
    return rows.select("id", "op", *[sum((F.col(f"r{i}{j}") * F.col(f"p{j}") for j in range(1, dims)), F.col(f"r{i}0") * F.col("p0")).alias(f"p{i}") for i in range(dims)])


def symmetrise(cells: DataFrame, grid_points: DataFrame, rotations: DataFrame, dims: int, n: int, key: str, kernel: str = "linear", size: int = 2, normalise: bool = True, values: tuple[str, ...] = ("v",)) -> DataFrame:
    """Sum (mean if normalised) of a volume over the group's rotations: (key, id, values). A point that a
    rotation takes out of the grid gets nothing from that rotation. With two dimensions, volumes are turned
    plane by plane about z, which the result has too."""
    order = rotations.count()
    turned = held(turned_points(grid_points, rotations, dims), dims, n)
    t = interpolation_taps(turned, dims, n, kernel, size, ["id"])
    # taps of all rotations on one cell are added before they meet the volumes
    t = t.groupBy("id", *AXES[:dims]).agg((F.sum("weight") / (order if normalise else 1)).alias("weight"))
    planes = ["z"] if dims == 2 and "z" in cells.columns else []
    return cells.join(small(t), list(AXES[:dims])).groupBy(key, "id", *planes).agg(*[F.sum(F.col("weight") * F.col(v)).alias(v) for v in values])


def projection_matrix(spark: SparkSession, directions: DataFrame, n: int, rad: float, kernel: str = "linear", size: int = 2) -> DataFrame:
    """(id, row, x, y, z, weight): for each direction (id, dx, dy, dz) the weights of a volume's coefficients in
    each coefficient of its central slice inside the radius."""
    m = geometry.from_direction(F.col("dx"), F.col("dy"), F.col("dz"))
    return _slices(spark, directions, m, 3, n, n, rad, kernel, size)


def inplane_matrix(spark: SparkSession, angles: DataFrame, n: int, rad: float, kernel: str = "linear", size: int = 2, n_source: int | None = None) -> DataFrame:
    """(id, row, x, y, weight): the same for in-plane turns (id, theta) of an image, whose source may be padded
    to n_source."""
    scale = (n_source or n) / n
    m = [[c * scale for c in row] for row in geometry.plane_turn(F.col("theta"))]
    return _slices(spark, angles, m, 2, n, n_source or n, rad, kernel, size)


def _slices(spark: SparkSession, turns: DataFrame, m: geometry.Matrix, dims: int, n: int, n_source: int, rad: float, kernel: str, size: int) -> DataFrame:
    cells = numbered_inside(spark, n, 2, rad).select(F.col("at").alias("row"), F.col("x").alias("gx"), F.col("y").alias("gy"))
    points = turns.crossJoin(small(cells, n * n)).select("id", "row", *[(m[k][0] * F.col("gx") + m[k][1] * F.col("gy")).alias(f"p{k}") for k in range(dims)])
    t = interpolation_taps(points, dims, n_source, kernel, size, ["id", "row"])
    return t.withColumn("weight", F.col("weight") * projection_scale(n_source, n, dims, 2))


def projection_scale(n_source: int, n_target: int, source_dims: int, target_dims: int, symmetry: int = 1) -> float:
    return (n_source / n_target) * n_target ** ((source_dims - target_dims) / 2) / symmetry


def cell_corners(cells: DataFrame, dims: int, n: int) -> DataFrame:
    """Gather layout: each cell with the values of its 2**dims neighbours towards larger coordinates,
    wrapped around. Volumes have a key column `id`."""
    half = n // 2
    moves = F.explode(F.array(*[F.struct(*[F.lit(c >> k & 1).alias(f"d{k}") for k in range(dims)], F.lit(c).alias("corner")) for c in range(2**dims)]))
    rows = cells.withColumn("m", moves)
    owner = {AXES[k]: (F.pmod(F.col(AXES[k]) - F.col(f"m.d{k}") + half, F.lit(n)) - half).cast("int") for k in range(dims)}
    rows = rows.select("id", *[v.alias(k) for k, v in owner.items()], F.col("m.corner").alias("corner"), "v")
    return rows.groupBy("id", *AXES[:dims]).agg(F.transform(F.array_sort(F.collect_list(F.struct("corner", "v"))), lambda s: s["v"]).alias("corners"))


def cells_from_corners(layout: DataFrame, dims: int, n: int) -> DataFrame:
    """The transpose of cell_corners: every corner's value is added to the cell it came from."""
    half = n // 2
    rows = layout.select("id", *AXES[:dims], F.posexplode("corners").alias("corner", "v"))
    moved = {AXES[k]: (F.pmod(F.col(AXES[k]) + F.floor(F.col("corner") / 2**k) % 2 + half, F.lit(n)) - half).cast("int") for k in range(dims)}
    return rows.select("id", *[c.alias(a) for a, c in moved.items()], "v").groupBy("id", *AXES[:dims]).agg(F.sum("v").alias("v"))


def rotate_volume(cells: DataFrame, grid_points: DataFrame, rotation: list[list[float]], n: int, key: str, shift: tuple[float, float, float] = (0.0, 0.0, 0.0), upsampling: float = 1.0) -> DataFrame:
    """(key, id, v): volumes turned by a matrix about a shifted centre, trilinear, 0 outside. Grid points are
    those of the result, whose cells are 1 / upsampling wide."""
    p = [F.col(f"p{j}") / upsampling for j in range(3)]
    turned = grid_points.select("id", *[(sum((F.lit(rotation[i][j]) * p[j] for j in (1, 2)), F.lit(rotation[i][0]) * p[0]) + shift[i]).alias(f"p{i}") for i in range(3)])
    keys = cells.select(key).distinct()
    found = sample_at(cells, held(turned, 3, n), 3, n, key=key)
    return keys.crossJoin(small(turned.select("id"))).join(found, [key, "id"], "left").select(key, "id", F.coalesce("v", F.lit(0.0)).alias("v"))


def hermitian_part(cells: DataFrame, dims: int, n: int) -> DataFrame:
    """The mean of each coefficient and the conjugate of its mirror, wrapped around."""
    half = n // 2
    mirror = {AXES[k]: (F.pmod(-F.col(AXES[k]) + half, F.lit(n)) - half).cast("int") for k in range(dims)}
    both = cells.unionByName(cells.select("id", *[v.alias(k) for k, v in mirror.items()], "re", (-F.col("im")).alias("im")))
    return both.groupBy("id", *AXES[:dims]).agg((F.sum("re") / 2).alias("re"), (F.sum("im") / 2).alias("im"))


def hermitian_residual(cells: DataFrame, dims: int, n: int) -> DataFrame:
    """(id, residual): the norm of what hermitian_part takes away."""
    part = hermitian_part(cells, dims, n).withColumnsRenamed({"re": "_re", "im": "_im"})
    rows = cells.join(part, ["id", *AXES[:dims]])
    return rows.groupBy("id").agg(F.sqrt(F.sum((F.col("re") - F.col("_re")) ** 2 + (F.col("im") - F.col("_im")) ** 2)).alias("residual"))


def _mirror_place(at: Column, dims: int, n: int) -> Column:
    """The place in the packed array of a place's conjugate."""
    out, half = F.lit(0).cast("long"), n // 2
    for k in range(dims):
        c = F.floor(at / n ** (dims - 1 - k)) % n - half
        out = out * n + F.pmod(-c + half, F.lit(n))
    return out


def pack_hermitian(coefficients: DataFrame, dims: int, n: int, key: str = "id") -> DataFrame:
    """(key, k, value): a real parameter vector for coefficients (key, at, re, im) of a real volume, at places of the packed array. Of each
    conjugate pair the first place is kept, with the root of 2 as weight, so lengths and products stay; places that are their
    own conjugates have a real part alone. Element 2 * at is a real part, 2 * at + 1 an imaginary one. The map is
    orthogonal: gradients are packed by the same function."""
    mirror = _mirror_place(F.col("at"), dims, n)
    rows = coefficients.where(F.col("at") <= mirror).withColumn("_w", F.when(F.col("at") == mirror, 1.0).otherwise(math.sqrt(2)))
    parts = F.inline(F.when(F.col("at") == mirror, F.array(F.struct((2 * F.col("at")).alias("k"), F.col("re").alias("value")))).otherwise(F.array(F.struct((2 * F.col("at")).alias("k"), (F.col("_w") * F.col("re")).alias("value")), F.struct((2 * F.col("at") + 1).alias("k"), (F.col("_w") * F.col("im")).alias("value")))))
    return rows.select(key, parts)


def unpack_hermitian(vector: DataFrame, dims: int, n: int, key: str = "id") -> DataFrame:
    """(key, at, re, im) of all places: the inverse of pack_hermitian."""
    at = F.floor(F.col("k") / 2)
    rows = vector.groupBy(key, at.alias("at")).agg(F.sum(F.when(F.col("k") % 2 == 0, F.col("value"))).alias("re"), F.coalesce(F.sum(F.when(F.col("k") % 2 == 1, F.col("value"))), F.lit(0.0)).alias("im"))
    mirror = _mirror_place(F.col("at"), dims, n)
    w = math.sqrt(0.5)
    both = F.array(F.struct(F.col("at").alias("at"), (w * F.col("re")).alias("re"), (w * F.col("im")).alias("im")), F.struct(mirror.alias("at"), (w * F.col("re")).alias("re"), (-w * F.col("im")).alias("im")))
    alone = F.array(F.struct(F.col("at").alias("at"), F.col("re").alias("re"), F.lit(0.0).alias("im")))
    return rows.select(key, F.inline(F.when(F.col("at") == mirror, alone).otherwise(both)))


def separable_window(dims: int, n: int, kind: str, radius: float | None = None) -> Column:
    """Window of a volume: a product of tapers, a circle (of radius * n / 2, n / 2 - 1 by default), or a box
    that zeroes the three lines along the axes through the grid's first cell."""
    axes = [F.col(AXES[k]) for k in range(dims)]
    if kind == "circle":
        edge = n // 2 - 1 if radius is None else radius * (n // 2)
        return F.when(sum((a * a for a in axes[1:]), axes[0] * axes[0]) < edge**2, 1.0).otherwise(0.0)
    if kind == "box":
        first = [(a == -(n // 2)).cast("int") for a in axes]
        return F.when(sum(first[1:], first[0]) >= dims - 1, 0.0).otherwise(1.0)
    a, b = {"hanning": (0.5, 0.5), "hamming": (0.54, 0.46)}[kind]
    out = F.lit(1.0)
    for axis in axes:
        out = out * (a - b * F.cos((axis + n // 2) * (2 * 3.141592653589793 / (n - 1))))
    return out
