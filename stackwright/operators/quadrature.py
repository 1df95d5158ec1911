"""Quadrature points as tables, symmetry groups, angular domains."""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stackwright.operators.pairs import BLOCK
from stackwright.staging import stage


def spiral_sphere(spark: SparkSession, n: int) -> DataFrame:
    """(i, x, y, z, weight): n points on a spiral from pole to pole, equal weights that sum to 4 pi."""
    h = -1 + F.col("i") * (2.0 / (n - 1))
    inner = F.col("i").between(1, n - 2)
    step = F.when(inner, (3.6 / math.sqrt(n)) / F.sqrt(1 - F.when(inner, h * h).otherwise(0.0))).otherwise(0.0)
    rows = spark.range(n).select(F.col("id").cast("int").alias("i"))
    turned = rows.select("i", h.alias("h"), F.sum(step).over(W.orderBy("i").rowsBetween(W.unboundedPreceding, 0)).alias("t"))
    phi = F.when(inner, F.col("t")).otherwise(0.0)
    r = F.sqrt(F.greatest(1 - F.col("h") * F.col("h"), F.lit(0.0)))
    return turned.select("i", (F.cos(phi) * r).alias("x"), (F.sin(phi) * r).alias("y"), F.col("h").alias("z"), F.lit(4 * math.pi / n).alias("weight"))


def spiral_degree(max_angle: float) -> int:
    return math.ceil((3.6 / max_angle) ** 2)


def icosphere(depth: int) -> np.ndarray:
    """Vertices of an icosahedron whose triangles were split `depth` times."""
    g = (1 + math.sqrt(5)) / 2
    base = [(0, s, t * g) for s in (-1, 1) for t in (-1, 1)]
    v = np.array([p[k:] + p[:k] for p in base for k in range(3)], float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    near = v @ v.T > 0.4
    faces = np.array([(a, b, c) for a in range(12) for b in range(a) for c in range(b) if near[a, b] and near[b, c] and near[a, c]])
    for _ in range(depth):
        edges = np.unique(np.sort(faces[:, [[0, 1], [1, 2], [0, 2]]].reshape(-1, 2), axis=1), axis=0)
        at = {tuple(e): len(v) + i for i, e in enumerate(edges.tolist())}
        middle = v[edges].sum(axis=1)
        v = np.vstack([v, middle / np.linalg.norm(middle, axis=1, keepdims=True)])
        halves = [[at[tuple(sorted((f[i], f[j])))] for i, j in ((0, 1), (1, 2), (0, 2))] for f in faces.tolist()]
        faces = np.array([t for f, (p, q, r) in zip(faces.tolist(), halves, strict=True) for t in ((f[0], p, r), (f[1], p, q), (f[2], q, r), (p, q, r))])
    return v


def icosphere_points(spark: SparkSession, depth: int) -> DataFrame:
    v = icosphere(depth)
    rows = [(i, *map(float, p), 4 * math.pi / len(v)) for i, p in enumerate(v)]
    return spark.createDataFrame(rows, "i int, x double, y double, z double, weight double")


def shift_nodes(kind: str, degree: int, sigma: float, extent: float) -> tuple[list[float], list[float]]:
    """Nodes and weights on a line: Gauss-Hermite for a normal prior, Gauss-Legendre times the prior's
    density where sigma is finite."""
    if degree == 1:
        return [0.0], [1.0]
    if kind == "hermite":
        x, w = np.polynomial.hermite.hermgauss(degree)
        x = x * math.sqrt(2) * sigma
        keep = np.abs(x) < extent
        return x[keep].tolist(), w[keep].tolist()
    x, w = np.polynomial.legendre.leggauss(degree)
    x = x * extent
    if math.isfinite(sigma):
        w = w * np.exp(-(x**2) / (2 * sigma**2))
    return x.tolist(), w.tolist()


def shift_degree(extent: float, rad: float, oversampling: float) -> int:
    return 1 + 2 * int(round(extent * rad / oversampling))


def shift_grid(spark: SparkSession, nodes: list[float], weights: list[float], extent: float, circular: bool = True) -> DataFrame:
    """(sx, sy, weight): the product of two lines, inside the circle if wanted, weights summing to 1."""
    line = spark.createDataFrame(list(zip(nodes, weights, strict=True)), "s double, w double")
    both = line.select(F.col("s").alias("sx"), F.col("w").alias("wx")).crossJoin(F.broadcast(line.select(F.col("s").alias("sy"), F.col("w").alias("wy"))))
    if circular:
        both = both.where(F.col("sx") * F.col("sx") + F.col("sy") * F.col("sy") < extent * extent)
    w = F.col("wx") * F.col("wy")
    return both.select("sx", "sy", (w / F.sum(w).over(W.partitionBy())).alias("weight"))


def circle_grid(spark: SparkSession, max_angle: float) -> DataFrame:
    """(i, theta, weight): in-plane angles, half a step from 0, weights summing to 2 pi."""
    n = math.ceil(2 * math.pi / max_angle)
    step = 2 * math.pi / n
    return spark.range(n).select(F.col("id").cast("int").alias("i"), ((F.col("id") + 0.5) * step).alias("theta"), F.lit(step).alias("weight"))


SCHEMES = {("dir", "spiral"): spiral_sphere, ("dir", "icosphere"): icosphere_points, ("shift", "hermite"): shift_nodes, ("shift", "legendre"): shift_nodes, ("inplane", "uniform"): circle_grid}


def parse_symmetry(name: str) -> tuple[str, int]:
    """Class letter and order of Cn or Dn; an empty name is C1."""
    m = re.fullmatch(r"([cd])([0-9]+)", name.strip().lower() or "c1")
    if not m or int(m[2]) < 1:
        raise ValueError(f"unknown symmetry {name!r}")
    return m[1], int(m[2])


def symmetry_rotations(name: str) -> list[np.ndarray]:
    """All rotations of the group, the identity first."""
    kind, n = parse_symmetry(name)
    turn = [np.array([[math.cos(t), -math.sin(t), 0], [math.sin(t), math.cos(t), 0], [0, 0, 1.0]]) for t in (2 * math.pi * k / n for k in range(n))]
    return turn if kind == "c" else turn + [r @ np.diag([1.0, -1.0, -1.0]) for r in turn]


def symmetry_table(spark: SparkSession, name: str) -> DataFrame:
    rows = [(i, *map(float, r.ravel())) for i, r in enumerate(symmetry_rotations(name))]
    return spark.createDataFrame(rows, "op int, " + ", ".join(f"r{i}{j} double" for i in range(3) for j in range(3)))


def in_asymmetric_unit(name: str, x: Column, y: Column, z: Column, eps: float = 1e-8) -> Column:
    """True for the directions of one unit: azimuth within half a turn's share, both edges included, upper
    half for Dn; C1 has no limit."""
    kind, n = parse_symmetry(name)
    azimuth = F.atan2(y, x)
    half = math.pi / n
    wedge = F.lit(True) if n == 1 else azimuth.between(-half - eps, half + eps)
    length = F.sqrt(x * x + y * y + z * z)
    return wedge & (F.acos(z / length) <= math.pi / 2 + eps) if kind == "d" else wedge


def asymmetric_points(points: DataFrame, name: str) -> DataFrame:
    """The points of the asymmetric unit, their weights scaled to the same sum as before."""
    inside = in_asymmetric_unit(name, F.col("x"), F.col("y"), F.col("z"))
    sums = points.agg((F.sum("weight") / F.sum(F.when(inside, F.col("weight")))).alias("_share"))
    return points.where(inside).crossJoin(F.broadcast(sums)).withColumn("weight", F.col("weight") * F.col("_share")).drop("_share")


def asymmetric_set(points: DataFrame, name: str, resolution: float) -> DataFrame:
    """(i, label): 1 for directions (i, x, y, z) that are kept as the asymmetric unit, -1 for those that a rotation of the group
    other than the identity brings within the resolution of a kept one. No two kept ones meet in this way.

    In each round a direction that comes before all undecided ones that it meets is kept, and those that meet it go. Directions in the
    unit by its formula come first, so they are decided among themselves; then a hash decides. Directions meet the others'
    images in cells, and a task passes on the first one met, so no pair is written. Nothing but counts comes to the driver."""
    turns = [r.tolist() for r in symmetry_rotations(name)[1:]]
    if not turns:
        return points.select("i", F.lit(1).alias("label"))
    inside = F.coalesce(in_asymmetric_unit(name, F.col("x"), F.col("y"), F.col("z")), F.lit(False))
    nodes = stage(points.select("i", (~inside).alias("outside"), F.xxhash64("i").alias("hash"), *[F.col(a).cast("double").alias(f"p{k}") for k, a in enumerate("xyz")]), "undecided")
    radius, labels = 2 * math.sin(resolution / 2), []
    for left in (nodes.where("not outside"), nodes.where("outside")):
        for kept in [rows for rows, label in labels if label == 1]:
            gone = stage(first_met(left, kept, turns, radius).select("i"), "decided")
            labels.append((gone, -1))
            left = stage(left.join(gone, "i", "left_anti"), "undecided")
        while not left.isEmpty():
            # whoever meets none before it is kept; the others keep waiting or go
            first = first_met(left, left, turns, radius)
            waiting = stage(left.join(first, "i").where(F.struct("outside", "hash", "i") > F.col("first")).drop("first"), "waiting")
            kept = stage(left.join(waiting.select("i"), "i", "left_anti"), "decided")
            gone = stage(first_met(waiting, kept, turns, radius).select("i"), "decided")
            labels += [(kept, 1), (gone, -1)]
            left = stage(waiting.join(gone, "i", "left_anti"), "undecided")
    out = nodes.limit(0).select("i", F.lit(1).alias("label"))
    for rows, label in labels:
        out = out.unionByName(rows.select("i", F.lit(label).alias("label")))
    return out


def first_met(points: DataFrame, others: DataFrame, turns: list[list[list[float]]], radius: float) -> DataFrame:
    """(i, first): for the points (i, p0..p2) that a rotation brings one of the others (i, outside, hash, p0..p2) close to, the
    first of those in order of (outside, hash, i). Points look around themselves in cells, images lie in theirs; cells with
    many images are dealt on by a hash of both sides."""
    at = ["p0", "p1", "p2"]
    cell = [F.floor(F.col(a) / radius) for a in at]
    turned = F.explode(F.array(*[F.struct(*[sum((r[i][j] * F.col(f"p{j}") for j in (1, 2)), r[i][0] * F.col("p0")).alias(f"p{i}") for i in range(3)]) for r in turns]))
    images = others.dropna(subset=at).select("i", "outside", "hash", turned.alias("_t")).select("i", "outside", "hash", "_t.*").select("*", *[c.alias(f"c{k}") for k, c in enumerate(cell)])
    parts = max(1, math.ceil((images.groupBy("c0", "c1", "c2").count().agg(F.max("count")).first()[0] or 0) / BLOCK))
    every = F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))
    share = F.pmod(F.xxhash64("i"), F.lit(parts))
    keys = ["c0", "c1", "c2", "u", "v"]
    around = F.inline(F.array(*[F.struct(*[(cell[k] + (n // 3**k % 3 - 1)).alias(f"c{k}") for k in range(3)]) for n in range(27)]))
    mine = points.dropna(subset=at).select("i", *at, around).select("i", *at, *keys[:3], share.alias("u"), F.explode(every).alias("v"))
    theirs = images.select("i", "outside", "hash", *at, *keys[:3], share.alias("v"), F.explode(every).alias("u"))

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        first = np.full(len(left), -1)
        if len(left) and len(right):
            right = right.sort_by([("outside", "ascending"), ("hash", "ascending"), ("i", "ascending")])
            a, b = (np.array([t.column(c).to_numpy() for c in at]) for t in (left, right))
            ids, other = left.column("i").to_numpy(), right.column("i").to_numpy()
            for i in range(0, len(left), 128):
                for j in range(0, len(right), 512):
                    d2 = sum(np.square(np.subtract.outer(x[i : i + 128], y[j : j + 512])) for x, y in zip(a, b, strict=True))
                    met = (d2 <= radius * radius) & np.not_equal.outer(ids[i : i + 128], other[j : j + 512])
                    found, now = met.argmax(axis=1), first[i : i + 128]
                    new = met[np.arange(len(met)), found] & (now < 0)
                    now[new] = found[new] + j
        hit = np.flatnonzero(first >= 0)
        best = right.take(first[hit])
        return pa.table([left.column("i").take(hit), best.column("outside"), best.column("hash"), best.column("i")], names=["i", "outside", "hash", "other"])

    kind = points.schema["i"].dataType.simpleString()
    met = mine.groupBy(*keys).cogroup(theirs.groupBy(*keys)).applyInArrow(work, f"i {kind}, outside boolean, hash long, other {kind}")
    return met.groupBy("i").agg(F.min(F.struct("outside", "hash", F.col("other").alias("i"))).alias("first"))


def symmetry_columns(name: Column) -> tuple[Column, Column]:
    """parse_symmetry as columns: class letter and order; an empty name is C1, others that don't parse null."""
    text = F.when(F.trim(name) == "", "c1").otherwise(F.lower(F.trim(name)))
    ok = F.regexp_like(text, F.lit("^[cd]0*[1-9][0-9]*$"))
    return F.when(ok, F.substring(text, 1, 1)), F.when(ok, F.regexp_extract(text, "([0-9]+)$", 1).cast("int"))


def domain_version(points: list) -> str:
    """A content hash: domains with equal points have equal operators."""
    return hashlib.sha256(repr(points).encode()).hexdigest()[:16]
