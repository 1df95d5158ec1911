"""Asymmetric sets, densities of orientations and packed coefficients against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stackwright.operators import fourier, linear, pairs, quadrature


def sphere(n, seed=0):
    v = np.random.default_rng(seed).normal(size=(n, 3))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.mark.parametrize("name, resolution", [("c1", 0.2), ("c4", 0.15), ("d3", 0.2), ("d2", 0.6)])
def test_one_of_each_orbit_is_kept(spark, name, resolution):
    """No two kept points meet, every other one meets a kept one; and the set is the one that a loop by rank finds."""
    v = sphere(500)
    v = np.vstack([v, *[v[:40] @ r.T for r in quadrature.symmetry_rotations(name)[1:3]]])  # whole orbits
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(v)], "i long, x double, y double, z double").repartition(5)
    labels = {r["i"]: r["label"] for r in quadrature.asymmetric_set(points, name, resolution).collect()}
    assert sorted(labels) == list(range(len(v))) and set(labels.values()) <= {1, -1}
    near = np.zeros((len(v), len(v)), bool)
    for r in quadrature.symmetry_rotations(name)[1:]:
        near |= v @ (v @ r.T).T >= math.cos(resolution)
    near |= near.T
    np.fill_diagonal(near, False)
    rank = points.select("i", (~quadrature.in_asymmetric_unit(name, F.col("x"), F.col("y"), F.col("z"))).alias("out"), F.xxhash64("i").alias("h")).orderBy("out", "h", "i").collect()
    kept = []
    for r in rank:
        if not near[r["i"], kept].any():
            kept.append(r["i"])
    assert sorted(kept) == sorted(i for i, x in labels.items() if x == 1)
    assert not near[np.ix_(kept, kept)].any()
    assert all(near[i, kept].any() for i, x in labels.items() if x == -1)


def quaternions(n, seed=0):
    q = np.random.default_rng(seed).normal(size=(n, 4))
    return q / np.linalg.norm(q, axis=1, keepdims=True)


def test_opposite_quaternions_are_one_orientation(spark):
    q, w = quaternions(60), np.random.default_rng(1).random(60)
    rows = lambda v: spark.createDataFrame([(i, *map(float, x), float(y)) for i, (x, y) in enumerate(zip(v, w))], "id long, p0 double, p1 double, p2 double, p3 double, w double")
    density = lambda points, samples, **k: np.array([p for _, p in sorted((r["id"], r["p"]) for r in pairs.bingham_density(rows(points).drop("w"), rows(samples), 50.0, **k).collect())])
    cos2 = (q @ q.T) ** 2
    s = np.maximum((np.exp(50.0 * (cos2 - 1)) * w * (cos2 >= 1 + math.log(1e-14) / 50)).sum(axis=1), 1e-14)
    assert density(q, q) == pytest.approx(s / s.sum(), rel=1e-9)
    signs = np.random.default_rng(2).choice([-1, 1], 60)[:, None]
    assert density(q * signs, q) == pytest.approx(s / s.sum(), rel=1e-9)
    # turning all points and samples alike changes nothing; a sample's images under the group are one
    t = quaternions(1, 5)[0]
    product = lambda a, b: np.array([float(x) for x in (a[0] * b[0] - a[1:] @ b[1:], *(a[0] * b[1:] + b[0] * a[1:] + np.cross(a[1:], b[1:])))])
    turned = np.array([product(t, x) for x in q])
    assert density(turned, turned) == pytest.approx(s / s.sum(), rel=1e-6)
    group = [(1.0, 0.0, 0.0, 0.0), (0.0, 0.0, 0.0, 1.0)]
    moved = np.array([product(np.array(group[1]), x) if i % 2 else x for i, x in enumerate(q)])
    assert density(q, moved, group=group) == pytest.approx(density(q, q, group=group), rel=1e-9)
    with pytest.raises(ValueError, match="whole sphere"):
        pairs.bingham_density(rows(q), rows(q), 10.0)
    assert pairs.bingham_kappa(0.3, 3) == pytest.approx(math.log(8) / (1 - math.cos(0.15) ** 2))


@pytest.mark.parametrize("n, dims", [(4, 3), (5, 3), (6, 2), (1, 2)])
def test_hermitian_vectors(spark, n, dims):
    """n**dims real numbers, as long as the volume, and back; products with packed gradients are those of the whole."""
    rng = np.random.default_rng(n)
    a, b = rng.normal(size=(2, *[n] * dims))
    fa, fb = fourier.centred_fft(a, dims).ravel(), fourier.centred_fft(b, dims).ravel()
    df = spark.createDataFrame([(k, i, float(f.real), float(f.imag)) for k, x in enumerate((fa, fb)) for i, f in enumerate(x)], "id int, at long, re double, im double").repartition(3)
    packed = linear.pack_hermitian(df, dims, n)
    vectors = [{r["k"]: r["value"] for r in packed.where(F.col("id") == k).collect()} for k in (0, 1)]
    assert len(vectors[0]) == n**dims
    assert sum(x * x for x in vectors[0].values()) == pytest.approx((a * a).sum())
    assert sum(vectors[0][k] * vectors[1][k] for k in vectors[0]) == pytest.approx((a * b).sum())
    back = {(r["id"], r["at"]): complex(r["re"], r["im"]) for r in linear.unpack_hermitian(packed, dims, n).collect()}
    assert len(back) == 2 * n**dims
    for k, f in enumerate((fa, fb)):
        assert [back[k, i] for i in range(n**dims)] == pytest.approx(f.tolist())


def test_corners_that_round_to_zero_keep_their_sign(spark, tmp_path):
    """As the SQL's do: in arrays -0.0 and 0.0 are different elements."""
    import compare
    from stackwright.plans import queries_images, registry  # noqa: F401  registers the query

    v = [[-1e-7, 1e-7, -0.0, 0.0, -6e-7, 6e-7, None, float("nan")] * 8, [0.5] * 64]
    spark.createDataFrame([(i, x, 0) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    found = {(r["id"], r["x"], r["y"]): repr(r["corners"]) for r in registry.QUERIES["cell_layout"](spark, str(tmp_path)).collect()}
    sql = registry.ORACLES["cell_layout"].replace("from embeddings", f"from '{tmp_path}/embeddings.parquet/*.parquet'")
    columns, rows = compare.oracle("/root/testdata/sf0.001", sql)
    assert found == {(r[0], r[1], r[2]): repr(r[3]) for r in rows}
    assert any("-0.0" in c for c in found.values())
