"""Operators against NumPy, and their properties."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stackwright.functions import geometry, kernels, optics
from stackwright.operators import fourier, grid, likelihood, objectives, pairs, probability, quadrature, radial, robust, sampler_state, sequence
from stackwright.plans import monitor, optimizer, reconstruct
from stackwright.sources import mrc, star, synthetic, text_tables


def test_fft_is_unitary_and_inverts():
    a = np.random.default_rng(0).normal(size=(3, 6, 6))
    f = fourier.centred_fft(a, 2)
    assert np.allclose((np.abs(f) ** 2).sum(), (a**2).sum())
    assert np.allclose(fourier.centred_ifft(f, 2).real, a)


def test_projection_slice():
    v = synthetic.blob_volume(8, 5, 1.5, 1)
    s = synthetic.slice_of(fourier.centred_fft(v, 3), np.eye(3))
    assert np.allclose(fourier.centred_ifft(s, 2).real, v.sum(axis=2) / math.sqrt(8))


def test_premultiplier_flattens_the_kernel():
    coarse, fine = (fourier.premultiplier(16, lambda x: np.maximum(1 - np.abs(x), 0), 1, o) for o in (64, 256))
    assert np.allclose(coarse, fine, atol=1e-3)
    assert fine[8] == pytest.approx(1, abs=1e-3)


def test_rotations_are_orthogonal(spark):
    m = geometry.as_column(geometry.from_rotation_vector(F.lit(0.3), F.lit(-0.2), F.lit(0.5)))
    r = np.array(spark.range(1).select(m.alias("m")).first()["m"])
    assert np.allclose(r @ r.T, np.eye(3))
    e = np.array(spark.range(1).select(geometry.as_column(geometry.from_euler(F.lit(0.3), F.lit(0.8), F.lit(-1.1))).alias("m")).first()["m"])
    assert np.allclose(e, synthetic.rotation(0.3, 0.8, -1.1))
    down = np.array(spark.range(1).select(geometry.as_column(geometry.from_direction(F.lit(0.0), F.lit(0.0), F.lit(-1.0))).alias("m")).first()["m"])
    assert np.allclose(down, np.diag([1, -1, -1]))


def test_turned_optics_equal_a_turned_grid(spark):
    args = [F.lit(x) for x in (200.0, 2.0, 0.07, 15000.0, 12000.0, 0.4, 1.0)]
    a = optics.contrast_transfer(F.lit(0.05), F.lit(1.0), *args, turned=F.lit(0.5))
    b = optics.contrast_transfer(F.lit(0.05), F.lit(1.5), *args)
    x, y = spark.range(1).select(a.alias("a"), b.alias("b")).first()
    assert x == pytest.approx(y)


def test_kernels_sum_to_one_at_places(spark):
    row = spark.range(1).select(*[kernels.KERNELS[k](F.lit(0.0), 4).alias(k) for k in ("linear", "sinc", "lanczos")]).first()
    assert list(row) == [1.0, 1.0, 1.0]


def test_quadrature_weights(spark):
    for points in (quadrature.spiral_sphere(spark, 100), quadrature.icosphere_points(spark, 1), quadrature.asymmetric_points(quadrature.spiral_sphere(spark, 100), "c3")):
        assert points.agg(F.sum("weight")).first()[0] == pytest.approx(4 * math.pi)
    assert len(quadrature.icosphere(2)) == 162
    grid_ = quadrature.shift_grid(spark, *quadrature.shift_nodes("hermite", 5, 2.0, 6.0), 6.0)
    assert grid_.agg(F.sum("weight")).first()[0] == pytest.approx(1)
    assert quadrature.asymmetric_points(quadrature.spiral_sphere(spark, 50), "c1").count() == 50


def test_symmetry_groups():
    assert len(quadrature.symmetry_rotations("d3")) == 6
    assert len(quadrature.symmetry_rotations("")) == 1
    with pytest.raises(ValueError):
        quadrature.parse_symmetry("x3")


def test_log_sum_exp_is_shift_invariant(spark):
    df = spark.createDataFrame([(1, -1000.0), (1, -1001.0), (2, float("-inf"))], "k int, v double")
    out = {r["k"]: r["lse"] for r in probability.log_sum_exp(df, "v", ["k"]).collect()}
    assert out[1] == pytest.approx(-1000 + math.log(1 + math.exp(-1)))
    assert out[2] == float("-inf")


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_draws_of_one_large_group(spark, monkeypatch, most):
    """Counts are n times the share within one, their sum is n, weights make the estimate unbiased; a group may span ranges."""
    monkeypatch.setattr(sequence, "WINDOW_ROWS", most)
    rng = np.random.default_rng(0)
    rows = [(1, i, float(p), 500) for i, p in enumerate(rng.random(3000) ** 4)] + [(2, 0, 0.5, 3), (2, 1, 0.5, 3), (2, 2, 0.0, 3), (None, 0, 1.0, 7)]
    df = spark.createDataFrame(rows, "k int, i int, p double, n int").repartition(6)
    total = sum(r[2] for r in rows[:3000])
    for residual in (False, True):
        a, b = (sorted(map(tuple, probability.draw(df, ["k"], "i", "p", "n", 3, residual).select("i", "count", F.round("weight", 9), F.coalesce("k", F.lit(0))).collect())) for _ in range(2))
        assert a == b
        assert [sum(r[1] for r in a if r[3] == k) for k in (0, 1, 2)] == [7, 500, 3]
        for i, count, weight, k in a:
            if k == 1:
                expected = 500 * rows[i][2] / total
                assert abs(count - expected) < 1 + 1e-6 and weight == pytest.approx(count / expected)
                assert not residual or count >= math.floor(expected)
            assert (k, i) != (2, 2)
    drawn = [{r["i"]: r["count"] for r in probability.draw(df.where("k = 1"), ["k"], "i", "p", "n", s).collect()} for s in range(20)]
    assert len({tuple(sorted(x.items())) for x in drawn}) == 20
    heavy = max(range(3000), key=lambda i: rows[i][2])
    assert np.mean([x.get(heavy, 0) for x in drawn]) == pytest.approx(500 * rows[heavy][2] / total, abs=0.5)
    assert probability.draw(df.limit(0), ["k"], "i", "p", "n", 3).count() == 0


def test_recorded_posteriors_are_freed_of_their_weights(spark):
    """Sampled twice as often with half the density is the same distribution."""
    rows = spark.createDataFrame([(1, 0, 0.2, 2.0), (1, 1, 0.1, 1.0), (1, 2, 0.8, 4.0)], "image int, point int, value double, weight double")
    plain = {r["point"]: r["p"] for r in sampler_state.record_update(rows).collect()}
    assert plain == pytest.approx({0: 0.25, 1: 0.25, 2: 0.5})
    logs = {r["point"]: r["p"] for r in sampler_state.record_update(rows.withColumn("value", F.ln("value") - 5000), 2.0, log=True).collect()}
    root = np.sqrt([0.1, 0.1, 0.2])
    assert logs == pytest.approx(dict(enumerate(root / root.sum())))


def test_shell_resolution_ends(spark):
    rows = [("never", 0, 0.9), ("never", 1, 0.8), ("at_once", 0, 0.1), ("cross", 0, 0.9), ("cross", 1, 0.1)]
    out = dict(map(tuple, radial.shell_resolution(spark.createDataFrame(rows, "k string, shell int, fsc double"), "k", 0.5).collect()))
    assert out["never"] == 2.5 and out["at_once"] == float("inf") and out["cross"] == pytest.approx(2.0)


def test_runs_come_back_as_new(spark):
    df = spark.createDataFrame([(0, "a"), (1, "a"), (2, None), (3, None), (4, "a")], "i int, v string")
    assert [r["run_id"] for r in sequence.runs(df, ["i"], ["v"]).orderBy("i").collect()] == [0, 0, 1, 1, 2]


def test_batches_differ_by_one_at_most(spark):
    df = spark.range(103).select(sequence.batch_of(F.col("id"), 103, 10).alias("b"))
    sizes = [r["count"] for r in df.groupBy("b").count().orderBy("b").collect()]
    assert sorted(sizes) == sizes and sum(sizes) == 103 and max(sizes) - min(sizes) == 1
    assert spark.range(3).select(sequence.batch_of(F.col("id"), 3, 10).alias("b")).distinct().count() == 1


@pytest.mark.parametrize("prior", [objectives.gaussian(0.7), objectives.sparsity(2.0), objectives.negative(2, 1.5, 2.0, 10), objectives.exponential_gaussian(0.6, 0.25, 0.1, 0.3)])
def test_gradients_match_differences(spark, prior):
    h = 1e-5
    v = F.col("v")
    df = spark.createDataFrame([(x,) for x in (-0.4, -0.1, 0.2, 0.9)], "v double")
    for r in df.select(prior.gradient(v).alias("g"), ((prior.loss(v + h) - prior.loss(v - h)) / (2 * h)).alias("d")).collect():
        assert r["g"] == pytest.approx(r["d"], abs=1e-5)


def test_centre_gradient(spark):
    rows = [(0, x, y, z, 1.0 + 0.1 * x + 0.2 * y * z) for x in (0, 1) for y in (0, 1) for z in (0, 1)]
    cols = "id int, x int, y int, z int, v double"
    g = {(r["x"], r["y"], r["z"]): r["g"] for r in objectives.centre_gradient(spark.createDataFrame(rows, cols), 2.0).collect()}
    h = 1e-5

    def loss(sign):
        moved = [(i, x, y, z, v + sign * h * ((x, y, z) == (1, 0, 1))) for i, x, y, z, v in rows]
        return objectives.centre_penalty(spark.createDataFrame(moved, cols), 2.0).first()["loss"]

    assert g[1, 0, 1] == pytest.approx((loss(1) - loss(-1)) / (2 * h), abs=1e-6)


def test_likelihood_gradient(spark):
    rng = np.random.default_rng(1)
    d = rng.normal(size=4) + 1j * rng.normal(size=4)
    p = rng.normal(size=(2, 1, 1, 4)) + 1j * rng.normal(size=(2, 1, 1, 4))
    images = spark.createDataFrame([(0, d.real.tolist(), d.imag.tolist())], "id int, re array<double>, im array<double>")

    def run(q):
        return likelihood.marginal_arrow(images, "id", q, np.log(np.full((2, 1, 1), 0.5)), 1.3).first()

    base, h = run(p), 1e-6
    up, down = p.copy(), p.copy()
    up[1, 0, 0, 2] += h
    down[1, 0, 0, 2] -= h
    assert base["grad_re"][6] == pytest.approx((run(up)["nll"] - run(down)["nll"]) / (2 * h), abs=1e-4)


def test_optimiser_finds_the_minimum():
    a, b = np.diag([1.0, 4.0]), np.array([1.0, -2.0])
    f = lambda x, batch: (float(0.5 * x @ a @ x - b @ x), a @ x - b)
    none = lambda x: (0.0, np.zeros_like(x))
    for algorithm in (optimizer.AverageGradient(), optimizer.MomentumGradient(0.05)):
        x, stats = optimizer.minimise(f, none, np.zeros(2), 1, 200, algorithm)
        assert np.allclose(x, [1, -0.5], atol=1e-2) and stats[-1]["epoch"] == 199


def test_running_sum_batch_is_stateful():
    s = optimizer.RunningSum(0.5)
    s.set(1, np.array([2.0]))
    s.set(2, np.array([4.0]))
    s.set(1, np.array([6.0]))
    assert s.total_weight() == pytest.approx(1.5) and s.mean()[0] == pytest.approx((6 + 0.5 * 4) / 1.5)


def test_reconstruction_improves(spark):
    volume = synthetic.blob_volume(8, 8, 1.5, 2)
    images = synthetic.project(synthetic.poses(spark, 24, 1, 0.0), volume, 0.05, 1)
    x, stats = reconstruct.reconstruct(images, 8, 0.5, 12, 4, np.zeros((8, 8, 8)), 4, 2)
    assert stats[-1]["loss"] < stats[0]["loss"] and x.shape == (8, 8, 8)


def test_mrc_round_trip_and_pruning(spark, tmp_path):
    data = np.arange(4 * 3 * 3, dtype=np.float32).reshape(4, 3, 3)
    path = str(tmp_path / "a.mrc")
    mrc.write(data, path, 2.8)
    mrc.register(spark)
    df = spark.read.format("mrc").option("imagesPerPartition", "2").load(path)
    got = {r["image_id"]: r["px"] for r in df.collect()}
    assert got[3] == data[3].ravel().tolist() and len(got) == 4
    assert [r["image_id"] for r in df.where("image_id >= 2 and image_id < 3").collect()] == [2]
    assert mrc.read_binary(spark, path).count() == 4
    assert mrc.headers(spark, path).first()["mode"] == 2
    assert mrc.parse_header(mrc.encode(data, 2.8))["pixel_size"] == pytest.approx(2.8)


def test_text_tables(spark, tmp_path):
    (tmp_path / "a.txt").write_text("2, 100, 1, 15000, 14000, 45, 0\n1, 100, 1, 15000, 14000, 30, 0\n2, 100, 1, 15000, 14000, 45, 0\n")
    rows = text_tables.ctf_ids(text_tables.read_parameters(spark, str(tmp_path / "a.txt")))
    assert [r["ctf_id"] for r in rows.orderBy("image_id").collect()] == [0, 0, 1, 2, 2]
    assert text_tables.read_ctf_text(spark, str(tmp_path / "a.txt"), 3).count() == 3
    (tmp_path / "b.txt").write_text("head\n  1 15000 14000 90\n")
    assert text_tables.read_parameters(spark, str(tmp_path / "b.txt")).first()["ANGAST"] == pytest.approx(math.pi / 2)
    line = "".join(str(v).rjust(w) for v, w in zip([1, 2.5, 3, 4, 0, 0, 100, 7, 15000.0, 14000.0, 90.0, 0.1], text_tables.PAR_WIDTHS))
    (tmp_path / "c.par").write_text("C comment\n" + line + "\n")
    row = text_tables.read_parameters(spark, str(tmp_path / "c.par")).first()
    assert row["IDX"] == 1 and row["FILM"] == 7 and row["DF2"] == 14000.0
    text_tables.write_defocus_text(text_tables.read_defocus_text(spark, str(tmp_path / "b.txt")), "_line", str(tmp_path / "out"))
    assert text_tables.read_defocus_text(spark, str(tmp_path / "out")).first()["DF1"] == 15000.0


def test_star_round_trip(spark, tmp_path):
    (tmp_path / "a.star").write_text("data_x\n\nloop_\n_a #1\n_b #2\n1 p # c\n2 q\n\ndata_y\n\nloop_\n_b #1\n_a #2\n_c #3\nr 3 4\n\n")
    got = star.read_star(spark, str(tmp_path / "a.star"))
    assert sorted((r["a"], r["b"]) for r in got.collect()) == [(1.0, "p"), (2.0, "q"), (3.0, "r")] and "c" not in got.columns
    star.write_star(got.select("a", "b"), str(tmp_path / "out"), order="a")
    assert star.read_star(spark, str(tmp_path / "out")).count() == 3


def test_grid_and_pack(spark):
    cells = grid.grid(spark, 4, 2).select(F.lit(1).alias("k"), "x", "y", (F.col("x") * 10 + F.col("y")).cast("double").alias("v"))
    packed = grid.pack_array(cells, 4, 2, ["k"])
    back = grid.explode_array(packed, "v", 4, 2, ["k"])
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, cells.collect()))


def test_single_point_spacing(spark):
    assert pairs.nearest_spacing(spark.createDataFrame([(1, 0.0, 0.0)], "id int, p0 double, p1 double"), 2, 0.5).first()["spacing"] == 0.5


def test_quantiles_leave_out_what_is_not_finite(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (float("inf"),), (float("nan"),), (None,)], "v double")
    q = {r["percent"]: r["quantile"] for r in robust.quantiles(df, "v").collect()}
    assert q[0] == 1.0 and q[50] == 2.0 and q[100] == 3.0


def test_monitor(spark, tmp_path):
    path = str(tmp_path / "stat")
    monitor.append(spark, path, [{"iteration": 1, "loss": 2.0, "time_a": 1.0}, {"iteration": 2, "loss": 4.0, "time_a": 2.0}])
    stat = monitor.load(spark, path)
    assert [r["loss"] for r in monitor.series(stat, "iteration", "loss", 2).orderBy("iteration").collect()] == [2.0, 3.0]
    assert monitor.by_prefix(stat, "time_", ["iteration"]).count() == 2
    assert monitor.schedule(spark, {"rate": "CASE WHEN epoch < 2 THEN 0.5 ELSE 0.1 END"}, {"epoch": 3})["rate"] is not None
    assert monitor.key_values(["a=1", "b=x=y"]) == {"a": 1, "b": "x=y"}


def test_stream_decays_as_the_batch_does(spark, tmp_path):
    from stackwright.streaming.running_sum import decayed_per_key

    rows = spark.createDataFrame([(1, i, float(i)) for i in range(5)] + [(2, 0, 3.0)], "k int, t int, v double")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = decayed_per_key(stream, "k", "v", "t", 0.5).writeStream.outputMode("update").format("memory").queryName("decayed").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["k"]: r["total"] for r in spark.table("decayed").collect()}
    batch = {r["k"]: r["total"] for r in pairs.decayed_sum(rows, "k", "v", ["t"], 0.5).collect()}
    assert got == pytest.approx(batch)


def test_quantiles_of_groups_match_numpy(spark):
    rng = np.random.default_rng(3)
    rows = [(int(k), float(v)) for k, v in zip(rng.integers(0, 3, 5000), rng.normal(size=5000).round(2))] + [(9, 1.0)]
    got = {(r["k"], r["level"]): r["quantile"] for r in sequence.order_statistics(spark.createDataFrame(rows, "k int, v double").repartition(5), "v", ["k"], [0.0, 0.25, 0.5, 1.0]).collect()}
    for k in (0, 1, 2, 9):
        for q in (0.0, 0.25, 0.5, 1.0):
            assert got[k, q] == pytest.approx(np.quantile([v for i, v in rows if i == k], q))


def test_row_numbers_of_a_wide_table(spark):
    df = spark.range(30_000).select(F.pmod(F.xxhash64("id"), F.lit(1000)).alias("a"), "id", F.lit("x" * 50).alias("wide")).repartition(6)
    rows = sequence.numbered(df, ["a", "id"], "at", buckets=7).select("at", "a", "id").orderBy("at").collect()
    assert [r["at"] for r in rows] == list(range(30_000)) and [(r["a"], r["id"]) for r in rows] == sorted((r["a"], r["id"]) for r in rows)


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_order_statistics_of_hot_values(spark, monkeypatch, most):
    """One value in nearly all rows, groups without key, nulls: through one window and through ranges of values."""
    monkeypatch.setattr(sequence, "WINDOW_ROWS", most)
    rng = np.random.default_rng(5)
    rows = [(1, 7.0)] * 3000 + [(k, float(v)) for k in (1, 2, None) for v in rng.normal(size=301).round(1)] + [(3, None), (4, 1.0), (4, None)]
    df = spark.createDataFrame(rows, "k int, v double").repartition(5)
    groups = {k: np.array([v for i, v in rows if i == k and v is not None]) for k in (1, 2, None, 4)}
    got = {r["k"]: (r["mean"], r["std"], r["n"]) for r in robust.mean_std(df, "v", ["k"]).collect()}
    assert set(got) == set(groups)
    for k, v in groups.items():
        middle = np.median(v)
        assert got[k] == pytest.approx((middle, 1.4826 * np.median(np.abs(v - middle)), len(v)))
    found = {(r["k"], r["level"]): r["quantile"] for r in sequence.order_statistics(df, "v", ["k"], [0.0, 0.1, 0.999, 1.0]).collect()}
    assert found == pytest.approx({(k, q): np.quantile(v, q) for k, v in groups.items() for q in (0.0, 0.1, 0.999, 1.0)})
    many = [i / 40 for i in range(41)]
    found = {(r["k"], r["level"]): r["quantile"] for r in sequence.order_statistics(df, "v", ["k"], many).collect()}
    assert found == pytest.approx({(k, q): np.quantile(v, q) for k, v in groups.items() for q in many})
    alone = robust.mean_std(df.select("v"), "v", []).first()
    every = np.array([v for _, v in rows if v is not None])
    assert (alone["mean"], alone["n"]) == pytest.approx((np.median(every), len(every)))
    counted = df.groupBy("k", "v").count()
    assert sorted(map(str, sequence.order_statistics(counted, "v", ["k"], [0.3], "count").collect())) == sorted(map(str, sequence.order_statistics(df, "v", ["k"], [0.3]).collect()))
    assert sequence.order_statistics(df.limit(0), "v", ["k"], [0.5]).count() == 0


def test_robust_statistics_read_their_rows_once(spark, tmp_path):
    """One job reads the rows; all that follows works on counts."""
    from stackwright.staging import clear

    path = str(tmp_path / "rows")
    spark.range(20_000).select((F.col("id") % 7).alias("k"), (F.col("id") % 101).cast("double").alias("v")).write.parquet(path)
    out = robust.mean_std(spark.read.parquet(path), "v", ["k"])
    assert path not in out._jdf.queryExecution().toString()
    assert out.count() == 7
    clear(spark)


def test_runs_over_many_parts(spark):
    values = [v for k in range(400) for v in [k % 3 if k % 7 else None] * (1 + k % 5)]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v int").repartition(5)
    expected, run = [], -1
    for i, v in enumerate(values):
        run += i == 0 or v != values[i - 1]
        expected.append(run)
    assert [r["run_id"] for r in sequence.runs(df, ["i"], ["v"]).orderBy("i").collect()] == expected


@pytest.mark.parametrize("kind,edge,size", [("hanning", "reflect", 7), ("flat", "zeros", 4), ("blackman", "extend", 5), ("flat", "reflect", 2)])
def test_smoothing_is_a_convolution(spark, kind, edge, size):
    x = np.random.default_rng(1).normal(size=20)
    got = [r["smooth"] for r in sequence.smooth(spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(x)], "k int, i int, v double"), "v", size, ["k"], ["i"], kind, edge).orderBy("i").collect()]
    if size < 3:
        assert np.allclose(got, x)
        return
    m = size - 1
    left = {"reflect": [2 * x[0] - x[k + 1] for k in range(m, 0, -1)], "zeros": [0.0] * m, "extend": [x[0]] * m}[edge]
    right = {"reflect": [2 * x[-1] - x[len(x) - k] for k in range(1, m + 1)], "zeros": [1.0] * m, "extend": [x[-1]] * m}[edge]
    w = np.ones(size) if kind == "flat" else getattr(np, kind)(size)
    assert np.allclose(got, np.convolve(w / w.sum(), np.r_[left, x, right], mode="same")[m:-m])


def test_resize_blurs_with_zeros_outside(spark):
    a = np.random.default_rng(2).normal(size=(6, 6))
    got = np.array(fourier.resize(spark.createDataFrame([(0, a.ravel().tolist())], "id int, px array<double>"), "id", "px", 6, 3, 2).first()["v"]).reshape(3, 3)
    sigma = 0.66 * 2
    r = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    w /= w.sum()
    blur = np.apply_along_axis(lambda v: np.convolve(v, w)[r : r + 6], 0, np.apply_along_axis(lambda v: np.convolve(v, w)[r : r + 6], 1, a))
    assert np.allclose(got, blur[np.ix_([0, 3, 5], [0, 3, 5])])


def test_neighbour_gradient_is_the_loss_derivative(spark):
    rng = np.random.default_rng(0)
    rows = [(0, x, y, z, float(rng.normal())) for x in range(-1, 2) for y in range(-1, 2) for z in range(-1, 2)]
    cols = "id int, x int, y int, z int, v double"
    g = {(r["x"], r["y"], r["z"]): r["g"] for r in objectives.neighbour_gradient(spark.createDataFrame(rows, cols), 3, 0.7, 0.5).collect()}

    def loss(h):
        return objectives.neighbour_prior(spark.createDataFrame([(i, x, y, z, v + h * ((x, y, z) == (0, 1, -1))) for i, x, y, z, v in rows], cols), 3, 0.7, 0.5).first()["loss"]

    assert g[0, 1, -1] == pytest.approx((loss(1e-4) - loss(-1e-4)) / 2e-4, abs=1e-6)


def test_principal_axes():
    v = robust.principal_axes([[2.0, 0.3, 0.1], [0.3, 1.0, 0.2], [0.1, 0.2, 3.0]])
    d = v.T @ np.array([[2.0, 0.3, 0.1], [0.3, 1.0, 0.2], [0.1, 0.2, 3.0]]) @ v
    assert np.allclose(d, np.diag(np.diag(d))) and (np.diff(np.diag(d)) > 0).all() and np.linalg.det(v) == pytest.approx(1)


def test_nearest_in_clusters(spark):
    rng = np.random.default_rng(6)
    p = np.vstack([rng.normal(size=(60, 2)) * 1e-3, rng.normal(size=(40, 2)) * 50, [[1e4, 1e4]], [[0.5, 0.5]] * 2])
    got = dict(map(tuple, pairs.nearest_spacing(spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "id int, p0 double, p1 double"), 2, 1.0).collect()))
    d = np.linalg.norm(p[:, None] - p[None], axis=2) + np.diag([np.inf] * len(p))
    assert np.allclose([got[i] for i in range(len(p))], d.min(axis=1))


def test_poses_do_not_depend_on_the_layout(spark):
    a, b = (sorted(map(tuple, synthetic.poses(spark, 50, 3, 2.0).repartition(k).collect())) for k in (1, 7))
    assert a == b and np.std([r[4] for r in a]) > 0.5


def test_optics_of_synthetic_images(spark):
    ctf = {"akv": 200.0, "cs": 2.0, "wgh": 0.07, "dscale": 1.0, "bfactor": 50.0, "df1": 15000.0, "df2": 12000.0, "angast": 0.4}
    axis = np.arange(8) - 4
    gx, gy = np.meshgrid(axis, axis, indexing="ij")
    cells = grid.grid(spark, 8, 2)
    f, a = F.sqrt(grid.radius2(2).cast("double")) / (8 * 2.8), F.atan2(F.col("y").cast("double"), F.col("x").cast("double"))
    own = optics.contrast_transfer(f, a, *[F.lit(ctf[k]) for k in ("akv", "cs", "wgh", "df1", "df2", "angast", "dscale", "bfactor")])
    got = {(r["x"], r["y"]): r["c"] for r in cells.select("x", "y", own.alias("c")).collect()}
    assert np.allclose(synthetic.transfer(gx, gy, 2.8, ctf), [[got[x, y] for y in axis] for x in axis])
    volume = synthetic.blob_volume(8, 6, 1.0, 3)
    posed = synthetic.poses(spark, 2, 1, 0.0).withColumn("df1", F.lit(15000.0))
    with_ctf, without = (np.array(synthetic.project(posed, volume, 0.0, 1, o, 2.8).orderBy("image_id").first()["px"]) for o in (ctf, None))
    expected = fourier.centred_ifft(fourier.centred_fft(without.reshape(8, 8), 2) * synthetic.transfer(gx, gy, 2.8, ctf), 2).real
    assert np.allclose(fourier.centred_ifft(fourier.centred_fft(with_ctf.reshape(8, 8), 2), 2).real, expected, atol=0.2)


def test_stacks_and_generated_tables(spark, tmp_path):
    data = np.random.default_rng(0).normal(size=(5, 6, 6)).astype(np.float32)
    path = str(tmp_path / "s.mrc")
    mrc.write(data, path, 2.0)
    stack, info = mrc.read_stack(spark, path)
    assert info == {"images": 5, "pixels": 6, "pixel_size": 2.0} and np.allclose(mrc.image(stack, 3).first()["px"], data[3].ravel())
    small, info = mrc.read_stack(spark, path, scale=0.5)
    assert info == {"images": 5, "pixels": 3, "pixel_size": 4.0} and len(small.first()["px"]) == 9
    ctfs = spark.createDataFrame([(0, 15000.0, 14000.0, 0.5), (1, 16000.0, 14000.0, 0.5)], "ctf_id int, DF1 double, DF2 double, ANGAST double")
    posed = spark.createDataFrame([(i, i % 2, 0.1, 0.2, 0.3, 1.0, 2.0, 7) for i in range(4)], "image_id int, ctf_id int, PHI double, THETA double, PSI double, SHX double, SHY double, FILM int")
    rows = text_tables.generated(ctfs, posed, ["PHI", "THETA", "PSI", "SHX", "SHY", "FILM"])
    assert tuple(text_tables.counts(rows).first()) == (2, 4)
    text_tables.write_poses(rows, "image_id", str(tmp_path / "poses"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "poses")).collect()]
    assert len(lines) == 5 and lines[0].startswith("C") and lines[2].split()[:2] == ["1", "0.100"]


def test_state_and_background(spark, tmp_path):
    import datetime

    for v in (1, 2):
        monitor.save_latest(spark, str(tmp_path / "diag"), [{"a": v}])
    assert [r["a"] for r in monitor.load_latest(spark, str(tmp_path / "diag")).collect()] == [2]
    assert monitor.newer_files(spark, str(tmp_path / "diag/versions"), datetime.datetime(2000, 1, 1)).count() >= 2
    assert monitor.newer_files(spark, str(tmp_path / "diag/versions"), datetime.datetime(2100, 1, 1)).count() == 0
    kept, turns = [], iter([1, 2, 3])
    run = monitor.Background(lambda: next(turns, False), kept.append)
    run.begin()
    run.pause()
    run.resume()
    run.end()
    assert kept == [1, 2, 3]
    broken = monitor.Background(lambda: 1 / 0)
    broken.begin()
    with pytest.raises(ZeroDivisionError):
        broken.end()
    assert monitor.typed({"rate": 0.5, "name": "x"}, {"rate": 1}) == {"rate": 1, "name": "x"}
    with pytest.raises(TypeError):
        monitor.typed({"rate": 0.5}, {"rate": "fast"})
    with pytest.raises(KeyError):
        monitor.typed({"rate": 0.5}, {"rat": 1})


def test_schedules_are_evaluated(spark):
    terms = {"rate": "CASE WHEN epoch < 2 THEN 0.5 ELSE 0.1 END", "size": "least(iteration * 2, 10)"}
    assert [float(v) for v in monitor.schedule(spark, terms, {"epoch": 3, "iteration": 4}).values()] == [0.1, 8.0]
    assert [float(v) for v in monitor.schedule(spark, terms, {"epoch": 1, "iteration": 9}).values()] == [0.5, 10.0]


def test_frequency_marching_and_held_out_images(spark):
    volume = synthetic.blob_volume(8, 8, 1.2, 2)
    images = synthetic.project(synthetic.poses(spark, 60, 1, 0.0), volume, 0.05, 1)
    kept = []
    x, stats = reconstruct.reconstruct(images.where("image_id < 48"), 8, 0.5, 12, 4, np.zeros((8, 8, 8)), 10, 2, radius=lambda i: 0.5 if i < 4 else 2.0, each=lambda row, v: kept.append(v))
    assert len(kept) == 10 and np.abs(x).max() > 0
    from test_reconstruct import held_out_loss

    loss = lambda v: held_out_loss(images.where("image_id >= 48"), 8, 0.5, v, 12, 4)
    assert loss(x) < loss(np.zeros((8, 8, 8)))
