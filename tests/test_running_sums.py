"""Running sums with phases: table, stream, restart and the driver's class against a plain loop; averaged-gradient descent."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stackwright.plans import optimizer
from stackwright.streaming import keyed_sum


def plain(rows, decay, start=None):
    """(updates, weight, mean, mean square) of one group, row by row as the text of keyed_sum says."""
    n, history, seen, updates = 0, None, {}, 0

    def now():
        left = max(n - len(seen), 0) / n if n else 0.0
        old = history[0] * left if history else 0.0
        w = old + sum(x[1] for x in seen.values())
        first, second = (history[1], history[2]) if history else (0.0, 0.0)
        return w, (old * first + sum(x[0] * x[1] for x in seen.values())) / w, (old * second + sum(x[0] ** 2 * x[1] for x in seen.values())) / w

    if start:
        n, history = start[3], start[:3]
    for key, value, wanted in rows:
        if n and wanted != n:
            history, seen = now(), {}
        n = wanted
        seen = {k: (v, w * decay) for k, (v, w) in seen.items() if k != key} | {key: (value, 1.0)}
        history = history and (history[0] * decay, *history[1:])
        updates += 1
    return updates, *now()


def made(seed=0):
    rng = np.random.default_rng(seed)
    rows, at = [], 0
    for group, phases in (("a", [(6, 40), (9, 5), (6, 3), (4, 30)]), ("b", [(3, 50)]), ("c", [(5, 1)])):
        for n, count in phases:
            for _ in range(count):
                rows.append((group, at, int(rng.integers(0, n)), float(rng.normal()), n))
                at += 1
    return rows


SCHEMA = "g string, o long, k long, v double, n long"


def groups(rows, decay, start=None):
    return {g: plain([(r[2], r[3], r[4]) for r in rows if r[0] == g], decay, (start or {}).get(g)) for g in {r[0] for r in rows}}


@pytest.mark.parametrize("decay", [1.0, 0.9])
def test_sums_over_a_table(spark, decay):
    rows = made()
    df = spark.createDataFrame(rows, SCHEMA).withColumns({x: F.lit(1) for x in ("_at", "_g", "_phase")}).repartition(5)
    got = {r["g"]: tuple(r)[1:] for r in keyed_sum.running_sums(df, "g", "k", "v", "o", "n", decay).collect()}
    assert got == {g: pytest.approx(x) for g, x in groups(rows, decay).items()}
    assert keyed_sum.running_sums(df.limit(0), "g", "k", "v", "o", "n", decay).count() == 0


def test_sums_over_a_stream_that_is_stopped_and_goes_on(spark, tmp_path):
    """Two runs on one checkpoint, with new files between: state comes back from the store."""
    rows, name = made(1), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, keyed_sum.PROVIDER)
    start = {"a": (7.5, 0.25, 2.0, 6)}
    try:
        for turn, part in enumerate((rows[:43], rows[43:])):
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
            first = spark.createDataFrame([("a", 7.5, 0.25, 2.0, 6)], "g string, weight double, mean double, mean_square double, n long")
            sums = keyed_sum.keep_running_sums(stream, "g", "k", "v", "o", "n", 0.9, first)
            q = sums.writeStream.outputMode("update").foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={i}")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
            q.awaitTermination()
            got = {r["g"]: tuple(r)[1:] for r in keyed_sum.latest_rows(spark.read.parquet(str(tmp_path / "out")), "g").collect()}
            seen = rows[:43] if turn == 0 else rows
            assert got == {g: pytest.approx(x) for g, x in groups(seen, 0.9, start).items()}
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def test_idle_groups_end(spark, tmp_path):
    """A group without rows for an hour of event time loses its state; when it comes again it begins anew, others go on."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, keyed_sum.PROVIDER)
    hours = lambda h: f"2024-01-01 {h:02d}:00:00"
    turns = [[("a", 0, 1, 1.0, hours(0)), ("b", 1, 1, 5.0, hours(0))], [("b", 2, 2, 7.0, hours(1))], [("b", 3, 3, 9.0, hours(6))], [("b", 4, 1, 3.0, hours(6))], [("a", 5, 1, 2.0, hours(7)), ("b", 6, 2, 1.0, hours(7))]]
    try:
        for rows in turns:
            spark.createDataFrame(rows, "g string, o long, k long, v double, ts string").selectExpr("g", "o", "k", "v", "4L as n", "cast(ts as timestamp) as ts").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema("g string, o long, k long, v double, n long, ts timestamp").parquet(str(tmp_path / "in")).withWatermark("ts", "1 minute")
            sums = keyed_sum.keep_running_sums(stream, "g", "k", "v", "o", "n", 1.0, time="ts", idle=3_600_000)
            q = sums.writeStream.outputMode("update").foreachBatch(lambda b, i: b.write.mode("append").parquet(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
            q.awaitTermination()
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)
    rows = sorted((r["g"], r["updates"], r["mean"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    # a ends with its last row given once more, and begins anew; b's next row comes before the watermark passes its hour
    assert [r for r in rows if r[0] == "a"] == [("a", 1, 1.0), ("a", 1, 1.0), ("a", 1, 2.0)]
    assert max(r[1] for r in rows if r[0] == "b") == 5


@pytest.mark.parametrize("decay", [1.0, 0.8])
def test_sums_on_the_driver(decay):
    rows = [r for r in made(2) if r[0] == "a"]
    total = optimizer.RunningSum(decay)
    for i, (_, _, k, v, n) in enumerate(rows):
        total.expect(n)
        total.set(k, np.array([v]))
        expected = plain([(r[2], r[3], r[4]) for r in rows[: i + 1]], decay)
        assert (total.total_weight(), total.mean()[0], total.mean_square()[0]) == pytest.approx(expected[1:])


def quadratic(n_batches=8, size=30, seed=0):
    """Minibatches of a quadratic whose coordinates are curved by 1 to 1000, with noise between minibatches in proportion."""
    rng = np.random.default_rng(seed)
    curve = np.logspace(0, 3, size)
    centres = rng.normal(size=size) + 0.1 * rng.normal(size=(n_batches, size))
    f = lambda x, b: (float((curve * (x - centres[b]) ** 2).sum() / 2), curve * (x - centres[b]))
    best = centres.mean(axis=0)
    return f, lambda x: float((curve * (x - best) ** 2).sum() / 2), np.zeros(size)


def test_scaled_steps_descend_faster():
    f, excess, x = quadratic()
    none = lambda y: (0.0, np.zeros_like(y))
    left = {}
    for name, options in {"plain": {}, "scaled": {"precondition": True}, "both": {"precondition": True, "saga": True}}.items():
        out, stats = optimizer.minimise(f, none, x, 8, 120, optimizer.AverageGradient(learn_rate=0.5, search_every=10, n_batches=8, **options), 1)
        left[name] = excess(out)
    assert left["scaled"] < left["plain"] / 2 and left["both"] < left["plain"] / 2


def test_saga_has_no_bias():
    """Averaged over the minibatch that is drawn, the step is along the whole gradient."""
    f, _, x = quadratic()
    none = lambda y: (0.0, np.zeros_like(y))
    y, moves = x + 0.3, []
    for b in range(8):
        algorithm = optimizer.AverageGradient(lipschitz=1.0, search_every=1000, saga=True)
        for k in range(8):
            algorithm.history.set(k, f(x, k)[1])
        moves.append(algorithm.step(f, none, y, b, 1)[0] - y)
    assert np.mean(moves, axis=0) == pytest.approx(-np.mean([f(y, b)[1] for b in range(8)], axis=0))


def test_preconditioner_edges():
    assert optimizer.preconditioner(np.zeros(3), 5.0).tolist() == [1, 1, 1]
    assert optimizer.preconditioner(np.array([1.0, 4.0]), 1.0).tolist() == [1, 1]
    far = optimizer.preconditioner(np.array([0.0, 1e9]), 1e12)
    assert far[0] == 1 and far[1] == pytest.approx(1000**-0.5)


def test_table_steps_are_the_drivers(spark):
    """The same step by tables of gradients and by arrays on the driver."""
    from stackwright.operators import descent

    rng = np.random.default_rng(4)
    grads, weights, x, fresh, prior = rng.normal(size=(5, 12)), rng.random(5), *rng.normal(size=(3, 12))
    part = lambda v, p: v[p * 4 : p * 4 + 4].tolist()
    latest = spark.createDataFrame([(b, p, part(grads[b], p), float(weights[b])) for b in range(5) for p in range(3)], "batch int, part int, g array<double>, weight double").repartition(4)
    tables = [spark.createDataFrame([(p, part(v, p)) for p in range(3)], f"part int, {n} array<double>") for n, v in (("x", x), ("g", fresh), ("p", prior))]
    for batch in (2, 9):  # one that was seen, and a new one
        history = optimizer.RunningSum(0.9, dict(enumerate(grads)), dict(enumerate(weights.tolist())))
        before = history.mean()
        history.set(batch, fresh)
        scale = optimizer.preconditioner(history.mean_square(), history.total_weight())
        like = before + fresh - grads[batch] if batch < 5 else history.mean()
        expected = x - 0.3 * scale**2 * (like + prior)
        out = descent.descend(tables[0], latest, tables[1], batch, tables[2], 0.3, 0.9)
        got = {r["part"]: r["x"] for r in out.collect()}
        assert np.concatenate([got[p] for p in range(3)]) == pytest.approx(expected)


def test_momentum_with_a_searched_rate():
    """A rate that would diverge is brought down; averaged gradients descend too."""
    f, excess, x = quadratic()
    none = lambda y: (0.0, np.zeros_like(y))
    start = excess(x)
    fixed, _ = optimizer.minimise(f, none, x, 8, 20, optimizer.MomentumGradient(learn_rate=1.0, momentum=0.5), 1)
    assert excess(fixed) > start
    for options in ({}, {"average": 0.5}, {"increase": 0.9, "search_every": 4}):
        out, stats = optimizer.minimise(f, none, x, 8, 200, optimizer.MomentumGradient(learn_rate=0.5, momentum=0.5, adapt=True, **options), 1)
        assert excess(out) < start / 4 and stats[-1]["lipschitz"] > 100


def test_a_slow_sink_holds_the_turns_back():
    import time

    from stackwright.plans import monitor

    made, saved, waiting = [], [], []

    def turn():
        made.append(len(made))
        waiting.append(len(made) - len(saved))
        return len(made) if len(made) <= 12 else False

    def sink(found):
        time.sleep(0.02)
        saved.append(found)

    b = monitor.Background(turn, sink, most=2)
    b.begin()
    b.end()
    assert saved == list(range(1, 13)) and max(waiting) <= 5

    def broken(found):
        raise OSError("disk full")

    turns = []
    b = monitor.Background(lambda: turns.append(1) or len(turns), broken, most=2)  # would never end by itself
    b.begin()
    with pytest.raises(OSError, match="disk full"):
        b.end()
    assert len(turns) < 100
