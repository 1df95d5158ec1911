"""Sums of arrays against NumPy; the expectation step against all candidates, finite differences and repeated draws."""

import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from stackwright.operators import blocks, estep, likelihood
from stackwright.plans import queries_estep

R, I, S, C = 3, 4, 2, 10


@pytest.mark.parametrize("held", [1 << 25, 0])
def test_sums_of_arrays(spark, monkeypatch, held):
    """Blocks, groups, short and null arrays; partial sums that leave early count too."""
    monkeypatch.setattr(blocks, "HELD", held)
    rng = np.random.default_rng(0)
    rows = [(int(k) if k < 3 else None, rng.normal(size=n).tolist(), rng.normal(size=n).tolist()) for k, n in zip(rng.integers(0, 4, 200), rng.choice([0, 5, 23], 200))]
    df = spark.createDataFrame([*rows, (1, None, [1.0]), (1, [1.0], None)], "k int, a array<double>, b array<double>").repartition(7)
    got = blocks.elements(blocks.sum_arrays(df, ["k"], ["a", "b"], 8), ["k"], ["a", "b"], 8).collect()
    expected = {}
    for k, a, b in rows:
        for i, (x, y) in enumerate(zip(a, b)):
            s = expected.setdefault((k, i), [0.0, 0.0])
            s[0], s[1] = s[0] + x, s[1] + y
    assert {(r["k"], r["at"]): [r["a"], r["b"]] for r in got} == {k: pytest.approx(v) for k, v in expected.items()}
    assert blocks.sum_arrays(df.limit(0), ["k"], ["a"]).count() == 0
    alone = blocks.elements(blocks.sum_arrays(df.where("b is not null"), [], ["a"], 8), [], ["a"], 8).collect()
    assert {r["at"]: r["a"] for r in alone}[22] == pytest.approx(sum(r[1][22] for r in rows if len(r[1]) > 22))


def test_one_row_of_each_task_and_block_is_shuffled(spark):
    df = spark.range(0, 4000, 1, 5).select((F.col("id") % 3).alias("k"), F.transform(F.sequence(F.lit(1), F.lit(100)), lambda i: i * 1.0).alias("v"))
    out = blocks.sum_arrays(df, ["k"], ["v"], 25)
    assert out.count() == 3 * 4
    written = [m for m in str(out._jdf.queryExecution().executedPlan()).splitlines() if "Exchange" in m]
    assert written
    parts = blocks.merge_blocks
    try:
        blocks.merge_blocks = lambda df, keys, values, fan=0: df
        assert blocks.sum_arrays(df, ["k"], ["v"], 25).count() == 5 * 3 * 4  # tasks x groups x blocks
    finally:
        blocks.merge_blocks = parts
    many = spark.range(1000).select(F.lit(0).cast("int").alias("block"), F.col("id").cast("int").alias("_task"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("v"))
    assert blocks.merge_blocks(many, [], ["v"], 7).first()["v"] == [1000.0, 999 * 500.0]


def small_domain(seed=0):
    rng = np.random.default_rng(seed)
    cplx = lambda *shape: rng.normal(size=shape) + 1j * rng.normal(size=shape)
    at = rng.integers(0, C, (I, C, 2))
    logw = tuple(np.log(rng.dirichlet(np.ones(n))) for n in (R, I, S))
    return estep.Domain(cplx(R, C), np.exp(1j * rng.normal(size=(S, C))), at, rng.random((I, C, 2)), logw, rng.random(C) + 1.5)


def small_images(spark, n=7, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(k, *(rng.normal(size=C).tolist() for _ in range(2)), (rng.random(C) + 0.5).tolist()) for k in range(n)]
    return rows, spark.createDataFrame(rows, "k long, re array<double>, im array<double>, optics array<double>").repartition(3)


def brute(rows, d, drawn=None):
    """(nll, gradient by the slices, error, corr, power) with every candidate written out."""
    out = []
    for k, re, im, optics in rows:
        image, optics, es = np.array(re) + 1j * np.array(im), np.array(optics), []
        points = {a: (drawn or {}).get((k, a)) or {p: 1.0 for p in range(n)} for a, n in zip("ris", (R, I, S))}
        for r, wr in points["r"].items():
            for i, wi in points["i"].items():
                turned, filtered = (image[d.turn_at[i]] * d.turn_weight[i]).sum(1), (optics[d.turn_at[i]] * d.turn_weight[i]).sum(1)
                for s, ws in points["s"].items():
                    off = filtered * d.phases[s] * d.slices[r] - turned
                    es.append((d.logw[0][r] + d.logw[1][i] + d.logw[2][s] + math.log(wr * wi * ws) - (np.abs(off) ** 2 / d.sigma2).sum() / 2, r, filtered, d.phases[s], turned, off))
        e = np.array([x[0] for x in es])
        nll = -np.logaddexp.reduce(e)
        grad, stats = np.zeros((R, C), complex), np.zeros((3, C))
        for q, (_, r, f, p, t, off) in zip(np.exp(e + nll), es):
            grad[r] += q * f * p.conj() * off / d.sigma2
            stats += q * np.array([np.abs(off) ** 2, (f * p * d.slices[r] * t.conj()).real, np.abs(f * d.slices[r]) ** 2])
        out.append((nll, grad, *stats))
    return out


DRAWN = {(0, "r"): {0: 1.5, 2: 0.5}, (0, "s"): {1: 1.0}, (1, "i"): {3: 2.0}, (2, "r"): {1: 1.0}, (2, "i"): {0: 0.2, 1: 0.4, 2: 3.0}, (2, "s"): {0: 1.0, 1: 1.2}}


@pytest.mark.parametrize("drawn", [{}, DRAWN])
def test_step_with_ragged_candidates(spark, drawn):
    """Some images sampled on some axes, others whole: likelihoods, sums and gradients against all candidates written out."""
    d = small_domain()
    rows, images = small_images(spark)
    samples = spark.createDataFrame([(k, a, p, w) for (k, a), x in drawn.items() for p, w in x.items()], "k long, axis string, point int, weight double")
    images = estep.candidates(images, samples, "k")
    expected = brute(rows, d, drawn)
    got = {r["k"]: r for r in estep.e_step(images, "k", d).collect()}
    for (k, *_), (nll, _, *stats) in zip(rows, expected):
        assert (got[k]["nll"], got[k]["error"], got[k]["corr"], got[k]["power"]) == pytest.approx((nll, *(s.sum() for s in stats)))
        assert [got[k][f"n_{a}"] for a in "ris"] == [len(drawn.get((k, a), range(n))) for a, n in zip("ris", (R, I, S))]
        assert all(math.fsum(np.exp(got[k][f"phi_{a}"])) == pytest.approx(1) for a in "ris")
    sums = blocks.elements(estep.e_step_sums(images, "k", d, block=7), ["what"], ["re", "im"], 7).collect()
    held = {(r["what"], r["at"]): complex(r["re"], r["im"]) for r in sums}
    assert held["total", 0] == pytest.approx(complex(sum(x[0] for x in expected), len(rows)))
    assert [held["gradient", j] for j in range(R * C)] == pytest.approx(sum(x[1] for x in expected).ravel().tolist())
    for j, what in enumerate(("error", "corr", "power")):
        assert [held[what, c].real for c in range(C)] == pytest.approx(sum(x[2 + j] for x in expected).tolist())
    weights = {(r["k"], r["axis"], r["point"]): r["weight"] for r in estep.posteriors(estep.e_step(images, "k", d), images, "k").collect()}
    assert len(weights) == sum(len(drawn.get((k, a), range(n))) for k in range(7) for a, n in zip("ris", (R, I, S)))
    assert all(w == drawn.get((k, a), {}).get(p, 1.0) for (k, a, p), w in weights.items())


def test_gradient_by_finite_differences(spark):
    d = small_domain(3)
    _, images = small_images(spark)
    samples = spark.createDataFrame([(k, a, p, w) for (k, a), x in DRAWN.items() for p, w in x.items()], "k long, axis string, point int, weight double")
    images = estep.candidates(images, samples, "k").cache()
    sums = blocks.elements(estep.e_step_sums(images, "k", d).where("what = 'gradient'"), [], ["re", "im"]).collect()
    grad = {r["at"]: complex(r["re"], r["im"]) for r in sums}
    loss = lambda slices: sum(r["nll"] for r in estep.e_step(images, "k", replace(d, slices=slices)).collect())
    for r, c, step in ((0, 2, 1e-5), (1, 7, 1e-5), (2, 9, 1e-5j), (1, 0, 1e-5j)):
        up, down = d.slices.copy(), d.slices.copy()
        up[r, c] += step
        down[r, c] -= step
        slope = (loss(up) - loss(down)) / 2e-5
        assert slope == pytest.approx(grad[r * C + c].imag if isinstance(step, complex) else grad[r * C + c].real, rel=1e-4)


def test_whole_domain_is_the_marginal_likelihood(spark):
    """Without samples the step is the likelihood over all candidates that the older kernel takes as one array."""
    d = replace(small_domain(4), sigma2=1.7, turn_at=np.arange(C)[None, :, None], turn_weight=np.ones((1, C, 1)), logw=(np.full(R, -math.log(R)), np.zeros(1), np.full(S, -math.log(S))))
    _, images = small_images(spark)
    projections = d.slices[:, None, None, :] * d.phases[None, None, :, :]
    expected = {r["k"]: r for r in likelihood.marginal_arrow(images, "k", projections, np.full((R, 1, S), -math.log(R * S)), 1.7).collect()}
    got = {r["k"]: r for r in estep.e_step(images.drop("optics"), "k", d).collect()}
    for k, r in expected.items():
        assert (got[k]["nll"], got[k]["ess_r"], got[k]["ess_s"], got[k]["error"], got[k]["power"]) == pytest.approx((r["nll"], r["ess_r"], r["ess_s"], r["sigma2"], r["power"]))
    assert estep.e_step(images.limit(0), "k", d).count() == 0 and estep.e_step_sums(images.limit(0), "k", d).count() == 0


def test_samples_are_unbiased(spark):
    """The mean likelihood over many draws is that over the whole domain."""
    from stackwright.operators import probability

    d = small_domain(5)
    rows, images = small_images(spark, 1)
    seeds = spark.range(400).withColumnRenamed("id", "seed")
    shares = [("r", p, 0.2 + 0.1 * p, 2) for p in range(R)] + [("i", p, 0.4 - 0.1 * p, 3) for p in range(I)] + [("s", p, 0.5, 1) for p in range(S)]
    draws = seeds.crossJoin(spark.createDataFrame(shares, "axis string, point int, p double, n int"))
    samples = probability.draw(draws, ["seed", "axis"], "point", "p", "n", seed=1).withColumnRenamed("seed", "k")
    many = estep.candidates(seeds.select(F.col("seed").alias("k")).crossJoin(images.drop("k")), samples, "k")
    found = estep.e_step(many, "k", d).agg(F.avg(F.exp(-F.col("nll"))).alias("mean"), F.stddev(F.exp(-F.col("nll"))).alias("std")).first()
    whole = math.exp(-brute(rows, d)[0][0])
    assert found["mean"] == pytest.approx(whole, abs=4 * found["std"] / 20)


def test_query_domain_has_every_kind_of_image(spark, sf):
    images = queries_estep.sampled_images(spark, sf)
    assert images.count() == 500 and images.where("on_i is null or size(on_i) = 0").count() == 100
