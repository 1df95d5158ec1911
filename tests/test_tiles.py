"""Tiled matrices against NumPy and the join form; where their data moves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stackwright.operators import linear, tiles


def matrix(spark, n=1500, rows=70, cols=50, seed=0):
    rng = np.random.default_rng(seed)
    cells = [(int(r), int(c), float(v)) for r, c, v in zip(rng.integers(0, rows, n), rng.integers(0, cols, n), rng.normal(size=n))]
    cells += [(3, 4, 1.0)] * 400 + [(5, int(c), 1.0) for c in range(cols)]  # a hot cell and a full row
    whole = np.zeros((rows, cols))
    for r, c, v in cells:
        whole[r, c] += v
    return whole, spark.createDataFrame(cells, "row long, col long, val double").repartition(5)


def dense(blocks, values, size, side):
    out = np.zeros((len(values), size))
    for r in tiles.from_blocks(blocks, values, side).collect():
        if r["at"] < size:
            out[:, r["at"]] = [r[v] for v in values]
    return out


@pytest.mark.parametrize("cells", [10**6, 100])
def test_products_from_both_sides(spark, cells):
    whole, df = matrix(spark)
    laid = tiles.tiled(df, side=16, cells=cells)
    assert laid.p * laid.q == (1 if cells > 2000 else 16)
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(2, 50)), rng.normal(size=(2, 70))
    table = lambda v: spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(v.T)], "at long, re double, im double")
    values = ["re", "im"]
    got = dense(laid.times(tiles.to_blocks(table(x), "at", values, 16), values), values, 70, 16)
    assert got == pytest.approx(x @ whole.T)
    back = dense(laid.transposed_times(tiles.to_blocks(table(y), "at", values, 16), values), values, 50, 16)
    assert back == pytest.approx(y @ whole)
    joined = {r["row"]: (r["re"], r["im"]) for r in linear.matvec(df, table(x).withColumnRenamed("at", "col"), values=("re", "im")).collect()}
    assert all(joined[k] == pytest.approx((got[0, k], got[1, k])) for k in joined)


def test_a_vector_with_holes(spark):
    whole, df = matrix(spark)
    laid = tiles.tiled(df, side=16, cells=300)
    some = spark.createDataFrame([(2, 1.5), (49, -2.0)], "at long, x double")
    x = np.zeros(50)
    x[2], x[49] = 1.5, -2.0
    assert dense(laid.times(tiles.to_blocks(some, "at", ["x"], 16), ["x"]), ["x"], 70, 16)[0] == pytest.approx(whole @ x)
    assert tiles.tiled(df.limit(0), side=16).times(tiles.to_blocks(some, "at", ["x"], 16), ["x"]).count() == 0


def test_tiles_do_not_move(spark):
    """Ten products read the laid-out tiles; only vectors and partial sums are shuffled."""
    _, df = matrix(spark)
    laid = tiles.tiled(df, side=16, cells=100)
    x = tiles.to_blocks(spark.range(50).select(F.col("id").alias("at"), F.lit(1.0).alias("x")), "at", ["x"], 16)
    for product in [laid.times(x, ["x"]), laid.transposed_times(x, ["x"])] * 5:
        plan = product._jdf.queryExecution().executedPlan().toString()
        scans = [line for line in plan.splitlines() if "Bucketed: true" in line]
        assert scans and product.count() >= 0
        before_scan = plan.splitlines()[: plan.splitlines().index(scans[0])]
        nearest = [line for line in reversed(before_scan) if "Exchange" in line or "FlatMapCoGroups" in line][0]
        assert "FlatMapCoGroups" in nearest  # no exchange between the tiles and the product


def test_equal_content_is_laid_out_once(spark):
    """In another order of rows and partitions too; other content is laid out anew."""
    _, df = matrix(spark, seed=5)
    first, again = tiles.tiled(df, side=16), tiles.tiled(df.orderBy(F.rand(3)).repartition(3), side=16)
    other = tiles.tiled(df.withColumn("val", F.col("val") * 2), side=16)
    files = [sorted(t.table.inputFiles()) for t in (first, again, other)]
    assert files[0] == files[1] != files[2]
