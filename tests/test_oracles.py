"""Every registered query of the image and table operators against its SQL, in two layouts of partitions."""

import pytest

import compare
from jobs import queries as job_queries  # noqa: F401
from stackwright.plans import queries_estep, queries_images, queries_more, queries_pipelines, queries_runs, queries_tables, registry  # noqa: F401


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, sf, name):
    assert compare.differences(registry.QUERIES[name](spark, sf), sf, registry.ORACLES[name]) == []


@pytest.mark.parametrize("name", ["radial_average", "logsumexp", "running_sum_decay", "sparse_matvec"])
def test_layout_does_not_matter(spark, sf, name):
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert compare.differences(registry.QUERIES[name](spark, sf), sf, registry.ORACLES[name]) == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_comparison_notices_a_change(spark, sf):
    wrong = registry.QUERIES["logsumexp"](spark, sf).selectExpr("o_orderpriority", "lse + 0.001 as lse")
    assert compare.differences(wrong, sf, registry.ORACLES["logsumexp"])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_queries_without_sql_run(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0
