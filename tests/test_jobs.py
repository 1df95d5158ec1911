"""Both jobs: against DuckDB, run again, over input that grows, and from the command line."""

import json
import logging
import subprocess
import sys
import time
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from jobs import prepare_stack, queries, screen_texts
from stackwright.operators import packed
from stackwright.plans.registry import ORACLES

REPO = Path(__file__).resolve().parent.parent
STACK, TEXTS = queries.config("prepare_stack"), queries.config("screen_texts")


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_preparing_twice_is_preparing_once(spark, sf, tmp_path, caplog):
    caplog.set_level(logging.INFO, "jobs.prepare_stack")
    out = str(tmp_path / "out")
    before = dict(spark.conf.getAll)
    first = prepare_stack.run(spark, f"{sf}/embeddings.parquet", out, **STACK)
    once = rows_of(prepare_stack.prepared(spark, out))
    assert prepare_stack.run(spark, f"{sf}/embeddings.parquet", out, **STACK) == pytest.approx(first)
    assert rows_of(prepare_stack.prepared(spark, out)) == once and len(once) == 500
    assert first["batches"] == 8 and first["test"] == 100
    assert {p.name for p in (tmp_path / "out/images").glob("split=*")} == {"split=test", "split=train"}
    assert len(list((tmp_path / "out/images/split=train").glob("batch=*"))) == 8
    assert spark.read.json(f"{out}/summary").first()["noise_variance"] == pytest.approx(first["noise_variance"])
    assert "read 500 images" in caplog.text and "wrote 500 images in 8 minibatches" in caplog.text
    assert before == dict(spark.conf.getAll)


def test_prepared_images_have_unit_noise_and_no_offset(spark, sf, tmp_path):
    out = str(tmp_path / "out")
    for kind in ("robust", "mle"):
        prepare_stack.run(spark, f"{sf}/embeddings.parquet", out, **STACK | {"noise": kind})
        cells = prepare_stack.prepared(spark, out).select("vec_id", F.posexplode("image").alias("i", "v"))
        corner = cells.where("(i div 8 - 4) * (i div 8 - 4) + (i % 8 - 4) * (i % 8 - 4) > 6.0516")
        scale = corner.agg((1.4826 * F.percentile(F.abs("v"), F.lit(0.5))) if kind == "robust" else F.sqrt(F.avg(F.col("v") * F.col("v")))).first()[0]
        assert scale == pytest.approx(1)
        assert corner.groupBy("vec_id").agg(F.abs(F.avg("v")).alias("m")).agg(F.max("m")).first()[0] < 1e-9


def test_a_smaller_stack_leaves_no_old_batches(spark, sf, tmp_path):
    """Fewer images, images without pixels, repeated rows: what is written is what the last run found."""
    out, stack = str(tmp_path / "out"), spark.read.parquet(f"{sf}/embeddings.parquet")
    prepare_stack.run(spark, f"{sf}/embeddings.parquet", out, **STACK)
    small = stack.limit(70).unionByName(stack.limit(3)).unionByName(stack.limit(2).withColumn("embedding", F.lit(None).cast("array<float>"))).unionByName(stack.limit(2).withColumn("embedding", F.array().cast("array<float>")))
    small.withColumn("_p", F.lit(1)).withColumn("v", F.lit(2)).write.parquet(str(tmp_path / "small"))
    summary = prepare_stack.run(spark, str(tmp_path / "small"), out, **STACK | {"test_images": 20})
    assert (summary["images"], summary["left_out"], summary["test"], summary["train"]) == (73, 4, 20, 53)
    found = prepare_stack.prepared(spark, out)
    assert found.count() == 73 and {r["place"] for r in found.select("place").collect()} == set(range(73))
    assert set(found.columns) == {*small.columns, "_p", "v", "place", "split", "batch", "image"}


def test_the_corner_mean_is_made_once_an_image(spark):
    """Not once for each pixel: four images of 64 x 64 pixels took over a minute so. No column of the input is dropped."""
    images = np.random.default_rng(5).normal(3, 1, (4, 64, 64))
    rows = spark.createDataFrame([(i, "kept", v.ravel().tolist()) for i, v in enumerate(images)], "id long, _c string, px array<double>").coalesce(1)
    began = time.monotonic()
    found = packed.float_packed(rows, "px", 64).orderBy("id").collect()
    assert time.monotonic() - began < 20
    x, y = np.mgrid[-32:32, -32:32]
    corner = x * x + y * y > (0.99 * 32 - 1.5) ** 2
    for row, v in zip(found, images, strict=True):
        assert row["_c"] == "kept" and row["px"] == pytest.approx((v - v[corner].mean()).ravel(), abs=1e-9)


def test_stacks_that_cannot_be_prepared(spark, sf, tmp_path):
    stack = spark.read.parquet(f"{sf}/embeddings.parquet")
    stack.limit(0).write.parquet(str(tmp_path / "empty"))
    with pytest.raises(ValueError, match="no noise"):
        prepare_stack.run(spark, str(tmp_path / "empty"), str(tmp_path / "out"), **STACK)
    stack.limit(1).withColumn("batch", F.lit(1)).write.parquet(str(tmp_path / "clash"))
    with pytest.raises(ValueError, match="batch"):
        prepare_stack.run(spark, str(tmp_path / "clash"), str(tmp_path / "out"), **STACK)


def screen(spark, tmp_path, **other):
    return screen_texts.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "log"), **TEXTS | other)


def expected_screening(path):
    """Medians and measures by DuckDB over all files that have come in."""
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{path}/*.parquet'")
    rel = con.sql(ORACLES["job2_screen_texts"])
    return sorted(str(dict(sorted(zip(rel.columns, r)))) for r in rel.fetchall())


def found_screening(spark, out):
    rows = screen_texts.screened(spark, out).drop("part", "batch").withColumn("std", F.round("std", 6))
    return sorted(str(dict(sorted(r.asDict().items()))) for r in rows.collect())


def test_screening_takes_only_what_is_new(spark, sf, tmp_path, caplog):
    caplog.set_level(logging.INFO, "jobs.screen_texts")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(3))
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    docs.where(half == 0).repartition(2).write.parquet(source)
    assert screen(spark, tmp_path, files_per_batch=1) == {"batches": 2, "texts": docs.where(half == 0).count()}
    assert found_screening(spark, out) == expected_screening(source)
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "out/records").rglob("*.parquet")}
    docs.where(half == 1).coalesce(1).write.mode("append").parquet(source)
    odd = [(7, None, None, None), (7, "", "en", ""), (7, "one\ntwo\n", None, "a/b=c"), (None, "w " * 100_000, "en", "src1"), (7, "one\ntwo\n", None, "a/b=c")]
    spark.createDataFrame(odd, "doc_id long, text string, lang string, source string").withColumns({"part": F.lit(1), "batch": F.lit(2), "n_words": F.lit(3)}).coalesce(1).write.mode("append").parquet(source)
    assert screen(spark, tmp_path) == {"batches": 1, "texts": docs.where(half == 1).count() + 5}
    con = duckdb.connect()
    con.sql(f"copy (select doc_id, text, lang, source from read_parquet('{source}/*.parquet', union_by_name = true)) to '{tmp_path}/all.parquet'")
    (tmp_path / "whole").mkdir()
    (tmp_path / "all.parquet").rename(tmp_path / "whole/all.parquet")
    assert found_screening(spark, out) == expected_screening(tmp_path / "whole")
    # what stood before was not written again, and a run without new files changes nothing
    assert all(p.stat().st_mtime_ns == t for p, t in files.items())
    everything = sorted((str(p), p.stat().st_mtime_ns) for p in (tmp_path / "out").rglob("*.parquet"))
    assert screen(spark, tmp_path) == {"batches": 0, "texts": 0} and "nothing new" in caplog.text
    assert sorted((str(p), p.stat().st_mtime_ns) for p in (tmp_path / "out").rglob("*.parquet")) == everything
    series = spark.read.parquet(f"{out}/series").agg(F.sum("texts"), F.sum("words")).first()
    assert tuple(series) == tuple(screen_texts.screened(spark, out).agg(F.count(F.lit(1)), F.sum("n_words")).first())


def test_a_batch_that_failed_is_taken_again(spark, sf, tmp_path):
    """The output of a batch is written, its commit is not: the next run repeats it and each file counts once."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs.coalesce(1).write.parquet(str(tmp_path / "in"))
    screen(spark, tmp_path)
    once = found_screening(spark, str(tmp_path / "out"))
    for name in ("0", ".0.crc"):
        (tmp_path / "log/commits" / name).unlink(missing_ok=True)
    assert screen(spark, tmp_path) == {"batches": 1, "texts": docs.count()}
    assert found_screening(spark, str(tmp_path / "out")) == once == expected_screening(tmp_path / "in")


def test_screening_of_nothing_yet(spark, tmp_path):
    (tmp_path / "in").mkdir()
    assert screen(spark, tmp_path) == {"batches": 0, "texts": 0}


def test_command_lines(sf, tmp_path):
    config = tmp_path / "own.json"
    config.write_text(json.dumps(STACK | {"input": f"{sf}/embeddings.parquet", "output": str(tmp_path / "from_file"), "batch_size": 100}))
    run = lambda *a: subprocess.run([sys.executable, "-m", *a], cwd=REPO, capture_output=True, text=True, timeout=300)
    done = run("jobs.prepare_stack", "--config", str(config), "--output", str(tmp_path / "stack"))
    assert done.returncode == 0 and "wrote 500 images in 4 minibatches" in done.stderr, done.stderr[-2000:]
    assert (tmp_path / "stack/images").is_dir() and not (tmp_path / "from_file").exists()
    done = run("jobs.screen_texts", "--input", f"{sf}/documents.parque[t]", "--output", str(tmp_path / "texts"), "--checkpoint", str(tmp_path / "mark"))
    assert done.returncode == 0 and "read 200 texts" in done.stderr, done.stderr[-2000:]
    config.write_text(json.dumps(STACK | {"sidee": 9}))
    done = run("jobs.prepare_stack", "--config", str(config))
    assert done.returncode == 2 and "unknown settings: sidee" in done.stderr
    done = run("jobs.screen_texts", "--input", "x")
    assert done.returncode == 2 and "missing settings: checkpoint, output" in done.stderr
