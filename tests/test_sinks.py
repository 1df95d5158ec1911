"""Writers that all tasks share, and the stream of result files."""

import json
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from stackwright.sources import mrc, results, star


def stack(spark, n=23, size=36, parts=5):
    px = np.random.default_rng(0).normal(size=(n, size)).astype(np.float32)
    return px, spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(px)], "image_id long, px array<float>").repartition(parts)


def test_a_stack_written_by_all_tasks(spark, tmp_path):
    px, df = stack(spark)
    path = str(tmp_path / "a.mrc")
    for _ in range(2):  # again over the first
        mrc.write_stack(df, path, 2.5)
    data = open(path, "rb").read()
    head = mrc.parse_header(data)
    assert (head["nx"], head["ny"], head["nz"], head["pixel_size"]) == (6, 6, 23, pytest.approx(2.5))
    assert np.frombuffer(data, "<f4", 3, 76) == pytest.approx([px.min(), px.max(), px.mean()], rel=1e-5)
    assert np.frombuffer(data, "<f4", 23 * 36, 1024).reshape(23, 36).tolist() == px.tolist()
    assert data == mrc.build_header((6, 6, 23), 2.5, *np.frombuffer(data, "<f4", 3, 76).tolist()) + px.tobytes()
    assert os.listdir(tmp_path) == ["a.mrc"]
    mrc.write_stack(df.limit(0), str(tmp_path / "none.mrc"))
    assert mrc.parse_header(open(tmp_path / "none.mrc", "rb").read())["nz"] == 0


def test_nothing_stays_of_a_write_that_fails(spark, tmp_path):
    """A task that fails, ids with gaps or twice, images of two sizes: no file, and an older one is kept."""
    _, df = stack(spark)
    path = str(tmp_path / "a.mrc")
    mrc.write_stack(df.where("image_id < 4"), path)
    old = open(path, "rb").read()
    broken = [
        df.withColumn("px", F.when(F.col("image_id") == 7, F.array(F.lit(1.0).cast("float"))).otherwise(F.col("px"))),
        df.withColumn("px", F.when(F.col("image_id") == 7, F.lit(None)).otherwise(F.col("px"))),
        df.where("image_id != 3"),
        df.unionByName(df.where("image_id = 3")),
        df.where("image_id < 4").withColumn("px", F.when(F.col("image_id") < 2, F.slice("px", 1, 4)).otherwise(F.col("px"))).repartition(4, "image_id"),
    ]
    for bad in broken:
        with pytest.raises(Exception):  # noqa: B017
            mrc.write_stack(bad, path)
        assert os.listdir(tmp_path) == ["a.mrc"] and open(path, "rb").read() == old


def test_star_files_in_ranges(spark, tmp_path):
    df = spark.range(500).select(F.col("id").alias("n"), (F.col("id") / 7).alias("x"), F.concat(F.lit("s"), "id").alias("name")).repartition(7)
    path = str(tmp_path / "star")
    star.write_star(df, path, "particles", "n", 4)
    files = sorted(p for p in os.listdir(path) if p.startswith("part"))
    assert len(files) == 4
    lists = [open(f"{path}/{f}").read().split("\n") for f in files]
    assert all(lines[:4] == ["", "data_particles", "", "loop_"] and lines[4] == "_n #1" for lines in lists)
    firsts = [int(lines[7].split()[0]) for lines in lists]
    assert firsts == sorted(firsts)
    rows = star.read_star(spark, path)
    assert sorted((int(r["n"]), r["x"], r["name"]) for r in rows.collect()) == [(i, pytest.approx(i / 7, abs=1e-6), f"s{i}") for i in range(500)]
    star.write_star(df.limit(0), path)
    assert star.read_star(spark, path).count() == 0


def take(spark, folder, tmp_path):
    """One look: (file, content) of what was new."""
    results.register(spark)
    out = str(tmp_path / f"out{time.time_ns()}")
    stream = spark.readStream.format("results").option("pattern", "*.json").load(str(folder))
    q = stream.writeStream.option("checkpointLocation", str(tmp_path / "log")).foreachBatch(lambda b, i: b.write.mode("append").parquet(out)).trigger(availableNow=True).start()
    q.awaitTermination()
    if not os.path.isdir(out):
        return []
    return sorted((r["file"], r["content"].decode()) for r in spark.read.parquet(out).collect())


def test_result_files_are_taken_when_they_change(spark, tmp_path):
    runs = tmp_path / "runs"
    (runs / "a").mkdir(parents=True)
    (runs / "a/stat.json").write_text(json.dumps({"n": 1}))
    (runs / "a/other.txt").write_text("no")
    (runs / "a/_part.json").write_text("not yet")
    assert take(spark, runs, tmp_path) == [("a/stat.json", '{"n": 1}')]
    assert take(spark, runs, tmp_path) == []
    (runs / "b").mkdir()
    (runs / "b/stat.json").write_text('{"n": 2}')
    (runs / "a/_part.json").rename(runs / "a/part.json")
    assert take(spark, runs, tmp_path) == [("a/part.json", "not yet"), ("b/stat.json", '{"n": 2}')]
    (runs / "a/stat.json").write_text('{"n": 3}')  # under the same name, also if it is older than others
    os.utime(runs / "a/stat.json", (1, 1))
    assert take(spark, runs, tmp_path) == [("a/stat.json", '{"n": 3}')]
    (runs / "b/stat.json").unlink()
    assert take(spark, runs, tmp_path) == []
