"""Make an image stack ready for a reconstruction.

    python -m jobs.prepare_stack --input stack.parquet --output prepared

Reads a table of packed images, subtracts each image's mean corner value, scales the stack to unit noise variance,
shuffles it by a hash of the ids, sets test images apart and cuts the others into minibatches.

Writes `output`/images as Parquet in partitions split=test|train / batch=k, so that a minibatch is one
partition to read, with the columns it read, place long and image array<double>; and `output`/summary, one JSON row with
the numbers of the log. The same input and settings give the same rows. A second run writes both anew; after a run
that was stopped, run it again. Images without pixels (null or empty) have no corner: they are left out and counted in
the log. Columns named place, split, batch or image in the input are refused.
"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command_line, counted
from stackwright.operators import packed, robust, sequence
from stackwright.staging import scope

LOG = logging.getLogger("jobs.prepare_stack")
#: Columns that the job adds.
ADDED = ("place", "split", "batch", "image")


def run(spark: SparkSession, input: str, output: str, side: int, id_column: str, pixel_column: str, noise: str, radius: float, test_images: int, batch_size: int, seed: int) -> dict:
    """The job; returns its summary."""
    source = spark.read.parquet(input)
    if clash := sorted(set(source.columns) & set(ADDED)):
        raise ValueError(f"columns that the job adds are in the input: {clash}")
    with scope(spark):
        whole = source.where(F.size(pixel_column) == side * side)

        def floated(images: DataFrame) -> DataFrame:
            return packed.float_packed(images.withColumn("image", F.transform(pixel_column, lambda v: v.cast("double"))), "image", side, radius)

        # the numbers of the whole stack: two narrow reads and one shuffle of counted values
        totals = source.agg(F.count(F.lit(1)).alias("read"), F.count_if(F.coalesce(F.size(pixel_column), F.lit(-1)) == side * side).alias("whole")).first()
        LOG.info("read %d images of %s, %d of them with %d x %d pixels", totals["read"], input, totals["whole"], side, side)
        numbers = robust.snr(packed.data_variance_packed(floated(whole), "image"), packed.noise_variance_packed(floated(whole), "image", side, noise, radius)).first()
        if not numbers or not numbers["noise"]:
            raise ValueError("the corners hold no noise to scale by")
        n_test = min(test_images, totals["whole"])
        n_train = totals["whole"] - n_test
        # rows are put in order as they were read: the sort neither makes nor carries the images
        placed = sequence.split_test(whole, id_column, n_test, seed)
        scaled = floated(placed).withColumn("image", F.transform("image", lambda v: v / F.lit(numbers["noise"] ** 0.5)))
        batch = F.when(F.col("place") < n_test, F.lit(0)).otherwise(sequence.batch_of(F.col("place") - n_test, n_train, batch_size) if n_train else F.lit(0))
        # rows lie in order of place, so a task holds whole neighbouring batches
        rows, seen = counted(scaled.withColumn("batch", batch.cast("int")))
        rows.write.mode("overwrite").partitionBy("split", "batch").parquet(f"{output}/images")
        summary = {"images": seen.get["rows"], "left_out": totals["read"] - totals["whole"], "test": n_test, "train": n_train, "batches": max(1, n_train // batch_size) if n_train else 0, "data_variance": numbers["data"], "noise_variance": numbers["noise"], "signal_percent": numbers["percent"]}
        spark.createDataFrame([summary]).coalesce(1).write.mode("overwrite").json(f"{output}/summary")
    LOG.info("wrote %d images in %d minibatches and a test set of %d to %s/images", summary["images"], summary["batches"], n_test, output)
    return summary


def prepared(spark: SparkSession, output: str) -> DataFrame:
    """What the job has written."""
    return spark.read.parquet(f"{output}/images")


def arguments() -> argparse.ArgumentParser:
    spec = argparse.ArgumentParser(prog="prepare_stack", description=__doc__.splitlines()[0])
    for name, kind in {"input": str, "output": str, "side": int, "id_column": str, "pixel_column": str, "noise": str, "radius": float, "test_images": int, "batch_size": int, "seed": int}.items():
        spec.add_argument(f"--{name}", type=kind)
    return spec


if __name__ == "__main__":
    command_line(run, arguments())
