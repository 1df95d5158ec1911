"""Element-wise sums of long arrays: partial sums in each task, blocks of elements over the shuffle, a tree of merges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements of a block; sums that a task holds before it passes them on; partial sums that are merged at once.
BLOCK, HELD, FAN = 4096, 1 << 25, 64


def sum_arrays(df: DataFrame, keys: list[str], values: list[str], block: int = BLOCK) -> DataFrame:
    """(keys, block, values): the sums of each group's arrays, in blocks of elements; all arrays of a row are equally long.

    A task adds up its rows first, so one row per group and block leaves it, however many rows the group has. Shorter
    arrays count as 0 beyond their end; rows with a null array are left out."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rows = df.where(~sum(F.col(v).isNull().cast("int") for v in values).cast("boolean")).select(*keys, *[F.col(v).cast("array<double>").alias(v) for v in values])

    def work(batches):
        task, sums, size = TaskContext.get().partitionId(), {}, 0
        for batch in batches:
            groups = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True)) if keys else [()] * batch.num_rows
            columns = [flat(batch.column(v)) for v in values]
            for i, group in enumerate(groups):
                parts = [data[at[i] : at[i + 1]] for data, at in columns]
                held = sums.get(group)
                if held is None or len(held[0]) < len(parts[0]):
                    grown = np.zeros((len(values), len(parts[0])))
                    if held is not None:
                        grown[:, : held.shape[1]] = held
                        size -= held.size
                    held = sums[group] = grown
                    size += held.size
                for total, part in zip(held, parts, strict=True):
                    total[: len(part)] += part
            if size > HELD:
                yield from blocks_of(sums, task)
                sums, size = {}, 0
        yield from blocks_of(sums, task)

    def blocks_of(sums: dict, task: int):
        for group, total in sums.items():
            cuts = range(0, total.shape[1], block)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([k] * len(cuts), t) for k, t in zip(group, key_types, strict=True)), pa.array(range(len(cuts)), pa.int32()), pa.array([task] * len(cuts), pa.int32()), *(pa.array([t[a : a + block] for a in cuts], pa.list_(pa.float64())) for t in total)],
                names=[*keys, "block", "_task", *values],
            )

    key_types = [f.type for f in _arrow_schema(df, keys)]
    parts = rows.mapInArrow(work, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "block int", "_task int", *(f"{v} array<double>" for v in values)]))
    return merge_blocks(parts, keys, values)


def _arrow_schema(df: DataFrame, keys: list[str]) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.select(*keys).schema) if keys else pa.schema([])


def flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All elements of a list column, and where each list begins and ends among them."""
    at = lists.offsets.to_numpy()
    return lists.flatten().to_numpy(zero_copy_only=False), at - at[0]


def added(lists: Column) -> Column:
    """The element-wise sum of equally long arrays."""
    return F.aggregate(F.slice(lists, 2, F.size(lists)), F.get(lists, F.lit(0)), lambda a, b: F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0))))


def merge_blocks(parts: DataFrame, keys: list[str], values: list[str], fan: int = FAN) -> DataFrame:
    """(keys, block, values): partial sums (keys, block, _task, values) of any number of tasks added up, in two rounds, so that
    no row ever gathers the blocks of all tasks."""
    gather = lambda df, by: df.groupBy(*keys, "block", *by).agg(*[F.collect_list(v).alias(v) for v in values]).select(*keys, "block", *by, *[added(F.col(v)).alias(v) for v in values])
    first = gather(parts.withColumn("_lane", F.floor(F.col("_task") / fan)), ["_lane"])
    return gather(first, [])


def elements(blocks: DataFrame, keys: list[str], values: list[str], block: int = BLOCK) -> DataFrame:
    """(keys, at, values): one row per element."""
    rows = blocks.select(*keys, "block", F.posexplode(F.arrays_zip(*values)).alias("_i", "_v"))
    return rows.select(*keys, (F.col("block") * block + F.col("_i")).alias("at"), *[F.col(f"_v.{v}").alias(v) for v in values])
