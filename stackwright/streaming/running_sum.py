"""The keyed running sum over a stream: the same state as the batch operators, batch by batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_per_key(stream: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """(key, value): the latest value of each key so far. A native streaming aggregation; run it in
    complete or update mode."""
    return stream.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def windowed_mean(stream: DataFrame, time: str, value: str, keys: list[str], width: str, late: str) -> DataFrame:
    """(window, keys, n, mean) per event-time window; rows later than the watermark are dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))


def decayed_per_key(stream: DataFrame, key: str, value: str, order: str, decay: float) -> DataFrame:
    """(key, total, weight) after each micro-batch: every later update multiplies earlier weights by the
    decay. State is two numbers a key, kept by Spark, so it survives lost executors."""

    def update(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        total, weight = state.get if state.exists else (0.0, 0.0)
        rows = pd.concat(list(batches)).sort_values(order)
        for v in rows[value]:
            total, weight = decay * total + v, decay * weight + 1
        state.update((total, weight))
        yield pd.DataFrame({key: [k[0]], "total": [total], "weight": [weight]})

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, total double, weight double", "total double, weight double", "update", "NoTimeout")
