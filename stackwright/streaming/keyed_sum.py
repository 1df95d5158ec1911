"""The keyed running sum with everything it can do: the latest value of each key, weights that fade with every update of
any key, the second moment, and the mean of what went before when the number of keys changes.

A group (one sum) expects n keys. An update of a key replaces its value with weight 1 and multiplies all other weights by the
decay. When rows come with another n, a new phase begins: the mean so far becomes history, with the weight it had, of
which the share of keys that are not yet seen in the phase still counts. `running_sums` states this over a table,
`keep_running_sums` over a stream, with the same results.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from stackwright.operators.sequence import numbered, runs

#: The state store that processors with several state variables need.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def running_sums(df: DataFrame, group: str, key: str, value: str, order: str, n_keys: str, decay: float = 1.0) -> DataFrame:
    """(group, updates, weight, mean, mean_square) after all rows, in order. Updates are numbered by a distributed sort and
    summed before any shuffle by group; only a group's phases come together, which are few."""
    rows = df.select(F.col(group).alias("_g"), F.col(key).alias("_key"), F.col(value).cast("double").alias("_v"), F.col(order).alias("_o"), F.col(n_keys).cast("long").alias("_n"))
    rows = runs(numbered(rows, ["_g", "_o"], "_at"), ["_at"], ["_g", "_n"], out="_phase")
    latest = rows.groupBy("_g", "_phase", "_n", "_key").agg(F.max(F.struct("_at", "_v")).alias("_l"), F.min("_at").alias("_first"))
    # rows are numbered over the whole order, so a difference tells how many updates of the phase follow
    ends = latest.groupBy("_phase").agg(F.max("_l._at").alias("_end"), F.min("_first").alias("_begin"))
    held = latest.join(ends, "_phase").withColumn("_w", F.exp(F.log(F.lit(decay)) * (F.col("_end") - F.col("_l._at"))))
    sums = held.groupBy("_g", "_phase", "_n", (F.col("_end") - F.col("_begin") + 1).alias("updates")).agg(F.count(F.lit(1)).alias("keys"), F.sum("_w").alias("w"), F.sum(F.col("_w") * F.col("_l._v")).alias("s"), F.sum(F.col("_w") * F.col("_l._v") * F.col("_l._v")).alias("q"))
    phases = sums.groupBy("_g").agg(F.sum("updates").alias("updates"), F.array_sort(F.collect_list(F.struct("_phase", F.col("_n").alias("n"), F.col("updates").alias("t"), "keys", "w", "s", "q"))).alias("_p"))

    def carried(acc, p):
        left = F.greatest(p["n"] - p["keys"], F.lit(0)) / p["n"]
        history = acc["weight"] * F.exp(F.log(F.lit(decay)) * p["t"]) * left
        weight = history + p["w"]
        return F.struct(weight.alias("weight"), ((history * acc["mean"] + p["s"]) / weight).alias("mean"), ((history * acc["mean_square"] + p["q"]) / weight).alias("mean_square"))

    start = F.struct(F.lit(0.0).alias("weight"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("mean_square"))
    return phases.select(F.col("_g").alias(group), "updates", F.aggregate("_p", start, carried).alias("_a")).select(group, "updates", "_a.*")


class RunningSums(StatefulProcessor):
    """One group's sum in Spark's state store: totals in a value state, the latest values in a map state. An update costs the same
    however many keys there are: weights are told from how many updates ago a key was set. idle: a group without rows for so
    many milliseconds of event time is over: a timer drops its state, so that groups that end take no room."""

    def __init__(self, columns: tuple[str, str, str, str, str], decay: float, time: str | None = None, idle: int | None = None):
        self.group, self.key, self.value, self.order, self.n_keys = columns
        self.decay, self.time, self.idle = decay, time, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", "n long, t long, updates long, keys long, w double, s double, q double, hw double, hm double, hq double")
        self.latest = handle.getMapState("latest", "key long", "value double, t long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = self.totals.get()
        n, t, updates, keys, w, s, q, hw, hm, hq = state if state is not None else (0, 0, 0, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)
        seen: dict[int, tuple[float, int]] = {}  # each key is read and written once a batch
        batch = pd.concat(list(rows)).sort_values(self.order)
        for k, v, wanted in zip(batch[self.key].tolist(), batch[self.value].tolist(), batch[self.n_keys].tolist(), strict=True):
            if wanted != n:
                if n:
                    hw, hm, hq = _mean(n, keys, w, s, q, hw, hm, hq)
                    self.latest.clear()
                n, keys, w, s, q, seen = wanted, 0, 0.0, 0.0, 0.0, {}
            before = seen.get(k)
            if before is None and self.latest.containsKey((k,)):
                before = tuple(self.latest.getValue((k,)))
            if before is None:
                keys += 1
            else:
                faded = self.decay ** (t - before[1])
                w, s, q = w - faded, s - faded * before[0], q - faded * before[0] ** 2
            t, updates = t + 1, updates + 1
            hw, w, s, q = self.decay * hw, self.decay * w + 1, self.decay * s + v, self.decay * q + v * v
            seen[k] = (v, t)
        for k, held in seen.items():
            self.latest.updateValue((k,), held)
        self.totals.update((n, t, updates, keys, w, s, q, hw, hm, hq))
        if self.idle is not None:
            # late rows may be older than what the running timer goes by
            end = int(pd.to_datetime(batch[self.time]).max().timestamp() * 1000) + self.idle
            known = [t for t in self.handle.listTimers()]
            for earlier in known:
                if earlier < end:
                    self.handle.deleteTimer(earlier)
            if all(earlier < end for earlier in known):
                self.handle.registerTimer(end)
        weight, mean, square = _mean(n, keys, w, s, q, hw, hm, hq)
        yield pd.DataFrame({self.group: [key[0]], "updates": [updates], "weight": [weight], "mean": [mean], "mean_square": [square]})

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        """A sum that goes on from what a table holds of it (group, weight, mean, mean_square, n): its history."""
        row = initialState.iloc[0]
        self.totals.update((int(row["n"]), 0, 0, 0, 0.0, 0.0, 0.0, float(row["weight"]), float(row["mean"]), float(row["mean_square"])))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """The group is over: its last row is given once more, its state goes."""
        n, _, updates, *sums = self.totals.get()
        weight, mean, square = _mean(n, *sums)
        self.totals.clear()
        self.latest.clear()
        yield pd.DataFrame({self.group: [key[0]], "updates": [updates], "weight": [weight], "mean": [mean], "mean_square": [square]})

    def close(self) -> None:
        pass


def _mean(n, keys, w, s, q, hw, hm, hq) -> tuple[float, float, float]:
    """(weight, mean, mean of squares), history included as far as it counts."""
    history = hw * max(n - keys, 0) / n
    weight = history + w
    return weight, (history * hm + s) / weight, (history * hq + q) / weight


def keep_running_sums(stream: DataFrame, group: str, key: str, value: str, order: str, n_keys: str, decay: float = 1.0, start: DataFrame | None = None, time: str | None = None, idle: int | None = None) -> DataFrame:
    """(group, updates, weight, mean, mean_square) of each group that a micro-batch updates. Keys are long. Rows of one micro-batch
    are taken in order; the session's state store must be PROVIDER. start: sums that go on, see RunningSums. time, idle: a
    timestamp column with a watermark, and after how many milliseconds without rows a group ends; one that comes
    again later begins anew."""
    kind = stream.schema[group].dataType.simpleString()
    extra = [time] if time and time != order else []
    rows = stream.select(group, F.col(key).cast("long").alias(key), F.col(value).cast("double").alias(value), order, F.col(n_keys).cast("long").alias(n_keys), *extra)
    return rows.groupBy(group).transformWithStateInPandas(
        statefulProcessor=RunningSums((group, key, value, order, n_keys), decay, time, idle),
        outputStructType=f"{group} {kind}, updates long, weight double, mean double, mean_square double",
        outputMode="Update",
        timeMode="EventTime" if idle is not None else "None",
        initialState=start.groupBy(group) if start is not None else None,
    )


def latest_rows(written: DataFrame, group: str) -> DataFrame:
    """The last row of each group among those that micro-batches have written."""
    names = [c for c in ("updates", "weight", "mean", "mean_square")]
    return written.groupBy(group).agg(F.max_by(F.struct(*names), "updates").alias("_r")).select(group, "_r.*")
