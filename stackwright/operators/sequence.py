"""Operators over ordered rows: runs, moving windows, batches, splits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stackwright.staging import stage


def runs(df: DataFrame, order: list[str], same: list[str], keys: list[str] | None = None, out: str = "run_id") -> DataFrame:
    """Number the runs of rows with equal values: a value that comes back later starts a new run. Without
    keys the order is global: rows are range-partitioned, numbered in each part, and a table of one row per
    part carries the numbers over its edges."""
    if keys:
        w = W.partitionBy(*keys).orderBy(*order)
        changed = (~F.struct(*same).eqNullSafe(F.lag(F.struct(*same)).over(w))).cast("int")
        return df.withColumn("_c", changed).withColumn(out, F.sum("_c").over(w.rowsBetween(W.unboundedPreceding, 0)) - 1).drop("_c")
    own = free_name([*df.columns, out], "_r")  # no column of the input starts so
    at, part, step, run, base = (f"{own}{x}" for x in ("at", "part", "step", "run", "base"))
    placed = numbered(df, order, at, part=part)
    w = W.partitionBy(part).orderBy(at)
    before = F.lag(F.struct(F.struct(*same).alias("s"))).over(w)  # null in the first row alone
    local = placed.withColumn(step, F.when(before.isNull(), 0).otherwise((~F.struct(*same).eqNullSafe(before["s"])).cast("int")))
    local = local.withColumn(run, F.sum(step).over(w.rowsBetween(W.unboundedPreceding, 0)))
    ends = placed.groupBy(part).agg(F.min_by(F.struct(*same), at).alias("first"), F.max_by(F.struct(*same), at).alias("last"))
    ends = ends.join(local.groupBy(part).agg(F.max(run).alias("inner")), part)
    line = W.orderBy(part)  # one row per part
    previous = F.lag(F.struct(F.col("last").alias("s"))).over(line)
    ends = ends.withColumn("edge", F.when(previous.isNull(), 0).otherwise((~F.col("first").eqNullSafe(previous["s"])).cast("int")))
    before = F.sum(F.col("edge") + F.col("inner")).over(line.rowsBetween(W.unboundedPreceding, 0)) - F.col("inner")
    return local.join(F.broadcast(ends.select(part, before.alias(base))), part).withColumn(out, F.col(run) + F.col(base)).drop(step, run, base, part, at)


def moving_average(df: DataFrame, value: str, size: int, keys: list[str], order: list[str], out: str = "smooth") -> DataFrame:
    """Mean of the row and size - 1 before it; at the start, of the rows seen."""
    return df.withColumn(out, F.avg(value).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(1 - size, 0)))


def taper(size: int, kind: str) -> list[float]:
    """Weights of a smoothing window."""
    step = 2 * math.pi / (size - 1) if size > 1 else 0.0
    shape = {
        "flat": lambda i: 1.0,
        "hanning": lambda i: 0.5 - 0.5 * math.cos(step * i),
        "hamming": lambda i: 0.54 - 0.46 * math.cos(step * i),
        "bartlett": lambda i: 1 - abs(2 * i / (size - 1) - 1) if size > 1 else 1.0,
        "blackman": lambda i: 0.42 - 0.5 * math.cos(step * i) + 0.08 * math.cos(2 * step * i),
    }[kind]
    return [shape(i) for i in range(size)]


def smooth(df: DataFrame, value: str, size: int, keys: list[str], order: list[str], kind: str = "hanning", boundary: str = "reflect", out: str = "smooth") -> DataFrame:
    """Centred weighted mean. Beyond the ends the series is turned about its end values (reflect: k places
    before the start stands 2 * first - the value k + 1 places after it, k places past the end 2 * last - the
    value k - 1 places before it), goes on with its end values (extend), or is 0 before and 1 after it (zeros).
    Windows of less than three rows change nothing."""
    if size < 3:
        return df.withColumn(out, F.col(value).cast("double"))
    half, weights = size // 2, taper(size, kind)
    total = sum(weights)
    w = W.partitionBy(*keys).orderBy(*order)
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    df = df.withColumns({"_n": F.count(F.lit(1)).over(W.partitionBy(*keys)), "_i": F.row_number().over(w) - 1, "_first": F.first(value).over(whole), "_last": F.last(value).over(whole)})
    # only rows within half a window of an end need mirrored values
    near = F.collect_list(value).over(w.rowsBetween(-2 * half, 2 * half))
    df = df.withColumns({"_near": near, "_b": F.greatest(F.col("_i") - 2 * half, F.lit(0))})

    def held(at: Column) -> Column:
        return F.get("_near", (F.least(F.greatest(at, F.lit(0)), F.col("_n") - 1) - F.col("_b")).cast("int"))

    acc = F.lit(0.0)
    for k, weight in enumerate(weights):
        at = F.col("_i") + ((size - 1) // 2 - k)
        ends = {
            "reflect": (2 * F.col("_first") - held(1 - at), 2 * F.col("_last") - held(2 * F.col("_n") - 1 - at)),
            "extend": (F.col("_first"), F.col("_last")),
            "zeros": (F.lit(0.0), F.lit(1.0)),
        }[boundary]
        acc = acc + weight * F.when(at < 0, ends[0]).when(at >= F.col("_n"), ends[1]).otherwise(held(at))
    return df.withColumn(out, acc / total).drop("_n", "_i", "_first", "_last", "_near", "_b")


def throughput(df: DataFrame, count: str, time: str, keys: list[str], order: list[str]) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rate", F.try_divide(F.col(count) - F.lag(count).over(w), F.col(time) - F.lag(time).over(w)))


def hours_since_start(df: DataFrame, time: str, keys: list[str], order: list[str]) -> DataFrame:
    first = F.first(time).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return df.withColumn("hours", (F.col(time) - first) / 3600)


def shuffle_key(row_id: Column, seed: int) -> Column:
    """A reproducible pseudo-random order of integer ids that any engine can state: a multiplicative hash
    of 32 bits, with the seed added."""
    return F.pmod((row_id + seed) * 2654435761, F.lit(1 << 32))


def numbered(df: DataFrame, order: list[Column | str], out: str, buckets: int | None = None, part: str | None = None) -> DataFrame:
    """Global row numbers from 0 without a global task: rows go to ranges of the order, are sorted and numbered in
    each, and written once, so that the numbers stand; each range starts at the number of rows in those
    before it. part: a column for the range's number. Rows with equal sort keys share a range and are numbered in any
    order, so orders end in an id."""
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    exprs = [F.col(o) if isinstance(o, str) else o for o in order]
    own = free_name([*df.columns, out], "_n")  # no column of the input starts so
    names, at, rank, base, rows = [f"{own}o{i}" for i in range(len(exprs))], f"{own}p", f"{own}m", f"{own}b", f"{own}k"
    ranged = df.select("*", *[e.alias(o) for o, e in zip(names, exprs, strict=True)]).repartitionByRange(n, *names).sortWithinPartitions(*names).drop(*names)
    nth = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # the row's place in its partition
    placed = stage(ranged.withColumns({at: F.spark_partition_id(), rank: nth}), "numbered")
    counts = placed.groupBy(at).agg(F.count(F.lit(1)).alias(rows))
    before = F.coalesce(F.sum(rows).over(W.orderBy(at).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row per range
    placed = placed.join(F.broadcast(counts.select(at, before.alias(base))), at).withColumn(out, F.col(rank) + F.col(base)).drop(rank, base)
    return placed.withColumnRenamed(at, part) if part else placed.drop(at)


def free_name(columns: list[str], base: str) -> str:
    """A name that starts with base and starts no column's name."""
    while any(c.lower().startswith(base.lower()) for c in columns):
        base += "_"
    return base


#: Rows up to which one window may cumulate; beyond, ranges of the order are cumulated apart.
WINDOW_ROWS = 1 << 20
#: Levels, and times that a value stands in its group, up to which all levels are looked at.
FEW = 8


def staged_count(df: DataFrame, tag: str) -> tuple[DataFrame, int]:
    """The staged table and its number of rows, counted while it is written."""
    seen = Observation()
    table = stage(df.observe(seen, F.count(F.lit(1)).alias("rows")), tag)
    return table, seen.get["rows"]


def cumulated(table: DataFrame, rows: int, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Adds _before and _all: the sum of a value over the rows of the group before a row, and over the whole group. table is
    staged and has so many rows. Beyond WINDOW_ROWS a group spans ranges of the order: each is summed by itself
    and starts at the sum of those before it, so no group is held in one task. Sums run in the order; where ranges are cut at other
    places, the last digits of sums of fractions may differ."""
    group = W.partitionBy(*keys)
    if rows <= WINDOW_ROWS:
        w = group.orderBy(*order)
        return table.withColumns({"_before": F.sum(value).over(w.rowsBetween(W.unboundedPreceding, 0)) - F.col(value), "_all": F.sum(value).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))})
    n = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = stage(table.repartitionByRange(n, *keys, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    w = W.partitionBy("_part", *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    placed = placed.withColumn("_inner", F.sum(value).over(w) - F.col(value))
    # one row per group and range
    totals = placed.groupBy("_part", *keys).agg(F.max_by(F.col("_inner") + F.col(value), F.struct(*order)).alias("_t"))
    line = group.orderBy("_part")
    earlier = F.coalesce(F.sum("_t").over(line.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select(F.col("_part").alias("_q"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], earlier.alias("_base"), F.sum("_t").over(line.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("_all"))
    same = F.col("_part") == F.col("_q")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return placed.join(totals, same).select(*table.columns, (F.col("_inner") + F.col("_base")).alias("_before"), "_all")


def value_counts(df: DataFrame, value: str, keys: list[str], weight: str | None = None) -> DataFrame:
    """(keys, value, _n, _before, _all): how often each value that is not null stands in its group, and how many rows of
    the group come before it and in all. Equal values are counted before any shuffle, so neither a group nor
    a value is held in one task, however often it comes. The counts are staged: the rows are read once."""
    held = df.where(F.col(value).isNotNull()).groupBy(*keys, value)
    counts, rows = staged_count(held.agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_n")), "counts")
    return cumulated(counts, rows, keys, [value], "_n")


def share_of_quantile(level: Column | float) -> Column:
    """How much a row of value_counts has in its group's quantile, linear between ranks."""
    rank = F.lit(level) * (F.col("_all") - 1)
    low, above = F.floor(rank), rank - F.floor(rank)
    holds = lambda r: (F.col("_before") <= r) & (r < F.col("_before") + F.col("_n"))
    return F.when(holds(low), 1 - above).otherwise(0.0) + F.when(holds(low + 1), above).otherwise(0.0)


def order_statistics(df: DataFrame, value: str, keys: list[str], levels: list[float], weight: str | None = None) -> DataFrame:
    """(keys, level, quantile): exact quantiles of the values that are not null, linear between ranks, from the
    cumulated counts of distinct values. weight: a column with how often each row counts."""
    counts = value_counts(df, value, keys, weight)
    shares = F.transform(F.array(*map(F.lit, levels)), lambda q: F.struct(q.alias("level"), share_of_quantile(q).alias("_w")))
    each = lambda rows: rows.select(*keys, value, F.inline(F.filter(shares, lambda s: s["_w"] > 0)))
    if len(levels) <= FEW:
        rows = each(counts)
    else:
        # values that stand a few times meet the wanted ranks by an equi-join; only the others look at all levels
        rank = F.col("level") * (F.col("_size") - 1)
        above = rank - F.floor(rank)
        ends = F.array(F.struct(F.floor(rank).alias("_k"), (1 - above).alias("_w")), F.struct((F.floor(rank) + 1).alias("_k"), above.alias("_w")))
        wanted = counts.groupBy(*keys).agg(F.max("_all").alias("_size")).withColumn("level", F.explode(F.array(*map(F.lit, levels))))
        wanted = wanted.select(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)], "level", F.inline(ends)).where("_w > 0")
        few = counts.where(F.col("_n") <= FEW).select(*keys, value, F.explode(F.sequence("_before", F.col("_before") + F.col("_n") - 1)).alias("_rank"))
        same = F.col("_rank") == F.col("_k")
        for i, k in enumerate(keys):
            same &= F.col(k).eqNullSafe(F.col(f"_g{i}"))
        rows = few.join(wanted, same).select(*keys, value, "level", "_w").unionByName(each(counts.where(F.col("_n") > FEW)))
    return rows.groupBy(*keys, "level").agg(F.sum(F.col("_w") * F.col(value)).alias("quantile"))


def split_test(df: DataFrame, row_id: str, n_test: int, seed: int) -> DataFrame:
    """Shuffle by seed; the first n_test rows are the test set, the others the training set."""
    placed = numbered(df, [shuffle_key(F.col(row_id), seed), F.col(row_id)], "place")
    return placed.withColumn("split", F.when(F.col("place") < n_test, "test").otherwise("train"))


def batch_of(place: Column, n_rows: int, batch_size: int) -> Column:
    """Contiguous batches of nearly equal size; what is left over makes the last batches one larger."""
    n_batches = max(1, n_rows // batch_size)
    base, extra = divmod(n_rows, n_batches)
    small = (n_batches - extra) * base
    return F.when(place < small, F.floor(place / max(base, 1))).otherwise((n_batches - extra) + F.floor((place - small) / (base + 1))).cast("int")


def epochs(batches: DataFrame, size: str, n_epochs: int, seed: int) -> DataFrame:
    """(epoch, turn, batch_id, size, visits, progress): the batches (batch_id, size) in a new order each epoch,
    by a hash of batch, epoch and seed; visits counts rows since the start, progress runs on from the epoch's
    number. One row per batch and epoch, numbered within its epoch."""
    rows = batches.select("batch_id", F.col(size).alias("size"), F.explode(F.sequence(F.lit(0), F.lit(n_epochs - 1))).alias("epoch"))
    key = shuffle_key(F.col("batch_id") * n_epochs + F.col("epoch"), seed)
    w = W.partitionBy("epoch").orderBy(key, "batch_id")
    seen, all_rows = F.sum("size").over(w.rowsBetween(W.unboundedPreceding, 0)), F.sum("size").over(W.partitionBy("epoch"))
    return rows.select("epoch", (F.row_number().over(w) - 1).alias("turn"), "batch_id", "size", (F.col("epoch") * all_rows + seen).alias("visits"), (F.col("epoch") + seen / all_rows).alias("progress"))


def gather(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows whose key is wanted, once each however often it is."""
    return rows.join(wanted.select(key), key, "left_semi")


def minibatch(images: DataFrame, batches: DataFrame, key: str, batch: int | None) -> DataFrame:
    """The images of one batch of the training set, or of the test set (batch None), from (key, split,
    batch_id)."""
    return gather(images, batches.where("split = 'test'" if batch is None else f"split = 'train' AND batch_id = {int(batch)}"), key)


def epoch_fraction(batches: DataFrame, size: str, order: str) -> DataFrame:
    """How far through the training set each batch ends; a handful of rows per epoch."""
    w = W.orderBy(order)
    return batches.withColumn("epoch", F.sum(size).over(w.rowsBetween(W.unboundedPreceding, 0)) / F.sum(size).over(W.partitionBy()))
