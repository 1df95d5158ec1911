"""Sums in log space, posteriors, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stackwright.operators.sequence import cumulated, staged_count


def log_sum_exp(df: DataFrame, value: str, keys: list[str], weight: str | None = None, out: str = "lse") -> DataFrame:
    """log(sum(weight * exp(value))) of each group, by the group's maximum, so that nothing overflows.
    Groups without weight or with -inf alone give -inf."""
    top = df.groupBy(*keys).agg(F.max(value).alias("_top"))
    rows = df.join(top, keys) if keys else df.crossJoin(F.broadcast(top))
    shifted = F.when(F.col("_top") == float("-inf"), F.lit(0.0)).otherwise(F.exp(F.col(value) - F.col("_top")))
    sums = rows.groupBy(*keys, "_top").agg(F.sum(shifted * (F.col(weight) if weight else 1)).alias("_s"))
    return sums.select(*keys, F.when(F.col("_s") > 0, F.col("_top") + F.ln("_s")).otherwise(F.lit(float("-inf"))).alias(out))


def log_add_exp(a: Column, b: Column) -> Column:
    """log(exp(a) + exp(b)) of two columns."""
    top = F.greatest(a, b)
    return F.when(top == float("-inf"), top).otherwise(top + F.ln(F.exp(a - top) + F.exp(b - top)))


def posterior(df: DataFrame, log_value: str, keys: list[str], out: str = "p") -> DataFrame:
    """Softmax within each group; where nothing is finite, uniform."""
    w = W.partitionBy(*keys)
    finite = F.when(F.isnan(log_value) | (F.col(log_value) == float("inf")) | F.col(log_value).isNull(), F.lit(float("-inf"))).otherwise(F.col(log_value))
    df = df.withColumn("_v", finite).withColumn("_top", F.max("_v").over(w))
    e = F.when(F.col("_top") == float("-inf"), F.lit(1.0)).otherwise(F.exp(F.col("_v") - F.col("_top")))
    return df.withColumn("_e", e).withColumn(out, F.col("_e") / F.sum("_e").over(w)).drop("_v", "_top", "_e")


def marginal(df: DataFrame, p: str, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(p).alias("p"))


def effective_size(df: DataFrame, p: str, keys: list[str]) -> DataFrame:
    """1 / sum(p * p)."""
    return df.groupBy(*keys).agg((1 / F.sum(F.col(p) * F.col(p))).alias("ess"))


def mixed(image: Column, overall: Column, n: Column, prior: float, global_share: float) -> Column:
    """An image's own distribution, mixed with the uniform one and the global one."""
    return (1 - prior) * image + prior * (1 - global_share) / n + prior * global_share * overall


def sample_size(ess: Column, n: Column, scale: float) -> Column:
    return F.least(F.ceil(scale * ess), n)


def worth_sampling(ess: Column, samples: Column, n: Column) -> Column:
    """Sampling must save at least 5 percent of the work."""
    return F.least(ess, samples) / n < 0.95


def residual_counts(n: Column, p: Column) -> tuple[Column, Column]:
    """Certain part of a residual multinomial draw, and the probability mass left to draw from."""
    sure = F.floor(n * p)
    return sure, n * p - sure


def portable_unit(*parts: Column | str | int) -> Column:
    """A pseudo-random number in [0, 1) that any engine can state: the first 32 bits of the md5 of the parts as text, with
    colons between them."""
    text = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.col(p).cast("string") if isinstance(p, str) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def draw(df: DataFrame, keys: list[str], item: str, p: str, n: str, seed: int, residual: bool = False) -> DataFrame:
    """(keys, item, count, weight): n items of each group drawn in proportion to p, weight count / (share * n).

    A systematic draw: the group's items lie one after the other on a line of length n, and every whole number plus a
    hash of seed and group picks the item it falls on. Each item is drawn n times its share on average, and at most
    once more or less; residual: the whole part of n times the share is certain, what is left over is drawn. A draw
    needs the sums before each item alone, which ranges of a large group find apart, so no group is held in one task,
    and a run that is repeated draws the same. Items with a null or no p are never drawn."""
    rows = df.where(F.col(p) > 0).select(*keys, item, F.col(p).cast("double").alias("_p"), F.col(n).alias("_draws"))
    placed = cumulated(*staged_count(rows, "draw"), keys, [item], "_p").withColumn("_share", F.col("_p") / F.col("_all"))
    if residual:
        sure, rest = residual_counts(F.lit(1), F.round(F.col("_draws") * F.col("_share"), 9))
        rows = placed.select(*keys, item, "_share", "_draws", sure.alias("_sure"), rest.alias("_rest"))
        placed = cumulated(*staged_count(rows, "draw"), keys, [item], "_rest")
        low, width, certain = F.col("_before"), F.col("_rest"), F.col("_sure")
    else:
        low, width, certain = F.col("_before") / F.col("_all") * F.col("_draws"), F.col("_share") * F.col("_draws"), F.lit(0)
    start = portable_unit(seed, *keys)
    # rounded, so that sums of shares end in whole numbers
    hits = F.ceil(F.round(low + width, 9) - start) - F.ceil(F.round(low, 9) - start)
    out = placed.withColumn("count", (certain + hits).cast("long")).where("count > 0")
    return out.select(*keys, item, "count", (F.col("count") / (F.col("_share") * F.col("_draws"))).alias("weight"))
