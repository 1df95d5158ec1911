"""A step of averaged-gradient descent over tables: the latest gradient of each minibatch is a row, and nothing of the
parameter's length comes to the driver.

Vectors lie in parts: (part, array). One row a part, or a part and minibatch; all arrays of a part are equally long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackwright.operators.blocks import sum_arrays
from stackwright.operators.grid import small

#: Elements of a part at most: sums over minibatches keep a part whole.
PART = 1 << 20


def _zip(a: Column, b: Column, f) -> Column:
    return F.zip_with(a, b, f)


def record_gradient(table: DataFrame, fresh: DataFrame, batch: int, decay: float = 1.0) -> DataFrame:
    """(batch, part, g, weight): the latest gradients with this minibatch's in place of its last; weights before it fade."""
    kept = table.where(F.col("batch") != batch).withColumn("weight", F.col("weight") * decay)
    return kept.unionByName(fresh.select(F.lit(batch).cast(table.schema["batch"].dataType).alias("batch"), "part", "g", F.lit(1.0).alias("weight")))


def mean_gradient(table: DataFrame) -> DataFrame:
    """(part, mean, square, weight): weighted mean and mean square of each coordinate over minibatches. Tasks add up
    their minibatches before the shuffle."""
    rows = table.select("part", F.transform("g", lambda v: v * F.col("weight")).alias("mean"), F.transform("g", lambda v: v * v * F.col("weight")).alias("square"), F.array("weight").alias("weight"))
    sums = sum_arrays(rows, ["part"], ["mean", "square", "weight"], PART).withColumn("weight", F.get("weight", F.lit(0)))
    return sums.select("part", *[F.transform(c, lambda v: v / F.col("weight")).alias(c) for c in ("mean", "square")], "weight")


def preconditioner(means: DataFrame, prior_weight: float = 10.0, most: float = 1000.0) -> DataFrame:
    """(part, scale): 1 for the flattest coordinate, less for those whose gradients have large second moments; these are
    drawn to their mean as by prior_weight minibatches. Three numbers of the whole vector meet all parts."""
    values = means.select(F.explode("square").alias("v"), "weight").agg(F.avg("v").alias("middle"), F.max("weight").alias("w"))
    drawn = lambda v: F.when(F.col("w") > 1, (F.col("middle") * prior_weight + v * F.col("w")) / (F.col("w") + prior_weight)).otherwise(F.col("middle"))
    rows = means.crossJoin(F.broadcast(values)).select("part", F.transform("square", drawn).alias("f"))
    ends = rows.select(F.explode("f").alias("v")).agg(F.min("v").alias("lo"), F.max("v").alias("hi")).select(F.greatest("lo", F.col("hi") / most).alias("least"))
    scale = F.transform("f", lambda v: F.when(F.col("least") > 0, F.sqrt(F.col("least") / F.greatest(F.col("least"), v))).otherwise(1.0))
    return rows.crossJoin(F.broadcast(ends)).select("part", scale.alias("scale"))


def descend(x: DataFrame, table: DataFrame, fresh: DataFrame, batch: int, prior: DataFrame, rate: float, decay: float = 1.0, saga: bool = True, precondition: bool = True) -> DataFrame:
    """(part, x) after a step of x (part, x) along the averaged gradient. fresh (part, g): this minibatch's gradient, prior (part, p): the
    prior's. saga: the average before the step and the change of this minibatch's gradient; else the average
    after it. rate: learn rate over the Lipschitz constant. All joins are on parts."""
    after = mean_gradient(record_gradient(table, fresh, batch, decay))
    rows = x.join(prior, "part")
    if saga:
        before = mean_gradient(table).select("part", F.col("mean").alias("b"))
        last = table.where(F.col("batch") == batch).select("part", F.col("g").alias("l"))
        rows = rows.join(before, "part").join(last, "part", "left").join(fresh.select("part", "g"), "part").join(after.select("part", "mean"), "part")
        change = _zip(F.col("b"), _zip(F.col("g"), F.col("l"), lambda a, b: a - b), lambda a, b: a + b)
        rows = rows.withColumn("m", F.when(F.col("l").isNull(), F.col("mean")).otherwise(change)).drop("mean")
    else:
        rows = rows.join(after.select("part", F.col("mean").alias("m")), "part")
    rows = rows.withColumn("m", _zip(F.col("m"), F.col("p"), lambda a, b: a + b))
    if precondition:
        rows = rows.join(small(preconditioner(after)), "part").withColumn("m", _zip(F.col("m"), F.col("scale"), lambda a, s: a * s * s))
    return rows.select("part", _zip(F.col("x"), F.col("m"), lambda a, b: a - rate * b).alias("x"))
