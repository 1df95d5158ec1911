"""Queries without a SQL form: transforms, file formats, iteration, streams."""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import functions as F

from stackwright.operators import fourier, linear, objectives
from stackwright.plans.registry import query, table
from stackwright.sources import mrc, results, star
from stackwright.staging import fresh_path
from stackwright.streaming import keyed_sum


def _packed(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda e: e.cast("double")).alias("px"))


@query("select vec_id, round(list_sum(list_transform(embedding, lambda e: e::double*e::double)), 4) as power, round(list_sum(list_transform(embedding, lambda e: e::double))/8, 5) as dc from embeddings")
def fourier_power(spark, d):
    """Parseval: the power of the coefficients is that of the pixels; the middle one is the scaled sum."""
    f = fourier.to_fourier(_packed(spark, d), "vec_id", "px", 8, 2)
    power = F.aggregate(F.zip_with("re", "im", lambda a, b: a * a + b * b), F.lit(0.0), lambda s, v: s + v)
    return f.select("vec_id", F.round(power, 4).alias("power"), F.round(F.col("re")[36], 5).alias("dc"))


@query("select vec_id, i as pixel, round(embedding[i + 1]::double, 5) as v from embeddings, (select unnest(range(64))::int as i)")
def fourier_round_trip(spark, d):
    f = fourier.to_fourier(_packed(spark, d), "vec_id", "px", 4, 3)
    return fourier.to_real(f, "vec_id", 4, 3).select("vec_id", F.posexplode("v").alias("pixel", "v")).withColumn("v", F.round("v", 5))


def _hermitian(spark, d):
    """The real parameter vector of each image's coefficients as a volume."""
    f = fourier.to_fourier(_packed(spark, d), "vec_id", "px", 4, 3)
    rows = f.select("vec_id", F.posexplode(F.arrays_zip("re", "im")).alias("at", "c")).select("vec_id", F.col("at").cast("long").alias("at"), "c.re", "c.im")
    return linear.pack_hermitian(rows, 3, 4, "vec_id")


@query("select vec_id, 64::bigint as n, round(list_sum(list_transform(embedding, lambda e: e::double*e::double)), 6) as norm from embeddings")
def hermitian_norm(spark, d):
    """As many real parameters as voxels, and as long as the volume."""
    return _hermitian(spark, d).groupBy("vec_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("value") * F.col("value")), 6).alias("norm"))


@query("select vec_id, i as pixel, round(embedding[i + 1]::double, 5) as v from embeddings, (select unnest(range(64))::int as i)")
def hermitian_round_trip(spark, d):
    f = linear.unpack_hermitian(_hermitian(spark, d), 3, 4, "vec_id")
    packed = f.groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("at", "re", "im"))).alias("c")).select("vec_id", F.col("c.re").alias("re"), F.col("c.im").alias("im"))
    return fourier.to_real(packed, "vec_id", 4, 3).select("vec_id", F.posexplode("v").alias("pixel", "v")).withColumn("v", F.round("v", 5))


def _coefficients(spark, d):
    f = fourier.to_fourier(_packed(spark, d), "vec_id", "px", 4, 3)
    return f.select("vec_id", F.explode(F.arrays_zip("re", "im")).alias("c")).select("vec_id", "c.re", "c.im")


@query("select vec_id, round((list_sum(list_transform(embedding, lambda e: e::double*e::double))/(2*0.3*0.3) + 64*(ln(0.3) + ln(2*pi())/2))/200, 6) as loss, round(sqrt(list_sum(list_transform(embedding, lambda e: e::double*e::double)))/(0.09*200), 6) as steep from embeddings")
def prior_gaussian_fourier(spark, d):
    """The Gaussian prior of a volume by its coefficients, and how steep it is."""
    c = _coefficients(spark, d)
    loss = objectives.gaussian_fourier(c, 0.3, 200.0, "vec_id")
    steep = objectives.gaussian_fourier_gradient(c, 0.3, 200.0).groupBy("vec_id").agg(F.sqrt(F.sum(F.col("g_re") ** 2 + F.col("g_im") ** 2)).alias("steep"))
    return loss.join(steep, "vec_id").select("vec_id", F.round("loss", 6).alias("loss"), F.round("steep", 6).alias("steep"))


@query("select vec_id, round(sqrt(list_avg(list_transform(embedding, lambda e: e::double*e::double))), 6) as sigma, round(1/list_avg(list_filter(list_transform(embedding, lambda e: e::double), lambda e: e > 0)), 6) as rate from embeddings")
def learned_widths(spark, d):
    cells = table(spark, d, "embeddings").select("vec_id", F.explode("embedding").alias("v")).withColumn("v", F.col("v").cast("double"))
    out = objectives.learned_widths(cells, "vec_id")
    return out.select("vec_id", F.round("sigma", 6).alias("sigma"), F.round("rate", 6).alias("rate"))


@query()
def padded_fourier(spark, d):
    m = fourier.premultiplier(12, lambda x: np.maximum(1 - np.abs(x), 0), 1)
    return fourier.to_fourier(_packed(spark, d), "vec_id", "px", 8, 2, pad=2, multiplier=m)


@query("select user_id, arg_max(value, (ts, event_id)) as value from events group by 1")
def running_sum_stream(spark, d):
    """The keyed state of a stream that has read the whole table, in micro-batches."""
    from stackwright.streaming.running_sum import latest_per_key

    source = table(spark, d, "events")
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "*").option("maxFilesPerTrigger", 1).parquet(f"{d}/events.parque[t]")
    where = fresh_path(spark, "running")

    def keep(batch, _):  # the whole state, written where executors are: nothing is held by the driver
        batch.write.mode("overwrite").parquet(f"{where}/state")

    q = latest_per_key(stream, "user_id", "value", ["ts", "event_id"]).writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{where}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{where}/state")


#: Phases of a run by thirds of the events, each with its number of keys; events of 40 keys; fading of weights.
PHASES, KEYS, FADE = (60, 50, 60), 40, 0.9995
PHASE_SQL = f"""with e as (select event_type as g, event_id as o, value as v, user_id % {KEYS} as k, least(3*event_id // (select count(*) from events), 2) as phase from events),
 r as (select *, [{', '.join(map(str, PHASES))}][phase + 1] as n, row_number() over (partition by g, phase order by o desc) - 1 as later from e),
 l as (select g, phase, n, k, arg_max(v, o) as v, power({FADE}::double, min(later)) as w from r group by all),
 s as (select g, phase, n, count(*) as keys, sum(w) as w, sum(w*v) as s, sum(w*v*v) as q from l group by all),
 t as (select g, phase, count(*) as t from e group by all),
 p as (select *, power({FADE}::double, t)*greatest(n - keys, 0)/n as h from s join t using (g, phase)),
 a as (select g, w, s/w as m, q/w as q from p where phase = 0),
 b as (select p.g, a.w*h + p.w as w, (a.w*h*m + s)/(a.w*h + p.w) as m, (a.w*h*a.q + p.q)/(a.w*h + p.w) as q from p join a using (g) where phase = 1),
 c as (select p.g, b.w*h + p.w as w, (b.w*h*m + s)/(b.w*h + p.w) as m, (b.w*h*b.q + p.q)/(b.w*h + p.w) as q from p join b using (g) where phase = 2)
 select g as event_type, (select count(*) from e where e.g = c.g) as updates, round(w, 6) as weight, round(m, 6) as mean, round(q, 5) as mean_square from c"""


def phased(events, n):
    """Events with the number of keys that their phase expects."""
    phase = F.least(F.floor(3 * F.col("event_id") / n), F.lit(2)).cast("int")
    return events.select("event_type", "event_id", "value", (F.col("user_id") % KEYS).alias("key"), F.get(F.array(*map(F.lit, PHASES)), phase).alias("n_keys"))


def _rounded(sums):
    return sums.select("event_type", "updates", F.round("weight", 6).alias("weight"), F.round("mean", 6).alias("mean"), F.round("mean_square", 5).alias("mean_square"))


@query(PHASE_SQL)
def running_sum_phases(spark, d):
    events = table(spark, d, "events")
    return _rounded(keyed_sum.running_sums(phased(events, events.count()), "event_type", "key", "value", "event_id", "n_keys", FADE))


@query(PHASE_SQL)
def running_sum_phases_stream(spark, d):
    """The same from a stream that has read the whole table, by the state of Spark's store."""
    events = table(spark, d, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{d}/events.parque[t]")
    where, name = fresh_path(spark, "sums"), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, keyed_sum.PROVIDER)
    try:
        sums = keyed_sum.keep_running_sums(phased(stream, events.count()), "event_type", "key", "value", "event_id", "n_keys", FADE)
        # each batch's rows of a group replace those before it: the latest number of updates counts
        q = sums.writeStream.outputMode("update").foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{where}/batch={i}")).option("checkpointLocation", f"{where}-log").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)
    return _rounded(keyed_sum.latest_rows(spark.read.parquet(where), "event_type"))


def _local(path):
    return path.removeprefix("file://")


@query("select vec_id as image_id, i as at, round(embedding[i + 1]::double, 5) as v from embeddings, (select unnest(range(64))::int as i)")
def mrc_round_trip(spark, d):
    """The images written to one MRC file by all tasks and read from it."""
    path = _local(fresh_path(spark, "stack")) + ".mrc"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    mrc.write_stack(table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), F.col("embedding").alias("px")).repartition(4, "image_id"), path)
    rows = spark.read.format("mrc").option("imagesPerPartition", "100").load(path).select("image_id", F.posexplode("px").alias("at", "v"))
    return rows.withColumn("v", F.round(F.col("v").cast("double"), 5))


@query("select p_partkey::double as p_partkey, round(p_retailprice, 4) as p_retailprice, replace(p_brand, '#', '_') as p_brand from part")
def star_round_trip(spark, d):
    """A table of particles' parameters written to STAR files in order and read from them."""
    path = fresh_path(spark, "star")
    rows = table(spark, d, "part").select("p_partkey", "p_retailprice", F.replace("p_brand", F.lit("#"), F.lit("_")).alias("p_brand"))
    star.write_star(rows, path, "particles", "p_partkey", 3)
    return star.read_star(spark, path).select("p_partkey", F.round("p_retailprice", 4).alias("p_retailprice"), "p_brand")


@query("select event_id, user_id, round(value, 4) as value from events")
def results_stream(spark, d):
    """Events that come in files one after the other: each look takes the files that are new, so every row comes once."""
    events, where = table(spark, d, "events").select("event_id", "user_id", "value"), fresh_path(spark, "results")
    results.register(spark)
    for turn in range(3):
        events.where(F.col("event_id") % 3 == turn).repartition(2).write.mode("append").json(f"{where}/in")
        stream = spark.readStream.format("results").option("pattern", "*.json").load(f"{where}/in")
        lines = stream.select(F.explode(F.filter(F.split(F.col("content").cast("string"), "\n"), lambda x: x != "")).alias("line"))
        q = lines.select(F.from_json("line", events.schema).alias("r")).select("r.*").writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/log").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(events.schema).parquet(f"{where}/out").withColumn("value", F.round("value", 4))
