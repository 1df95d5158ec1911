"""Queries over the relational tables: statistics, sequences, joins, state, sampling."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from stackwright.functions import geometry, kernels, text
from stackwright.operators import distances, likelihood, pairs, probability, quadrature, robust, sampler_state, sequence
from stackwright.plans import monitor
from stackwright.plans.registry import query, table

PI = 3.141592653589793


@query("select l_returnflag, median(l_quantity) as mean, round(1.4826*mad(l_quantity), 6) as std from lineitem group by 1")
def robust_stats(spark, d):
    return robust.mean_std(table(spark, d, "lineitem"), "l_quantity", ["l_returnflag"]).select("l_returnflag", "mean", F.round("std", 6).alias("std"))


@query("select l_returnflag, round(avg(l_extendedprice), 2) as mean, round(stddev_pop(l_extendedprice), 2) as std from lineitem group by 1")
def mle_stats(spark, d):
    out = robust.mean_std(table(spark, d, "lineitem"), "l_extendedprice", ["l_returnflag"], "mle")
    return out.select("l_returnflag", F.round("mean", 2).alias("mean"), F.round("std", 2).alias("std"))


@query("select i as percent, round(q[i + 1], 4) as quantile from (select quantile_cont(l_extendedprice, [x/100.0 for x in range(101)]) as q from lineitem), (select unnest(range(101)) as i)")
def quantiles_101(spark, d):
    return robust.quantiles(table(spark, d, "lineitem"), "l_extendedprice").withColumn("quantile", F.round("quantile", 4))


DC = "with m as (select l_orderkey, avg(l_quantity)*sqrt(8.0)/(1 + s_nationkey % 3) as dc from lineitem join supplier on l_suppkey = s_suppkey group by l_orderkey, s_nationkey % 3), a as (select median(dc) as mean from m), b as (select mean, 1.4826*median(abs(dc - mean)) as std, count(*) as n from m, a group by mean)"


def _dc(spark, d):
    joined = pairs.look_up(table(spark, d, "lineitem"), table(spark, d, "supplier").withColumnRenamed("s_suppkey", "l_suppkey"), "l_suppkey")
    means = joined.groupBy("l_orderkey", (F.col("s_nationkey") % 3).alias("c")).agg(F.avg("l_quantity").alias("mean"))
    responses = spark.range(3).select(F.col("id").cast("int").alias("c"), (1 + F.col("id")).cast("double").alias("dc"))
    return robust.dc_estimate(robust.dc_observations(means, responses, "c", 8))


@query(f"{DC} select round(mean, 6) as mean, round(std, 6) as std, round(std/sqrt(n), 6) as error from b")
def dc_estimate(spark, d):
    return _dc(spark, d).select(*[F.round(c, 6).alias(c) for c in ("mean", "std", "error")])


@query(f"{DC} select case when mean > 2*std/sqrt(n) then 1 when mean < -2*std/sqrt(n) then -1 else 0 end as sign from b")
def data_sign(spark, d):
    return robust.data_sign(_dc(spark, d)).select("sign")


@query("select l_orderkey, l_linenumber, s_nationkey, s_name from lineitem join supplier on l_suppkey = s_suppkey")
def ctf_lookup(spark, d):
    return pairs.look_up(table(spark, d, "lineitem").withColumnRenamed("l_suppkey", "s_suppkey"), table(spark, d, "supplier"), "s_suppkey").select("l_orderkey", "l_linenumber", "s_nationkey", "s_name")


@query("select c_nationkey, list(c_custkey order by c_custkey) as items from customer group by 1")
def inverse_lookup(spark, d):
    return pairs.inverse(table(spark, d, "customer"), "c_nationkey", "c_custkey")


@query("select distinct c_custkey as k, 'left' as side from customer where c_custkey not in (select o_custkey from orders) union all select distinct o_custkey, 'right' from orders where o_custkey not in (select c_custkey from customer)")
def integrity_check(spark, d):
    return pairs.missing_keys(table(spark, d, "customer").select(F.col("c_custkey").alias("k")), table(spark, d, "orders").select(F.col("o_custkey").alias("k")), "k")


@query("select o_orderkey, sum(c) over (order by o_orderkey) - 1 as run_id from (select o_orderkey, case when lag(o_orderstatus) over (order by o_orderkey) is not distinct from o_orderstatus and row_number() over (order by o_orderkey) > 1 then 0 else 1 end as c from orders)")
def ctf_islands(spark, d):
    return sequence.runs(table(spark, d, "orders"), ["o_orderkey"], ["o_orderstatus"]).select("o_orderkey", "run_id")


@query("select user_id, event_id, round(avg(value) over (partition by user_id order by ts, event_id rows between 4 preceding and current row), 6) as smooth from events")
def moving_average(spark, d):
    return sequence.moving_average(table(spark, d, "events"), "value", 5, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", F.round("smooth", 6).alias("smooth"))


def _smooth_sql(kind: str, edge: str) -> str:
    before, after = {"reflect": ("2*f.v0 - (select value from r o where o.user_id = r.user_id and o.i = least(1 - r.i - k, r.n - 1))", "2*f.v1 - (select value from r o where o.user_id = r.user_id and o.i = greatest(2*r.n - 1 - r.i - k, 0))"), "extend": ("f.v0", "f.v1"), "zeros": ("0", "1")}[edge]
    weight = {"hanning": "0.5 - 0.5*cos(2*pi()/4*(k+2))", "hamming": "0.54 - 0.46*cos(2*pi()/4*(k+2))", "flat": "1"}[kind]
    return f"""with r as (select user_id, event_id, value, row_number() over w - 1 as i, count(*) over (partition by user_id) as n from events window w as (partition by user_id order by ts, event_id)),
     f as (select user_id, arg_min(value, i) as v0, arg_max(value, i) as v1 from r group by 1), k as (select unnest([-2,-1,0,1,2]) as k), w as (select k, ({weight})::double as w from k),
     t as (select r.user_id, event_id, w, case when r.i + k < 0 then {before} when r.i + k >= r.n then {after} else (select value from r o where o.user_id = r.user_id and o.i = r.i + k) end as v from r join f using (user_id), w)
     select user_id, event_id, round(sum(w*v)/sum(w), 5) as smooth from t group by all"""


@query(_smooth_sql("hanning", "reflect"))
def smooth_hanning(spark, d):
    return sequence.smooth(table(spark, d, "events"), "value", 5, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", F.round("smooth", 5).alias("smooth"))


@query(_smooth_sql("hamming", "extend"))
def smooth_extend(spark, d):
    return sequence.smooth(table(spark, d, "events"), "value", 5, ["user_id"], ["ts", "event_id"], "hamming", "extend").select("user_id", "event_id", F.round("smooth", 5).alias("smooth"))


@query(_smooth_sql("flat", "zeros"))
def smooth_flat(spark, d):
    return sequence.smooth(table(spark, d, "events"), "value", 5, ["user_id"], ["ts", "event_id"], "flat", "zeros").select("user_id", "event_id", F.round("smooth", 5).alias("smooth"))


@query("select user_id, event_id, round((event_id - lag(event_id) over w)/nullif(epoch(ts) - lag(epoch(ts)) over w, 0), 6) as rate from events window w as (partition by user_id order by ts, event_id)")
def throughput(spark, d):
    e = table(spark, d, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return sequence.throughput(e, "event_id", "t", ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", F.round("rate", 6).alias("rate"))


@query("select user_id, event_id, round((epoch(ts) - first_value(epoch(ts)) over (partition by user_id order by ts, event_id))/3600, 6) as hours from events")
def rebase_time(spark, d):
    e = table(spark, d, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return sequence.hours_since_start(e, "t", ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", F.round("hours", 6).alias("hours"))


PLACED = "p as (select o_orderkey, row_number() over (order by ((o_orderkey + 17)*2654435761) % 4294967296, o_orderkey) - 1 as place from orders)"


def _placed(spark, d):
    return sequence.numbered(table(spark, d, "orders").select("o_orderkey"), [sequence.shuffle_key(F.col("o_orderkey"), 17), F.col("o_orderkey")], "place")


@query(f"with {PLACED} select o_orderkey, place, case when place < 200 then 'test' else 'train' end as split from p")
def train_test_split(spark, d):
    return sequence.split_test(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 200, 17)


BATCHED = f"""{PLACED}, n as (select count(*) as n, greatest(1, count(*)//400) as b from orders), z as (select n, b, n//b as base, n % b as extra from n),
 k as (select o_orderkey, (case when place < (b - extra)*base then place//base else (b - extra) + (place - (b - extra)*base)//(base + 1) end)::int as batch_id from p, z)"""


@query(f"with {BATCHED} select o_orderkey, batch_id from k")
def batch_bounds(spark, d):
    rows = _placed(spark, d)
    return rows.select("o_orderkey", sequence.batch_of(F.col("place"), table(spark, d, "orders").count(), 400).alias("batch_id"))


@query(f"with {BATCHED}, s as (select batch_id, count(*) as size from k group by 1) select batch_id, size, round(sum(size) over (order by batch_id)/sum(size) over (), 6) as epoch from s")
def epoch_fraction(spark, d):
    return sequence.epoch_fraction(batch_bounds(spark, d).groupBy("batch_id").agg(F.count(F.lit(1)).alias("size")), "size", "batch_id").withColumn("epoch", F.round("epoch", 6))


@query("select o_orderpriority, round(max(v) + ln(sum(exp(v - m))), 6) as lse from (select o_orderpriority, o_totalprice/1000 as v, max(o_totalprice/1000) over (partition by o_orderpriority) as m from orders) group by o_orderpriority")
def logsumexp(spark, d):
    return probability.log_sum_exp(table(spark, d, "orders").withColumn("v", F.col("o_totalprice") / 1000), "v", ["o_orderpriority"]).withColumn("lse", F.round("lse", 6))


@query("select o_orderpriority, round(max(v) + ln(sum(w*exp(v - m))), 6) as lse from (select o_orderpriority, o_totalprice/1000 as v, 1.0 + o_orderkey % 3 as w, max(o_totalprice/1000) over (partition by o_orderpriority) as m from orders) group by o_orderpriority")
def logsumexp_weighted(spark, d):
    rows = table(spark, d, "orders").withColumns({"v": F.col("o_totalprice") / 1000, "w": 1.0 + F.col("o_orderkey") % 3})
    return probability.log_sum_exp(rows, "v", ["o_orderpriority"], "w").withColumn("lse", F.round("lse", 6))


@query("select c_custkey, round(ln(exp(c_acctbal/1000) + exp(c_nationkey::double)), 6) as v from customer")
def logaddexp(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.round(probability.log_add_exp(F.col("c_acctbal") / 1000, F.col("c_nationkey").cast("double")), 6).alias("v"))


SCORES = "s as (select user_id, event_type, sum(value)/100 as v from events group by all), q as (select user_id, event_type, exp(v - max(v) over (partition by user_id)) as e from s), p as (select user_id, event_type, e/sum(e) over (partition by user_id) as p from q)"


def _posterior(spark, d):
    s = table(spark, d, "events").groupBy("user_id", "event_type").agg((F.sum("value") / 100).alias("v"))
    return probability.posterior(s, "v", ["user_id"])


@query(f"with {SCORES} select user_id, event_type, round(p, 6) as p from p")
def posterior(spark, d):
    return _posterior(spark, d).select("user_id", "event_type", F.round("p", 6).alias("p"))


@query(f"with {SCORES} select event_type, round(sum(p), 4) as p from p group by 1")
def posterior_marginal(spark, d):
    return probability.marginal(_posterior(spark, d), "p", ["event_type"]).withColumn("p", F.round("p", 4))


@query(f"with {SCORES} select user_id, round(1/sum(p*p), 5) as ess from p group by 1")
def effective_sample_size(spark, d):
    return probability.effective_size(_posterior(spark, d), "p", ["user_id"]).withColumn("ess", F.round("ess", 5))


@query(f"""with {SCORES}, g as (select event_type, sum(p)/sum(sum(p)) over () as g from p group by 1), m as (select p.user_id, p.event_type, 0.9*p + 0.1*0.8/n.n + 0.1*0.2*g as m from p join g using (event_type) join (select user_id, count(*) as n from p group by 1) n using (user_id)) select user_id, event_type, round(m, 6) as m from m""")
def mixed_distribution(spark, d):
    p = _posterior(spark, d)
    overall = p.groupBy("event_type").agg(F.sum("p").alias("g"))
    overall = overall.crossJoin(F.broadcast(overall.agg(F.sum("g").alias("t")))).select("event_type", (F.col("g") / F.col("t")).alias("g"))
    rows = pairs.look_up(p, overall, "event_type").join(p.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")), "user_id")
    return rows.select("user_id", "event_type", F.round(probability.mixed(F.col("p"), F.col("g"), F.col("n"), 0.1, 0.2), 6).alias("m"))


@query(f"with {SCORES}, e as (select user_id, 1/sum(p*p) as ess, count(*) as n from p group by 1) select user_id, least(ceil(1.5*round(ess, 6)), n)::bigint as samples, least(round(ess, 6), least(ceil(1.5*round(ess, 6)), n))/n < 0.95 as worth from e")
def sample_plan(spark, d):
    p = _posterior(spark, d)
    e = p.groupBy("user_id").agg(F.round(1 / F.sum(F.col("p") * F.col("p")), 6).alias("ess"), F.count(F.lit(1)).alias("n"))
    k = probability.sample_size(F.col("ess"), F.col("n"), 1.5)
    return e.select("user_id", k.cast("long").alias("samples"), probability.worth_sampling(F.col("ess"), k, F.col("n")).alias("worth"))


@query(f"with {SCORES} select user_id, event_type, floor(50*round(p, 9))::bigint as sure, round(50*round(p, 9) - floor(50*round(p, 9)), 5) as rest from p")
def residual_floor(spark, d):
    sure, rest = probability.residual_counts(F.lit(50), F.round("p", 9))
    return _posterior(spark, d).select("user_id", "event_type", sure.cast("long").alias("sure"), F.round(rest, 5).alias("rest"))


START = "('0x' || substr(md5('5:' || user_id), 1, 8))::ubigint/4294967296.0"


@query(f"""with {SCORES}, c as (select user_id, event_type, p, sum(p) over (partition by user_id order by event_type) as hi, sum(p) over (partition by user_id) as t, {START} as u from p),
 k as (select *, (ceil(round(hi/t*20, 9) - u) - ceil(round((hi - p)/t*20, 9) - u))::bigint as count from c)
 select user_id, event_type, count, round(count/(p/t*20), 6) as weight from k where count > 0""")
def importance_sample(spark, d):
    return probability.draw(_posterior(spark, d).withColumn("n", F.lit(20)), ["user_id"], "event_type", "p", "n", seed=5).withColumn("weight", F.round("weight", 6))


@query(f"""with {SCORES}, c as (select user_id, event_type, p/sum(p) over (partition by user_id) as share, {START} as u from p),
 f as (select *, floor(round(20*share, 9))::bigint as sure, round(20*share, 9) - floor(round(20*share, 9)) as rest from c),
 h as (select *, sum(rest) over (partition by user_id order by event_type) as hi from f),
 k as (select *, (sure + ceil(round(hi, 9) - u) - ceil(round(hi - rest, 9) - u))::bigint as count from h)
 select user_id, event_type, count, round(count/(share*20), 6) as weight from k where count > 0""")
def residual_sample(spark, d):
    return probability.draw(_posterior(spark, d).withColumn("n", F.lit(20)), ["user_id"], "event_type", "p", "n", seed=5, residual=True).withColumn("weight", F.round("weight", 6))


@query("with l as (select user_id, arg_max(value, (ts, event_id)) as v from events group by 1) select count(*) as weight, round(sum(v), 4) as total, round(avg(v), 6) as mean from l")
def running_sum_latest(spark, d):
    out = pairs.running_mean(table(spark, d, "events"), "user_id", "value", F.struct("ts", "event_id"))
    return out.select(F.col("weight").cast("long").alias("weight"), F.round("total", 4).alias("total"), F.round("mean", 6).alias("mean"))


@query("select user_id, round(sum(value*power(0.9, r)), 5) as total, round(sum(power(0.9, r)), 6) as weight from (select user_id, value, row_number() over (partition by user_id order by ts desc, event_id desc) - 1 as r from events) group by 1")
def running_sum_decay(spark, d):
    out = pairs.decayed_sum(table(spark, d, "events"), "user_id", "value", ["ts", "event_id"], 0.9)
    return out.select("user_id", F.round("total", 5).alias("total"), F.round("weight", 6).alias("weight"))


@query("with s as (select c_custkey as id, c_acctbal as v, 0 as stack from customer union all select s_suppkey + (select count(*) from customer), s_acctbal, 1 from supplier) select id, v, stack from s")
def stack_union(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("v"))
    return pairs.stacked([a, b], "id")


@query("select c_name as name, c_nationkey as nationkey from customer union all select s_name, s_nationkey from supplier")
def union_common(spark, d):
    a = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nationkey"), "c_mktsegment")
    b = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nationkey"), "s_acctbal")
    return pairs.common_union([a, b])


@query("select c_name as name, c_mktsegment as segment, null::double as acctbal from customer union all select s_name, null, s_acctbal from supplier")
def union_missing(spark, d):
    a = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("acctbal"))
    return a.unionByName(b, allowMissingColumns=True)


@query("with r as (select o_orderkey as k, o_orderkey*3 as start, o_orderkey*3 + 2 as \"end\" from orders) select l_orderkey, l_linenumber, k from lineitem join r on l_partkey >= start and l_partkey < \"end\"")
def interval_lookup(spark, d):
    ranges = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") * 3).alias("start"), (F.col("o_orderkey") * 3 + 2).alias("end"))
    return pairs.interval_look_up(table(spark, d, "lineitem"), "l_partkey", ranges, "start", 64).select("l_orderkey", "l_linenumber", "k")


@query("select l_orderkey as row, round(sum(l_quantity*p_retailprice), 2) as y from lineitem join part on l_partkey = p_partkey group by 1")
def sparse_matvec(spark, d):
    from stackwright.operators import linear

    m = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("row"), F.col("l_partkey").alias("col"), F.col("l_quantity").alias("val"))
    x = table(spark, d, "part").select(F.col("p_partkey").alias("at"), F.col("p_retailprice").alias("x"))
    return linear.matvec(m, x).select("row", F.round("x", 2).alias("y"))


@query("select l_partkey as col, round(sum(l_quantity*o_totalprice), 2) as re, round(sum(l_quantity*o_custkey), 2) as im from lineitem join orders on l_orderkey = o_orderkey group by 1")
def sparse_matvec_transposed(spark, d):
    from stackwright.operators import linear

    m = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("row"), F.col("l_partkey").alias("col"), F.col("l_quantity").alias("val"))
    x = table(spark, d, "orders").select(F.col("o_orderkey").alias("at"), F.col("o_totalprice").alias("re"), F.col("o_custkey").alias("im"))
    out = linear.matvec(m, x, transposed=True, values=("re", "im"))
    return out.select("col", F.round("re", 2).alias("re"), F.round("im", 2).alias("im"))


UNIT = "u as (select vec_id as id, embedding[1]/n as p0, embedding[2]/n as p1, embedding[3]/n as p2 from (select *, sqrt(embedding[1]::double*embedding[1] + embedding[2]::double*embedding[2] + embedding[3]::double*embedding[3]) as n from embeddings))"


def _unit(spark, d):
    e = [F.col("embedding")[i].cast("double") for i in range(3)]
    n = F.sqrt(e[0] * e[0] + e[1] * e[1] + e[2] * e[2])
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), *[(x / n).alias(f"p{i}") for i, x in enumerate(e)])


@query(f"with {UNIT}, k as (select a.id, sum(exp(8*(a.p0*b.p0 + a.p1*b.p1 + a.p2*b.p2 - 1))) as s from u a, u b group by 1) select id, round(s/sum(s) over (), 7) as p from k")
def fisher_kde(spark, d):
    u = _unit(spark, d)
    return pairs.fisher_density(u, u.withColumn("w", F.lit(1.0)), 8.0).withColumn("p", F.round("p", 7))


@query(f"with {UNIT}, s as (select * from u), n as (select a.id, sqrt(min(case when a.id <> b.id then power(a.p0 - b.p0, 2) + power(a.p1 - b.p1, 2) end)) as h from s a, s b group by 1), e as (select u.id, -(power(u.p0 - t.p0, 2) + power(u.p1 - t.p1, 2))/(2*power(5*t.h, 2)) as e from u, (select s.*, h from s join n using (id)) t), l as (select id, max(e) + ln(sum(exp(e - m))) as l from (select *, max(e) over (partition by id) as m from e) group by 1) select id, round(l - (select max(l) + ln(sum(exp(l - (select max(l) from l)))) from l), 4) as logp from l")
def gaussian_kde(spark, d):
    u = _unit(spark, d).select("id", "p0", "p1")
    return pairs.gaussian_density(u, u.withColumn("w", F.lit(1.0)), 2, 5.0).withColumn("logp", F.round("logp", 4))


@query(f"with {UNIT} select a.id, b.id as id2, round(power(a.p0 - b.p0, 2) + power(a.p1 - b.p1, 2) + power(a.p2 - b.p2, 2), 6) as d2 from u a, u b where power(a.p0 - b.p0, 2) + power(a.p1 - b.p1, 2) + power(a.p2 - b.p2, 2) <= 0.01")
def pair_radius_join(spark, d):
    u = _unit(spark, d)
    return pairs.near_pairs(u, u, 3, 0.1).select("id", "id2", F.round("d2", 6).alias("d2"))


@query(f"with {UNIT}, s as (select * from u) select a.id, round(sqrt(min(power(a.p0 - b.p0, 2) + power(a.p1 - b.p1, 2))), 6) as spacing from s a join s b on a.id <> b.id group by 1")
def nearest_spacing(spark, d):
    return pairs.nearest_spacing(_unit(spark, d), 2, 1.0).withColumn("spacing", F.round("spacing", 6))


@query(f"with {UNIT} select a.id, b.id as id2, round(power(a.p0 - b.p0, 2) + power(a.p1 - b.p1, 2), 6) as d2 from u a, u b")
def squared_distances(spark, d):
    u = _unit(spark, d)
    return distances.rounded_distances(u, u, 2, 6)


SPIRAL = "h as (select i, -1 + i*2.0::double/199 as h from (select unnest(range(200)) as i)), t as (select i, h, sum(case when i between 1 and 198 then 3.6/sqrt(200)/sqrt(1 - h*h) else 0 end) over (order by i) as t from h), s as (select i, cos(case when i between 1 and 198 then t else 0 end)*sqrt(greatest(1 - h*h, 0)) as x, sin(case when i between 1 and 198 then t else 0 end)*sqrt(greatest(1 - h*h, 0)) as y, h as z, 4*pi()/200 as weight from t)"


@query(f"with {SPIRAL} select vec_id, i, round(x, 6) as x, round(y, 6) as y, round(z, 6) as z, round(weight, 6) as weight from embeddings join s on vec_id % 200 = i")
def spiral_points(spark, d):
    """The direction of a spiral that each image is given."""
    images = table(spark, d, "embeddings").select("vec_id", (F.col("vec_id") % 200).cast("int").alias("i"))
    return pairs.look_up(images, quadrature.spiral_sphere(spark, 200), "i").select("vec_id", "i", *[F.round(c, 6).alias(c) for c in ("x", "y", "z", "weight")])


DIRECTION = "select vec_id as i, e[1]::double/r as x, e[2]::double/r as y, e[3]::double/r as z, 1.0 + label as weight from (select vec_id, label, embedding as e, sqrt(embedding[1]::double**2 + embedding[2]::double**2 + embedding[3]::double**2) as r from embeddings)"


def directions(spark, d):
    """(i, x, y, z, weight): a direction of each image."""
    e = [F.col("embedding")[k].cast("double") for k in range(3)]
    length = F.sqrt(e[0] * e[0] + e[1] * e[1] + e[2] * e[2])
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("i"), *[(v / length).alias(n) for v, n in zip(e, "xyz", strict=True)], (1.0 + F.col("label")).alias("weight"))


@query(f"with s as ({DIRECTION}), a as (select * from s where atan2(y, x) >= -pi()/3 + 1e-8 and atan2(y, x) <= pi()/3 + 1e-8 and acos(greatest(-1, least(1, z/sqrt(x*x + y*y + z*z)))) <= pi()/2 + 1e-8) select i, round(weight*(select sum(weight) from s)/sum(weight) over (), 6) as weight from a")
def asymmetric_unit(spark, d):
    """The images whose direction lies in one unit of D3, with weights that stand for all."""
    return quadrature.asymmetric_points(directions(spark, d), "d3").select("i", F.round("weight", 6).alias("weight"))


ICOSPHERE = ", ".join(f"({i}, {x!r}::double, {y!r}::double, {z!r}::double)" for i, (x, y, z) in enumerate(quadrature.icosphere(2).tolist()))


@query(f"with p(i, px, py, pz) as (values {ICOSPHERE}), s as ({DIRECTION}), m as (select s.i as vec_id, p.i, x*px + y*py + z*pz as cosine from s, p) select vec_id, arg_max(i, cosine)::int as i, round(max(cosine), 6) as cosine, round(4*pi()/162, 6) as weight from m group by 1")
def icosphere_points(spark, d):
    """The nearest vertex of an icosphere to each image's direction."""
    vertices = quadrature.icosphere_points(spark, 2).select(F.col("i"), *[F.col(c).alias(f"p{c}") for c in "xyz"], F.col("weight").alias("w"))
    both = directions(spark, d).select(F.col("i").alias("vec_id"), "x", "y", "z").crossJoin(F.broadcast(vertices))  # 162 vertices
    best = both.groupBy("vec_id").agg(F.max(F.struct((F.col("x") * F.col("px") + F.col("y") * F.col("py") + F.col("z") * F.col("pz")).alias("cosine"), "i", "w")).alias("b"))
    return best.select("vec_id", "b.i", F.round("b.cosine", 6).alias("cosine"), F.round("b.w", 6).alias("weight"))


def _grid_sql(nodes, weights, extent):
    rows = ", ".join(f"({s!r}::double, {w!r}::double)" for s, w in zip(nodes, weights, strict=True))
    return f"with l(s, w) as (values {rows}), b as (select a.s as sx, c.s as sy, a.w*c.w as w from l a, l c where a.s*a.s + c.s*c.s < {extent * extent!r}), g as (select sx, sy, w/sum(w) over () as w from b) select p_partkey, round(sum(w*cos(2*pi()*(sx*p_size/100.0::double + sy*0.03))), 6) as blur from part, g group by 1"


def _blur(spark, d, grid_points):
    """The mean phase of each part's frequency over the shifts of a grid, whose points are a property of the domain."""
    phase = F.cos(2 * PI * (F.col("sx") * F.col("p_size") / 100.0 + F.col("sy") * 0.03))
    return table(spark, d, "part").crossJoin(F.broadcast(grid_points)).groupBy("p_partkey").agg(F.round(F.sum(F.col("weight") * phase), 6).alias("blur"))


HERMITE, LEGENDRE = quadrature.shift_nodes("hermite", 7, 3.0, 9.0), quadrature.shift_nodes("legendre", 7, 3.0, 9.0)


@query(_grid_sql(*HERMITE, 9.0))
def shift_grid_hermite(spark, d):
    return _blur(spark, d, quadrature.shift_grid(spark, *HERMITE, 9.0))


@query(_grid_sql(*LEGENDRE, 9.0))
def shift_grid_legendre(spark, d):
    return _blur(spark, d, quadrature.shift_grid(spark, *LEGENDRE, 9.0))


@query("select p_partkey, i, round((i + 0.5)*2*pi()/32, 6) as theta, round(2*pi()/32, 6) as weight from (select p_partkey, floor((p_retailprice - 2*pi()*floor(p_retailprice/(2*pi())))/(2*pi()/32))::int as i from part)")
def inplane_grid(spark, d):
    """The angle of the grid nearest to each part's."""
    turn = F.col("p_retailprice") - 2 * PI * F.floor(F.col("p_retailprice") / (2 * PI))
    parts = table(spark, d, "part").select("p_partkey", F.floor(turn / (2 * PI / 32)).cast("int").alias("i"))
    return pairs.look_up(parts, quadrature.circle_grid(spark, 0.2), "i").select("p_partkey", "i", F.round("theta", 6).alias("theta"), F.round("weight", 6).alias("weight"))


@query("select c_custkey, round(cos(a)*cos(b)*cos(g) - sin(a)*sin(g), 6) as r00, round(-cos(a)*cos(b)*sin(g) - sin(a)*cos(g), 6) as r01, round(cos(a)*sin(b), 6) as r02, round(sin(a)*sin(b), 6) as r12, round(-sin(b)*cos(g), 6) as r20, round(sin(b)*sin(g), 6) as r21, round(cos(b), 6) as r22 from (select c_custkey, c_custkey*0.1::double as a, c_nationkey*0.07::double as b, c_acctbal/1000 as g from customer)")
def euler_rotation(spark, d):
    m = geometry.from_euler(F.col("c_custkey") * 0.1, F.col("c_nationkey") * 0.07, F.col("c_acctbal") / 1000)
    return table(spark, d, "customer").select("c_custkey", *[F.round(m[i][j], 6).alias(f"r{i}{j}") for i, j in ((0, 0), (0, 1), (0, 2), (1, 2), (2, 0), (2, 1), (2, 2))])


@query(f"with {UNIT} select id, round(p0, 6) as r02, round(1 - p0*p0/(1 + p2), 6) as r00, round(-p0*p1/(1 + p2), 6) as r01, round(atan2(p1, p0), 6) as phi, round(atan2(sqrt(p0*p0 + p1*p1), p2), 6) as theta from u")
def direction_rotation(spark, d):
    u = _unit(spark, d)
    m = geometry.from_direction(F.col("p0"), F.col("p1"), F.col("p2"))
    e = geometry.to_euler(F.col("p0"), F.col("p1"), F.col("p2"))
    return u.select("id", F.round(m[0][2], 6).alias("r02"), F.round(m[0][0], 6).alias("r00"), F.round(m[0][1], 6).alias("r01"), F.round(e[0], 6).alias("phi"), F.round(e[1], 6).alias("theta"))


@query(f"with {UNIT} select id, 1.0::double as trace_ok, round(p0, 6) as x, round(p1, 6) as y, round(p2, 6) as z from u")
def quaternion_round_trip(spark, d):
    """A matrix from (1, p) gives back a quaternion whose vector part over its scalar part is p."""
    m = geometry.from_quaternion(F.lit(1.0), F.col("p0"), F.col("p1"), F.col("p2"))
    q = geometry.to_quaternion(m)
    return _unit(spark, d).select("id", F.round(q[0] * q[0] * 2, 6).alias("trace_ok"), *[F.round(q[k + 1] / q[0], 6).alias(a) for k, a in enumerate("xyz")])


@query("select p_partkey, round(greatest(1 - abs(t), 0), 6) as linear, round(case when abs(t) <= 0.5 then 1 - 2*t*t when abs(t) < 1 then 2*power(1 - abs(t), 2) else 0 end, 6) as quad, round(case when abs(t) >= 2 then 0 when abs(t) < 1e-9 then 1 else sin(pi()*t)/(pi()*t)*sin(pi()*t/2)/(pi()*t/2) end, 6) as lanczos4, round(case when abs(t) >= 3 then 0 when abs(t) < 1e-9 then 1 else sin(pi()*t)/(pi()*t) end, 6) as sinc6 from (select p_partkey, (p_partkey % 61)/10.0::double - 3.05 as t from part)")
def interpolation_kernels(spark, d):
    t = (F.col("p_partkey") % 61) / 10.0 - 3.05
    return table(spark, d, "part").select("p_partkey", F.round(kernels.linear(t), 6).alias("linear"), F.round(kernels.quadratic(t), 6).alias("quad"), F.round(kernels.lanczos(t, 4), 6).alias("lanczos4"), F.round(kernels.sinc(t, 6), 6).alias("sinc6"))


@query("select s_suppkey, round((lon*0.6366197723675814 + 2*cos(lat)*sin(lon/2)/(sin(a)/a))/2, 6) as x, round((lat + sin(lat)/(sin(a)/a))/2, 6) as y from (select *, acos(cos(lat)*cos(lon/2)) as a from (select s_suppkey, (s_suppkey % 7 - 3)*0.4::double + 0.05 as lon, (s_suppkey % 5 - 2)*0.3::double as lat from supplier))")
def map_projection(spark, d):
    x, y = geometry.winkel_tripel((F.col("s_suppkey") % 7 - 3) * 0.4 + 0.05, (F.col("s_suppkey") % 5 - 2) * 0.3)
    return table(spark, d, "supplier").select("s_suppkey", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query("select p_partkey, round(case when m > 0 then p_size/p_retailprice else 1 end, 6) as envelope, round(m*2.5 + (1 - m)*p_size, 6) as noise, round((2.5*m*40 + 5*4.0)/(m*40 + 5), 6) as noise_prior, round(least(greatest(case when p_size < 6 then 1 else (p_size*m*40/2.5 + exp(-p_size/8.0)*3)/(p_retailprice*m*40/2.5 + 3) end, 0.02), 0.9), 6) as envelope_prior from (select *, (p_size % 4)/4.0::double as m from part)")
def noise_and_envelope(spark, d):
    rows = table(spark, d, "part").select("p_partkey", ((F.col("p_size") % 4) / 4.0).alias("mask"), F.col("p_size").cast("double").alias("corr"), F.col("p_retailprice").alias("power"), F.lit(2.5).alias("sigma2"))
    out = likelihood.noise_mle(likelihood.envelope_mle(rows), F.col("corr"))
    out = likelihood.noise_map(out.withColumnsRenamed({"noise": "mle", "envelope": "env_mle"}), 5.0, 4.0, 40.0).withColumnRenamed("noise", "noise_prior")
    out = likelihood.envelope_map(out.withColumn("noise", F.col("sigma2")), 3.0, 40.0, F.exp(-F.col("corr") / 8), 0.02, 0.9, F.col("corr") < 6).withColumnRenamed("envelope", "envelope_prior")
    return out.select("p_partkey", F.round("env_mle", 6).alias("envelope"), F.round("mle", 6).alias("noise"), *[F.round(c, 6).alias(c) for c in ("noise_prior", "envelope_prior")])


PROJ = [(r, i, s, c, round(math.sin(1 + r + 2 * i + 3 * s + c), 6), round(math.cos(r * i + s + c), 6), round(-math.log(24) + 0.01 * s, 9)) for r in range(2) for i in range(4) for s in range(3) for c in range(32)]


def _projections(spark):
    return spark.createDataFrame(PROJ, "r int, i int, s int, c int, re double, im double, logw double")


RIS = f"""with p0(r, i, s, c, re, im, logw) as (values {', '.join(map(str, PROJ))}), p as (select r, i, s, c, re::double as re, im::double as im, logw::double as logw from p0),
 d as (select vec_id, k as c, embedding[k + 1]::double as re, embedding[k + 33]::double as im from embeddings, (select unnest(range(32)) as k)),
 e as (select vec_id, r, i, s, first(logw) - sum(power(d.re - p.re, 2) + power(d.im - p.im, 2))/(2*1.5) as e from d join p using (c) group by all)"""


@query(f"{RIS} select vec_id, round(-(max(e) + ln(sum(exp(e - m)))), 5) as nll from (select *, max(e) over (partition by vec_id) as m from e) group by 1")
def marginal_likelihood(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode(F.slice("embedding", 1, 32)).alias("c", "re"), "embedding")
    e = e.select("vec_id", "c", F.col("re").cast("double").alias("re"), F.col("embedding")[F.col("c") + 32].cast("double").alias("im"))
    return likelihood.marginal_sql(e, _projections(spark), "vec_id", 1.5).withColumn("nll", F.round("nll", 5))


@query(f"{RIS}, q as (select vec_id, r, exp(e - m)/sum(exp(e - m)) over (partition by vec_id) as p from (select *, max(e) over (partition by vec_id) as m from e)), z as (select vec_id, r, sum(p) as p from q group by all), n as (select vec_id, round(-(max(e) + ln(sum(exp(e - m)))), 5) as nll from (select *, max(e) over (partition by vec_id) as m from e) group by 1) select vec_id, nll, round(1/sum(p*p), 5) as ess_r from z join n using (vec_id) group by all")
def marginal_likelihood_arrow(spark, d):
    import numpy as np

    images = table(spark, d, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 32), lambda x: x.cast("double")).alias("re"), F.transform(F.slice("embedding", 33, 32), lambda x: x.cast("double")).alias("im"))
    p = np.array([complex(*x[4:6]) for x in PROJ]).reshape(2, 4, 3, 32)
    logw = np.array([x[6] for x in PROJ]).reshape(2, 4, 3, 32)[..., 0]
    out = likelihood.marginal_arrow(images, "vec_id", p, logw, 1.5)
    return out.select("vec_id", F.round("nll", 5).alias("nll"), F.round("ess_r", 5).alias("ess_r"))


@query("select vec_id, count(*) as n, round(sum(power(re, 2) + power(im, 2)), 6) as power from (select vec_id, k, embedding[k + 1]::double as re, embedding[k + 33]::double as im from embeddings, (select unnest(range(32)) as k)) where k >= 20 group by 1")
def outside_power(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode(F.slice("embedding", 1, 32)).alias("k", "re"), "embedding")
    e = e.select("vec_id", "k", F.col("re").cast("double").alias("re"), F.col("embedding")[F.col("k") + 32].cast("double").alias("im"))
    return likelihood.outside_power(e, "vec_id", F.col("k") < 20).withColumn("power", F.round("power", 6))


@query("select c_nationkey as k, arg_max(c_name, c_custkey) as v from customer group by 1")
def parameter_overlay(spark, d):
    """Settings laid over each other: of each key the value of the highest level."""
    rows = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_name").alias("v"), F.col("c_custkey").alias("level"))
    return pairs.latest(rows, "k", "v", F.col("level"))


@query("select count(*) filter (event_type = 'click')*100 as n from events")
def dataset_size(spark, d):
    return monitor.dataset_size(table(spark, d, "events").withColumn("epoch", F.when(F.col("event_type") == "click", 0).otherwise(1)), 100)


@query("select event_id, case when s >= 86400 then lpad((s//86400)::varchar, 2, '0') || ':' else '' end || lpad((s//3600 % 24)::varchar, 2, '0') || ':' || lpad((s//60 % 60)::varchar, 2, '0') || ':' || lpad((s % 60)::varchar, 2, '0') || 's' as elapsed from (select event_id, event_id*977 as s from events)")
def elapsed_format(spark, d):
    return table(spark, d, "events").select("event_id", text.elapsed(F.col("event_id") * 977).alias("elapsed"))


@query("select s_suppkey, 'c' as class, (s_suppkey % 9 + 1)::int as n from supplier where s_suppkey % 2 = 0 union all select s_suppkey, 'd', (s_suppkey % 9 + 1)::int from supplier where s_suppkey % 2 = 1")
def symmetry_parse(spark, d):
    name = F.concat(F.when(F.col("s_suppkey") % 2 == 0, "c").otherwise(" D"), (F.col("s_suppkey") % 9 + 1).cast("string"))
    letter, order = quadrature.symmetry_columns(name)
    return table(spark, d, "supplier").select("s_suppkey", letter.alias("class"), order.alias("n"))


@query("select event_type, user_id % 3 as prefix, round(avg(value), 6) as mean from events group by all")
def timing_unpivot(spark, d):
    wide = table(spark, d, "events").withColumn("m", F.concat(F.lit("mean_"), F.col("user_id") % 3)).groupBy("event_type").pivot("m", ["mean_0", "mean_1", "mean_2"]).agg(F.avg("value"))
    long = monitor.by_prefix(wide, "mean_", ["event_type"]).where("value is not null")
    return long.select("event_type", F.substring("name", 6, 9).cast("long").alias("prefix"), F.round("value", 6).alias("mean"))


UPDATE = "select image, point, v/sum(v) over (partition by image) as p from (select user_id as image, event_id % 8 as point, sqrt(sum(abs(value) + 1)) as v from events where event_type = 'click' group by all)"
KEPT = "select image, point, n/sum(n) over (partition by image) as p from (select user_id as image, event_id % 8 as point, count(*) as n from events group by all)"


def _sampler(spark, d):
    e = table(spark, d, "events").withColumns({"image": F.col("user_id"), "point": F.col("event_id") % 8})
    counts = e.groupBy("image", "point").agg(F.count(F.lit(1)).cast("double").alias("value")).withColumn("weight", F.lit(1.0))
    state = sampler_state.record_update(counts)
    fresh = e.where("event_type = 'click'").groupBy("image", "point").agg(F.sum(F.abs("value") + 1).alias("value")).withColumn("weight", F.lit(1.0))
    return sampler_state.commit(state, sampler_state.record_update(fresh, 2.0))


@query(f"with u as ({UPDATE}), k as ({KEPT}) select image, point, round(p, 6) as p from u union all select image, point, round(p, 6) from k where image not in (select image from u)")
def sampler_commit(spark, d):
    return _sampler(spark, d).withColumn("p", F.round("p", 6))


@query(f"with u as ({UPDATE}), k as ({KEPT}), s as (select * from u union all select * from k where image not in (select image from u)), m as (select point, coalesce(sum(p), 0) + 0.125::double as m from (select unnest(range(8)) as point) left join (select * from s where image not in (select user_id from events where value > 400)) using (point) group by 1) select point, round(m/sum(m) over (), 6) as p from m")
def sampler_global(spark, d):
    points = spark.range(8).withColumnRenamed("id", "point")
    tests = table(spark, d, "events").where("value > 400").select(F.col("user_id").alias("image")).distinct()
    return sampler_state.global_distribution(_sampler(spark, d), points, 1.0, tests).withColumn("p", F.round("p", 6))


@query(f"with u as ({UPDATE}), k as ({KEPT}), s as (select * from u union all select * from k where image not in (select image from u)) select image, (point//4)::bigint as slice, round(sum(p), 6) as p from s group by all")
def sampler_marginal(spark, d):
    return sampler_state.marginals(_sampler(spark, d), 4)[0].withColumn("p", F.round("p", 6))


@query("select vec_id, s.i*5 + t.i as point, s.i as slice, t.i as turn, round(4*pi()/12*2*pi()/5, 6) as weight from embeddings, (select unnest(range(12))::int as i) s, (select unnest(range(5))::int as i) t where vec_id % 60 = s.i*5 + t.i")
def product_domain(spark, d):
    """The pose of the product domain that each image is given."""
    domain = sampler_state.product_domain(quadrature.spiral_sphere(spark, 12), quadrature.circle_grid(spark, 1.5))
    images = table(spark, d, "embeddings").select("vec_id", (F.col("vec_id") % 60).cast("int").alias("point"))
    return pairs.look_up(images, domain, "point").select("vec_id", "point", "slice", "turn", F.round("weight", 6).alias("weight"))


#: Orientations of the images: four elements as a unit quaternion.
QUATERNION = "q as (select vec_id, 1.0 + label as w, list_transform(embedding[1:4], lambda e: e::double/sqrt(list_sum(list_transform(embedding[1:4], lambda f: f::double*f::double)))) as q from embeddings)"
NARROW = 200.0


def orientations(spark, d):
    e = [F.col("embedding")[k].cast("double") for k in range(4)]
    length = F.sqrt(sum((v * v for v in e[1:]), e[0] * e[0]))
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), *[(v / length).alias(f"p{k}") for k, v in enumerate(e)], (1.0 + F.col("label")).alias("w"))


def _bingham(images):
    """SQL: the density when the best of a sample's images counts."""
    best = "greatest(" + ", ".join(f"power({i}, 2)" for i in images) + ")" if len(images) > 1 else f"power({images[0]}, 2)"
    return f"with {QUATERNION}, c as (select a.vec_id, b.w, {best} as c from q a, q b), s as (select vec_id, greatest(coalesce(sum(w*exp({NARROW}*(c - 1))) filter (c >= 1 + ln(1e-14)/{NARROW}), 0), 1e-14) as s from c group by 1) select vec_id, round(s/sum(s) over (), 8) as p from s"


@query(_bingham(["list_sum(list_transform(list_zip(a.q, b.q), lambda x: x[1]*x[2]))"]))
def bingham_density(spark, d):
    points = orientations(spark, d)
    return pairs.bingham_density(points.drop("w"), points, NARROW).select(F.col("id").alias("vec_id"), F.round("p", 8).alias("p"))


@query(_bingham(["a.q[1]*b.q[1] + a.q[2]*b.q[2] + a.q[3]*b.q[3] + a.q[4]*b.q[4]", "-a.q[1]*b.q[4] - a.q[2]*b.q[3] + a.q[3]*b.q[2] + a.q[4]*b.q[1]", "a.q[1]*b.q[2] - a.q[2]*b.q[1] + a.q[3]*b.q[4] - a.q[4]*b.q[3]", "-a.q[1]*b.q[3] + a.q[2]*b.q[4] + a.q[3]*b.q[1] - a.q[4]*b.q[2]"]))
def bingham_density_symmetric(spark, d):
    """With a half turn about z and both hands: the nearest of four images of each sample counts."""
    points = orientations(spark, d)
    return pairs.bingham_density(points.drop("w"), points, NARROW, True, [(1, 0, 0, 0), (0, 0, 0, 1)]).select(F.col("id").alias("vec_id"), F.round("p", 8).alias("p"))


@query()
def asymmetric_set(spark, d):
    """The images whose directions are kept as the unit of D3, found by who meets whom."""
    return quadrature.asymmetric_set(directions(spark, d), "d3", 0.1)
