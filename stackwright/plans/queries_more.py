"""Queries over minibatches, optics, sampling domains, projections and diagnostics, each with its SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from stackwright.functions import optics, text
from stackwright.operators import fourier, grid, likelihood, linear, pairs, quadrature, robust, sequence
from stackwright.plans import monitor
from stackwright.plans.queries_images import CELLS2, CELLS3, images, volumes
from stackwright.plans.queries_tables import BATCHED, PLACED, PROJ, RIS, UNIT, _placed, _projections, _unit
from stackwright.plans.registry import query, table


def _batches(spark, d):
    return _placed(spark, d).withColumn("batch_id", sequence.batch_of(F.col("place"), table(spark, d, "orders").count(), 400)).withColumn("split", F.lit("train"))


@query(f"with {BATCHED} select o_orderkey, o_custkey from orders join k using (o_orderkey) where batch_id = 1")
def minibatch_gather(spark, d):
    return sequence.minibatch(table(spark, d, "orders"), _batches(spark, d), "o_orderkey", 1).select("o_orderkey", "o_custkey")


@query(f"with {PLACED} select o_orderkey, o_custkey from orders join p using (o_orderkey) where place < 200")
def test_gather(spark, d):
    split = sequence.split_test(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 200, 17).withColumn("batch_id", F.lit(0))
    return sequence.minibatch(table(spark, d, "orders"), split, "o_orderkey", None).select("o_orderkey", "o_custkey")


@query(f"""with {BATCHED}, s as (select batch_id, count(*) as size from k group by 1), e as (select s.*, epoch from s, (select unnest(range(3))::int as epoch)),
 o as (select *, row_number() over w - 1 as turn, sum(size) over (w rows unbounded preceding) as seen, sum(size) over (partition by epoch) as n from e window w as (partition by epoch order by ((batch_id*3 + epoch + 5)*2654435761) % 4294967296, batch_id))
 select epoch, turn::int as turn, batch_id, size, (epoch*n + seen)::bigint as visits, round(epoch + seen/n, 6) as progress from o""")
def epoch_batches(spark, d):
    sizes = _batches(spark, d).groupBy("batch_id").agg(F.count(F.lit(1)).alias("size"))
    return sequence.epochs(sizes, "size", 3, 5).withColumn("progress", F.round("progress", 6))


@query("select s_suppkey, s_name from supplier where s_suppkey in (select l_suppkey from lineitem where l_quantity > 49)")
def domain_points(spark, d):
    wanted = table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_suppkey").alias("s_suppkey"))
    return sequence.gather(table(spark, d, "supplier"), wanted, "s_suppkey").select("s_suppkey", "s_name")


@query(f"with {CELLS2} select vec_id, x, y, round(v*2.5, 6) as v from c")
def scaled_images(spark, d):
    return robust.scale_images(images(spark, d), 2.5).select("vec_id", "x", "y", F.round("v", 6).alias("v"))


INSIDE = 'g as (select x, y, row_number() over (order by x, y) - 1 as "at" from (select i // 8 - 4 as x, i % 8 - 4 as y from (select unnest(range(64)) as i)) where x*x + y*y < 9)'


@query(f'with {CELLS2}, {INSIDE} select vec_id, "at", round(v, 6) as v from c join g using (x, y)')
def full_to_truncated(spark, d):
    return grid.full_to_truncated(spark, images(spark, d), 8, 2, 0.75, "vec_id").withColumn("v", F.round("v", 6))


@query(f"with {CELLS2} select x, y, round(avg(v), 6) as re, round(avg(v*x), 6) as im, round(avg(v*v + v*x*v*x), 6) as power from c group by all")
def fourier_running_power(spark, d):
    cells = images(spark, d).select("x", "y", F.col("v").alias("re"), (F.col("v") * F.col("x")).alias("im"))
    return likelihood.running_moments(cells, ["x", "y"]).select("x", "y", *[F.round(c, 6).alias(c) for c in ("re", "im", "power")])


@query("select event_type, count(*) as n, round(avg(value), 6) as like, round(sqrt(avg(value*value))/2, 6) as rmse, round(sqrt(avg(user_id % 7))/2, 6) as signal, round(avg(event_id % 5 + 1), 6) as ess, round(count(*)/sum((event_id % 10 + 1)/10.0::double), 6) as speedup from events group by 1")
def batch_diagnostics(spark, d):
    rows = table(spark, d, "events").select("event_type", F.col("value").alias("nll"), (F.col("value") ** 2).alias("error"), (F.col("user_id") % 7).cast("double").alias("signal"), (F.col("event_id") % 5 + 1).alias("ess"), ((F.col("event_id") % 10 + 1) / 10).alias("sampled"))
    out = robust.batch_info(rows, ["event_type"], 4.0)
    return out.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("like", "rmse", "signal", "ess", "speedup")])


@query("select p_size, round(sqrt(sum(power(p_retailprice*0.01, 2))), 5) as step_size, round(sqrt(sum(power(p_partkey::double, 2))), 5) as grad_size, round(sqrt(sum(power(p_retailprice*1.01, 2))), 5) as norm_density, round(sqrt(sum(power(p_retailprice*0.01, 2)))/sqrt(sum(power(p_retailprice*1.01, 2))), 6) as inc_ratio from part group by 1")
def update_norms(spark, d):
    rows = table(spark, d, "part").select("p_size", F.col("p_retailprice").alias("before"), (F.col("p_retailprice") * 1.01).alias("after"), F.col("p_partkey").cast("double").alias("gradient"))
    out = robust.update_norms(rows, ["p_size"])
    return out.select("p_size", *[F.round(c, 5).alias(c) for c in ("step_size", "grad_size", "norm_density")], F.round("inc_ratio", 6).alias("inc_ratio"))


@query("select p_partkey, (p_size - 25)*3.0::double as scaled, -(p_size - 25)::double as flipped, -abs(p_size - 25)::double as negative from part")
def ctf_scale_sign(spark, d):
    rows = table(spark, d, "part").select("p_partkey", (F.col("p_size") - 25).cast("double").alias("dscale"))
    out = rows.join(optics.scaled(rows, 3.0).withColumnRenamed("dscale", "scaled"), "p_partkey").join(optics.scaled(rows, -1.0).withColumnRenamed("dscale", "flipped"), "p_partkey")
    return out.join(optics.with_sign(rows, -1).withColumnRenamed("dscale", "negative"), "p_partkey").drop("dscale")


@query("select p_partkey, (p_size % 33)::int as i, round((p_size % 33)/(64*2.8::double), 8) as freq, round(exp(-125.0*power((p_size % 33)/(64*2.8::double), 2)), 8) as envelope from part")
def envelope_curve(spark, d):
    """The envelope at each part's frequency, looked up on the curve."""
    parts = table(spark, d, "part").select("p_partkey", (F.col("p_size") % 33).cast("int").alias("i"))
    return pairs.look_up(parts, optics.envelope_curve(spark, 64, 2.8, 500.0), "i").select("p_partkey", "i", F.round("freq", 8).alias("freq"), F.round("envelope", 8).alias("envelope"))


@query("select s_suppkey, 'run_' || s_nationkey || '_sup_' || s_suppkey as name from supplier")
def experiment_name(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", text.named("run_{nation}_sup_{key}", nation=F.col("s_nationkey"), key=F.col("s_suppkey")).alias("name"))


@query("select n_nationkey, n_regionkey, null as s_acctbal, n_nationkey as image, 'n' as part from nation union all select s_suppkey + (select count(*) from nation), s_nationkey + (select count(*) from region), s_acctbal, null, 's' from supplier order by all".replace("n_nationkey, n_regionkey, null as s_acctbal, n_nationkey as image, 'n' as part", "n_nationkey::bigint as image_id, n_regionkey::bigint as ctf_id, null::double as acctbal, n_name as label").replace("s_acctbal, null, 's'", "s_acctbal, null").replace(" order by all", ""))
def union_optics(spark, d):
    a = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("image_id"), F.col("n_regionkey").cast("long").alias("ctf_id"), F.col("n_name").alias("label"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("image_id"), F.col("s_nationkey").cast("long").alias("ctf_id"), F.col("s_acctbal").alias("acctbal"))
    regions = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("ctf_id"), "r_name")
    nations = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("ctf_id"), "n_name")
    return pairs.union_optics([(regions, a), (nations, b)])[1]


@query(f"with {UNIT}, k as (select a.id, sum(case when d2 <= 2.0/8*{-math.log(1e-3)!r} then exp(-4*d2) else 0 end) as s from (select a.id, power(a.p0 - g*b.p0, 2) + power(a.p1 - g*b.p1, 2) + power(a.p2 - g*b.p2, 2) as d2 from u a, u b, (select unnest([1, -1]) as g)) a group by 1) select id, round(greatest(s, 1e-3)/sum(greatest(s, 1e-3)) over (), 7) as p from k")
def fisher_kde_near(spark, d):
    u = _unit(spark, d)
    return pairs.fisher_density_near(u, u.withColumn("w", F.lit(1.0)), 8.0, 1e-3, both_hands=True).withColumn("p", F.round("p", 7))


@query(f"with {UNIT}, k as (select a.id, ln(1 + b.id % 3) + 8*(greatest(a.p0*b.p0 + a.p1*b.p1, -a.p0*b.p0 - a.p1*b.p1) + a.p2*b.p2 - 1) as e from u a, u b), l as (select id, max(e) + ln(sum(exp(e - m))) as l from (select *, max(e) over (partition by id) as m from k) group by id) select id, round(l - (select max(l) + ln(sum(exp(l - (select max(l) from l)))) from l), 5) as logp from l")
def fisher_kde_symmetric(spark, d):
    u = _unit(spark, d)
    turns = [[[round(float(v), 12) for v in row] for row in r] for r in quadrature.symmetry_rotations("c2")]
    out = pairs.fisher_density(u, u.withColumn("w", 1.0 + F.col("id") % 3), 8.0, images=turns, log=True)
    return out.withColumn("logp", F.round("logp", 5))


TAPS3 = "t as (select id, row, floor(p0) + a.o as x, floor(p1) + b.o as y, floor(p2) + e.o as z, (1 - abs(p0 - floor(p0) - a.o))*(1 - abs(p1 - floor(p1) - b.o))*(1 - abs(p2 - floor(p2) - e.o)) as w from q, o a, o b, o e)"


#: A direction of each image, from its first three elements.
OWN_DIRECTION = "select vec_id as id, e[1]::double/r as dx, e[2]::double/r as dy, e[3]::double/r as dz from (select vec_id, embedding as e, sqrt(embedding[1]::double**2 + embedding[2]::double**2 + embedding[3]::double**2) as r from embeddings)"


def own_directions(spark, d):
    e = [F.col("embedding")[k].cast("double") for k in range(3)]
    length = F.sqrt(e[0] * e[0] + e[1] * e[1] + e[2] * e[2])
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), *[(x / length).alias(n) for x, n in zip(e, ("dx", "dy", "dz"), strict=True)])


@query(f"""with d as ({OWN_DIRECTION}), {INSIDE},
 q as (select id, "at" as row, case when dz <= -1 then g.x else (1 - dx*dx/(1 + dz))*g.x - dx*dy/(1 + dz)*g.y end as p0, case when dz <= -1 then -g.y else -dx*dy/(1 + dz)*g.x + (1 - dy*dy/(1 + dz))*g.y end as p1, case when dz <= -1 then 0 else -dx*g.x - dy*g.y end as p2 from d, g),
 o as (select unnest([0, 1]) as o), {TAPS3} select id, row, x::int as x, y::int as y, z::int as z, round(w*sqrt(8), 6) as weight from t where abs(w) > 1e-9 and x between -4 and 3 and y between -4 and 3 and z between -4 and 3""")
def projection_matrix(spark, d):
    """The weights of a volume's coefficients in the central slice of each image's direction."""
    out = linear.projection_matrix(spark, own_directions(spark, d), 8, 0.75)
    return out.where(F.abs("weight") > 1e-9 * 8**0.5).select("id", "row", "x", "y", "z", F.round("weight", 6).alias("weight"))


@query(f"""with a as (select vec_id as id, 10*embedding[1]::double as t from embeddings), {INSIDE}, q as (select id, "at" as row, cos(t)*g.x - sin(t)*g.y as p0, sin(t)*g.x + cos(t)*g.y as p1 from a, g), o as (select unnest([0, 1]) as o),
 t as (select id, row, floor(p0) + a.o as x, floor(p1) + b.o as y, (1 - abs(p0 - floor(p0) - a.o))*(1 - abs(p1 - floor(p1) - b.o)) as w from q, o a, o b) select id, row, x::int as x, y::int as y, round(w, 6) as weight from t where abs(w) > 1e-9 and x between -4 and 3 and y between -4 and 3""")
def inplane_matrix(spark, d):
    """The weights of an image's coefficients in its turned ones, by each image's angle."""
    angles = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (10 * F.col("embedding")[0].cast("double")).alias("theta"))
    return linear.inplane_matrix(spark, angles, 8, 0.75).where("abs(weight) > 1e-9").select("id", "row", "x", "y", F.round("weight", 6).alias("weight"))


POINTS = [(0, 0.25, -0.5, 0.75), (1, -1.2, 0.125, 0.5), (2, 0.9, 0.4, -1.3)]
LANCZOS = "case when abs(t) >= 2 then 0 when abs(t) < 1e-9 then 1 else sin(pi()*t)/(pi()*t)*sin(pi()*t/2)/(pi()*t/2) end"


@query(f"""with {CELLS3}, q0(id, p0, p1, p2) as (values {", ".join(map(str, POINTS))}), q as (select id, p0::double as p0, p1::double as p1, p2::double as p2 from q0), o as (select unnest(range(-1, 3)) as o),
 t as (select id, floor(p0) + a.o as x, floor(p1) + b.o as y, floor(p2) + e.o as z, p0, p1, p2 from q, o a, o b, o e), w as (select id, x, y, z, {LANCZOS.replace("t)", "(p0 - x))").replace("*t/", "*(p0 - x)/")} as a, {LANCZOS.replace("t)", "(p1 - y))").replace("*t/", "*(p1 - y)/")} as b, {LANCZOS.replace("t)", "(p2 - z))").replace("*t/", "*(p2 - z)/")} as e from t)
 select vec_id, id, round(sum(a*b*e*v), 6) as re, round(sum(a*b*e*v*z), 6) as im from c join w using (x, y, z) group by all""")
def fourier_sample(spark, d):
    """Complex values at arbitrary points, with a kernel of four taps."""
    cells = volumes(spark, d).select("vec_id", "x", "y", "z", F.col("v").alias("re"), (F.col("v") * F.col("z")).alias("im"))
    points = spark.createDataFrame(POINTS, "id int, p0 double, p1 double, p2 double")
    out = linear.sample_at(cells, points, 3, 4, "lanczos", 4, key="vec_id", values=("re", "im"))
    return out.select("vec_id", "id", F.round("re", 6).alias("re"), F.round("im", 6).alias("im"))


@query(f"""with {CELLS3}, r(a, b) as (values (1, 0), (0, -1), (-1, 0), (0, 1)), k as (select distinct x, y from c), g as (select c.vec_id, k.x, k.y, c.z, c.v from k, r, c where c.x = k.x*a + k.y*b and c.y = k.x*-b + k.y*a)
 select vec_id, (x + 2)*4 + y + 2 as id, z, round(sum(v), 6) as re, round(sum(v*2), 6) as im from g group by all""")
def symmetrise_about_z(spark, d):
    cells = volumes(spark, d).select("vec_id", "x", "y", "z", F.col("v").alias("re"), (F.col("v") * 2).alias("im"))
    at = grid.grid(spark, 4, 2).select(((F.col("x") + 2) * 4 + F.col("y") + 2).alias("id"), F.col("x").cast("double").alias("p0"), F.col("y").cast("double").alias("p1"))
    turns = quadrature.symmetry_table(spark, "c4").select("op", *[F.round(f"r{i}{j}", 12).alias(f"r{i}{j}") for i in range(2) for j in range(2)])
    out = linear.symmetrise(cells, at, turns, 2, 4, "vec_id", normalise=False, values=("re", "im"))
    return out.select("vec_id", "id", "z", F.round("re", 6).alias("re"), F.round("im", 6).alias("im"))


@query(f"""with {CELLS3}, a as (select i.vec_id, (k.x + 2)*16 + (k.y + 2)*4 + k.z + 2 as id, k.x/2.0::double + 0.25 as p0, k.y/2.0::double as p1, k.z/2.0::double - 0.5 as p2 from (select distinct vec_id from c) i, (select distinct x, y, z from c) k),
 o as (select unnest([0, 1]) as o), t as (select vec_id, id, floor(p0) + a1.o as x, floor(p1) + b.o as y, floor(p2) + e.o as z, (1 - abs(p0 - floor(p0) - a1.o))*(1 - abs(p1 - floor(p1) - b.o))*(1 - abs(p2 - floor(p2) - e.o)) as w from a, o a1, o b, o e where least(p0, p1, p2) >= -2 and greatest(p0, p1, p2) <= 1)
 select a.vec_id, a.id, round(coalesce(sum(w*v), 0), 6) as v from a left join t on t.vec_id = a.vec_id and t.id = a.id left join c on c.vec_id = t.vec_id and c.x = t.x and c.y = t.y and c.z = t.z group by all""")
def shifted_volume(spark, d):
    at = grid.grid(spark, 4, 3).select(((F.col("x") + 2) * 16 + (F.col("y") + 2) * 4 + F.col("z") + 2).alias("id"), *[F.col(a).cast("double").alias(f"p{i}") for i, a in enumerate("xyz")])
    one = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]
    return linear.rotate_volume(volumes(spark, d), at, one, 4, "vec_id", (0.25, 0.0, -0.5), 2.0).withColumn("v", F.round("v", 6))


@query(f"with {CELLS2}, h as (select vec_id, x, y, v as re, v*x as im from c), m as (select a.vec_id, (a.re - b.re)/2 as re, (a.im + b.im)/2 as im from h a join h b on a.vec_id = b.vec_id and b.x = (-a.x + 12) % 8 - 4 and b.y = (-a.y + 12) % 8 - 4) select vec_id as id, round(sqrt(sum(re*re + im*im)), 6) as residual from m group by 1")
def hermitian_residual(spark, d):
    cells = images(spark, d).select(F.col("vec_id").alias("id"), "x", "y", F.col("v").alias("re"), (F.col("v") * F.col("x")).alias("im"))
    return linear.hermitian_residual(cells, 2, 8).withColumn("residual", F.round("residual", 6))


@query(f"with {CELLS3} select vec_id, x, y, z, round(case when (x = -2)::int + (y = -2)::int + (z = -2)::int >= 2 then 0 else v end, 6) as box, round(case when x*x + y*y + z*z < 1 then v else 0 end, 6) as circle, round(v*(0.54 - 0.46*cos((x+2)*2*pi()/3))*(0.54 - 0.46*cos((y+2)*2*pi()/3))*(0.54 - 0.46*cos((z+2)*2*pi()/3)), 6) as hamming from c")
def volume_windows(spark, d):
    return volumes(spark, d).select("vec_id", "x", "y", "z", *[F.round(F.col("v") * linear.separable_window(3, 4, k), 6).alias(k) for k in ("box", "circle", "hamming")])


TAPS, PICK = fourier.blur_taps(0.5), fourier.nearest(8, 4)
BLUR = ", ".join(f"({i - len(TAPS) // 2}, {float(t)!r}::double)" for i, t in enumerate(TAPS))


@query(f"with {CELLS2}, k(d, w) as (values {BLUR}), a as (select vec_id, x + d as x, y, sum(w*v) as v from c, k group by all), b as (select vec_id, x, y + d as y, sum(w*v) as v from a, k group by all), p(i, place) as (values {', '.join(f'({i}, {int(a)})' for i, a in enumerate(PICK))}) select vec_id, (r.i*4 + s.i)::int as pixel, round(v, 5) as v from b join p r on b.x + 4 = r.place join p s on b.y + 4 = s.place")
def resized_images(spark, d):
    px = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda e: e.cast("double")).alias("px"))
    return fourier.resize(px, "vec_id", "px", 8, 4, 2).select("vec_id", F.posexplode("v").alias("pixel", "v")).withColumn("v", F.round("v", 5))


@query(f"{RIS} select vec_id, round(-(max(e) + ln(sum(exp(e - m)))), 5) as nll from (select *, max(e) over (partition by vec_id) as m from e where i = 0) group by 1")
def marginal_likelihood_two_axes(spark, d):
    """Directions and shifts alone, without in-plane turns as an axis of their own."""
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode(F.slice("embedding", 1, 32)).alias("c", "re"), "embedding")
    e = e.select("vec_id", "c", F.col("re").cast("double").alias("re"), F.col("embedding")[F.col("c") + 32].cast("double").alias("im"))
    return likelihood.marginal_sql(e, _projections(spark).where("i = 0"), "vec_id", 1.5).withColumn("nll", F.round("nll", 5))


@query("select event_id as iteration, k as name, round(value*(case k when 'R' then 1 when 'I' then 2 else 3 end), 6) as value from events, (select unnest(['R', 'I', 'S']) as k)")
def sampling_speedups(spark, d):
    stat = table(spark, d, "events").select(F.col("event_id").alias("iteration"), *[(F.col("value") * w).alias(f"train_is_speedup_{k}") for w, k in ((1, "R"), (2, "I"), (3, "S"))])
    return monitor.sampling_speedups(stat, "train").withColumn("value", F.round("value", 6))


@query("select o_orderkey as iteration, i::int as percent, round(o_totalprice*i, 4) as full, round(o_totalprice + i, 4) as mini from orders, (select unnest(range(3)) as i)")
def likelihood_quantiles(spark, d):
    price = F.col("o_totalprice")
    stat = table(spark, d, "orders").select(F.col("o_orderkey").alias("iteration"), F.array(*[price * i for i in range(3)]).alias("test_full_like_quantiles"), F.array(*[price + i for i in range(3)]).alias("test_mini_like_quantiles"))
    out = monitor.likelihood_quantiles(stat, "test")
    return out.select("iteration", "percent", F.round("full", 4).alias("full"), F.round("mini", 4).alias("mini"))


assert len(PROJ) == 2 * 4 * 3 * 32
