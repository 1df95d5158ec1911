"""Queries over images (embeddings as 8 x 8) and volumes (as 4 x 4 x 4), each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackwright.functions import optics
from stackwright.operators import grid, linear, objectives, quadrature, radial, robust
from stackwright.plans.registry import query, table

CELLS2 = "c as (select vec_id, i // 8 - 4 as x, i % 8 - 4 as y, embedding[i + 1]::double as v from embeddings, (select unnest(range(64)) as i))"
CELLS3 = "c as (select vec_id, i // 16 - 2 as x, i // 4 % 4 - 2 as y, i % 4 - 2 as z, embedding[i + 1]::double as v from embeddings, (select unnest(range(64)) as i))"
BINS = """b as (select vec_id, x, y, v, floor(sqrt(x*x+y*y))::int as lo, sqrt(x*x+y*y) - floor(sqrt(x*x+y*y)) as f from c),
 s as (select vec_id, lo as bin, 1 - f as w, v from b where lo + 1 < 6 union all select vec_id, lo + 1, f, v from b where lo + 1 < 6),
 p as (select vec_id, bin, sum(w*v)/sum(w) as mean from s group by all)"""


def images(spark: SparkSession, d: str) -> DataFrame:
    return grid.explode_array(table(spark, d, "embeddings"), "embedding", 8, 2, ["vec_id"])


def volumes(spark: SparkSession, d: str) -> DataFrame:
    return grid.explode_array(table(spark, d, "embeddings"), "embedding", 4, 3, ["vec_id"])


@query(f"with {CELLS2}, {BINS} select vec_id, bin, round(mean, 6) as mean from p")
def radial_average(spark, d):
    return radial.radial_average_query(spark, d)


@query(f"with {CELLS2}, b as (select vec_id, v*v as v, floor(sqrt(x*x+y*y))::int as lo, sqrt(x*x+y*y) - floor(sqrt(x*x+y*y)) as f from c), s as (select vec_id, lo as bin, 1 - f as w, v from b where lo + 1 < 6 union all select vec_id, lo + 1, f, v from b where lo + 1 < 6) select vec_id, bin, round(sum(w*v)/sum(w), 6) as power from s group by all")
def radial_power(spark, d):
    return radial.radial_average(images(spark, d), "vec_id", 8, value=F.col("v") * F.col("v")).select("vec_id", "bin", F.round("mean", 6).alias("power"))


@query(f"with {CELLS2}, {BINS}, g as (select vec_id, x, y, least(floor(sqrt(x*x+y*y)), 5)::int as lo, sqrt(x*x+y*y) - floor(sqrt(x*x+y*y)) as f from c) select g.vec_id, x, y, round((1-f)*a.mean + f*b.mean, 6) as v from g join p a on a.vec_id = g.vec_id and a.bin = lo join p b on b.vec_id = g.vec_id and b.bin = least(lo + 1, 5)")
def radial_expand(spark, d):
    cells = images(spark, d)
    profile = radial.radial_average(cells, "vec_id", 8).select("vec_id", "bin", "mean")
    return radial.expand_profile(profile, cells.drop("v"), "vec_id", 2).select("vec_id", "x", "y", F.round("v", 6).alias("v"))


FSC = f"""with {CELLS3}, e as (select a.vec_id // 2 as pair, a.x, a.y, a.z, a.v as v1, b.v as v2 from c a join c b on a.vec_id % 2 = 0 and b.vec_id = a.vec_id + 1 and a.x = b.x and a.y = b.y and a.z = b.z),
 h as (select *, greatest(floor(sqrt(x*x+y*y+z*z) - 0.5), 0)::int as shell from e), k as (select pair, shell, sum(v1*v2)/sqrt(sum(v1*v1)*sum(v2*v2)) as fsc from h where shell < 3 group by all)"""


def _pairs(spark, d):
    cells = volumes(spark, d)
    a = cells.where("vec_id % 2 = 0").select(F.expr("vec_id div 2").alias("pair"), "x", "y", "z", F.col("v").alias("v1"))
    b = cells.where("vec_id % 2 = 1").select(F.expr("vec_id div 2").alias("pair"), "x", "y", "z", F.col("v").alias("v2"))
    return a.join(b, ["pair", "x", "y", "z"])


@query(f"{FSC} select pair, shell, round(fsc, 6) as fsc from k")
def shell_correlation(spark, d):
    return radial.shell_correlation(_pairs(spark, d), "pair", 3, 3).select("pair", "shell", F.round("fsc", 6).alias("fsc"))


@query(f"{FSC}, l as (select *, lag(fsc) over (partition by pair order by shell) as prev from k), f as (select pair, min(shell) filter (fsc < 0.5) as s from k group by pair) select f.pair, round(case when s is null then 4.5 when l.prev is null then 'inf'::double - 0 else s + 0.5 + (l.prev - 0.5)/(l.prev - l.fsc) end, 5) as radius from f left join l on l.pair = f.pair and l.shell = f.s where s is null or l.prev is not null or true")
def shell_resolution(spark, d):
    fsc = radial.shell_correlation(_pairs(spark, d), "pair", 3, 4)
    fsc = fsc.where("shell < 3")
    out = radial.shell_resolution(fsc, "pair", 0.5)
    return out.select("pair", F.when(F.col("radius") == float("inf"), F.col("radius")).otherwise(F.round("radius", 5)).alias("radius"))


CORNER = "x*x + y*y > 6.0516"  # (0.99 * 4 - 1.5) ** 2


@query(f"with {CELLS2} select vec_id, x, y, round(v - avg(v) filter ({CORNER}) over (partition by vec_id), 6) as v from c")
def corner_float(spark, d):
    return robust.float_images(images(spark, d), "vec_id", 8).select("vec_id", "x", "y", F.round("v", 6).alias("v"))


@query(f"with {CELLS2} select vec_id, x, y, round(case when {CORNER} then 0 else v end, 6) as v from c")
def corner_window(spark, d):
    return robust.window_images(images(spark, d), 8).select("vec_id", "x", "y", F.round("v", 6).alias("v"))


NOISE = "x*x + y*y > 6.25"


@query(f"with {CELLS2} select 'robust' as kind, round(power(1.4826*median(abs(v)), 2), 6) as variance from c where {NOISE} union all select 'centred', round(power(1.4826*mad(v), 2), 6) from c where {NOISE} union all select 'mle', round(avg(v*v), 6) from c where {NOISE} union all select 'mle_centred', round(var_pop(v), 6) from c where {NOISE}")
def noise_variance(spark, d):
    cells = images(spark, d)
    out = None
    for kind, est, centred in (("robust", "robust", False), ("centred", "robust", True), ("mle", "mle", False), ("mle_centred", "mle", True)):
        part = robust.noise_variance(cells, 8, est, centred).select(F.lit(kind).alias("kind"), F.round("variance", 6).alias("variance"))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"with {CELLS2} select round(avg(p), 6) as variance from (select avg(v*v) as p from c group by vec_id)")
def data_variance(spark, d):
    return robust.data_variance(images(spark, d), "vec_id").select(F.round("variance", 6).alias("variance"))


@query(f"with {CELLS2}, a as (select avg(p) as data from (select avg(v*v) as p from c group by vec_id)), n as (select avg(v*v) as noise from c where {NOISE}) select round(data, 6) as data, round(noise, 6) as noise, round(data - noise, 6) as signal, round(100*(data - noise)/noise, 4) as percent, round(case when data > noise then 10*log10((data - noise)/noise) end, 4) as decibel from a, n")
def snr(spark, d):
    cells = images(spark, d)
    out = robust.snr(robust.data_variance(cells, "vec_id"), robust.noise_variance(cells, 8, "mle"))
    return out.select(*[F.round(c, 6).alias(c) for c in ("data", "noise", "signal")], *[F.round(c, 4).alias(c) for c in ("percent", "decibel")])


@query(f"with {CELLS2}, n as (select sqrt(avg(v*v)) as s from c where {NOISE}) select vec_id, x, y, round(v / s, 6) as v from c, n")
def normalised_images(spark, d):
    cells = images(spark, d)
    return robust.normalise(cells, robust.noise_variance(cells, 8, "mle")).select("vec_id", "x", "y", F.round("v", 6).alias("v"))


@query(f"with {CELLS2} select x, y, count(*) as n, round(avg(v), 6) as mean, round(avg(v*v), 6) as power from c where x*x + y*y < 9 group by all")
def mean_power_in_mask(spark, d):
    rows = images(spark, d).where(grid.inside(8, 2, 0.75))
    return rows.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.avg(F.col("v") * F.col("v")), 6).alias("power"))


@query(f"with {CELLS2} select vec_id, count(*) as n, round(sum(v), 6) as total from c where greatest(abs(x), abs(y)) < 3 group by all")
def square_mask(spark, d):
    return images(spark, d).where(grid.inside(8, 2, 0.75, "square")).groupBy("vec_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 6).alias("total"))


@query("select vec_id, i as pixel, round(embedding[i + 1]::double, 6) as v from embeddings, (select unnest(range(64))::int as i)")
def pack_round_trip(spark, d):
    return grid.pack_array(images(spark, d), 8, 2, ["vec_id"]).select("vec_id", F.posexplode("v").alias("pixel", "v")).withColumn("v", F.round("v", 6))


MOMENTS = ", ".join([f"round(sum(v*v*{a})/sum(v*v), 6) as m{a}" for a in "xyz"] + [f"round((sum(v*v*{a}*{b})/sum(v*v) - sum(v*v*{a})/sum(v*v)*sum(v*v*{b})/sum(v*v))/64, 8) as c{a}{b}" for i, a in enumerate("xyz") for b in "xyz"[i:]])


@query(f"with {CELLS3} select vec_id, {MOMENTS} from c group by vec_id")
def moments(spark, d):
    out = robust.moments(volumes(spark, d), ["vec_id"], 4)
    return out.select("vec_id", *[F.round(c, 6 if c[0] == "m" else 8).alias(c) for c in out.columns if c != "vec_id"])


@query(f"with {CELLS3} select vec_id, round(sum(v), 6) as total, count(*) filter (v = 0) as zeros, round(avg(v), 6) as mean, round(max(v), 6) as most, round(min(v), 6) as least, round(sqrt(sum(v*v)), 6) as norm from c group by vec_id")
def density_stats(spark, d):
    out = robust.density_stats(volumes(spark, d), ["vec_id"])
    return out.select("vec_id", "zeros", *[F.round(c, 6).alias(c) for c in ("total", "mean", "most", "least", "norm")])


@query(f"with {CELLS3}, m as (select vec_id, x, y, z, greatest(least(greatest(v, -0.1), 0.2), 0) as v from c) select vec_id, x, y, z, round(v / sum(v) over (partition by vec_id), 6) as v from m")
def clamp_and_mass(spark, d):
    return robust.to_mass(robust.clamp(volumes(spark, d), -0.1, 0.2), ["vec_id"]).select("vec_id", "x", "y", "z", F.round("v", 6).alias("v"))


@query(f"with {CELLS3} select floor(least((v + 1)/2*20, 19))::int as bin, count(*) as n from c where v between -1 and 1 group by all")
def voxel_histogram(spark, d):
    return robust.histogram(volumes(spark, d), "v", -1.0, 1.0, 20)


@query(f"with {CELLS3} select vec_id, x, y, z, round(v * (0.5 - 0.5*cos((x+2)*2*pi()/3)) * (0.5 - 0.5*cos((y+2)*2*pi()/3)) * (0.5 - 0.5*cos((z+2)*2*pi()/3)), 6) as v from c")
def hanning_window(spark, d):
    return volumes(spark, d).select("vec_id", "x", "y", "z", F.round(F.col("v") * linear.separable_window(3, 4, "hanning"), 6).alias("v"))


LAM = "12.2643247/sqrt(200e3 + 200e3*200e3*0.978466e-6)"


@query(f"""with p as (select p_partkey, 10000.0 + p_size*100 as df1, 9000.0 + p_retailprice as df2, (p_partkey % 180)*pi()/180 as ang from part),
 g as (select i // 8 - 4 as x, i % 8 - 4 as y from (select unnest(range(64)) as i)),
 t as (select p_partkey, x, y, sqrt(x*x + y*y)/(8*2.8) as f, atan2(y, x) as a, df1, df2, ang, {LAM} as lam from p, g),
 h as (select *, pi()*lam*f*f*0.5*(df1 + df2 + cos(2*(a - ang))*(df1 - df2)) - 0.5*pi()*lam*f*f*2e7*lam*f*lam*f as chi from t)
 select p_partkey, x, y, round((-sqrt(1 - 0.07*0.07)*sin(chi) - 0.07*cos(chi))*exp(-125.0*f*f), 5) as ctf from h""")
def ctf_value(spark, d):
    p = table(spark, d, "part").select("p_partkey", (10000.0 + F.col("p_size") * 100).alias("df1"), (9000.0 + F.col("p_retailprice")).alias("df2"), ((F.col("p_partkey") % 180) * 3.141592653589793 / 180).alias("ang"))
    cells = p.crossJoin(F.broadcast(grid.grid(spark, 8, 2)))  # a grid of 64 cells, whatever the data
    f = F.sqrt(grid.radius2(2).cast("double")) / (8 * 2.8)
    a = F.atan2(F.col("y").cast("double"), F.col("x").cast("double"))
    ctf = optics.contrast_transfer(f, a, F.lit(200.0), F.lit(2.0), F.lit(0.07), F.col("df1"), F.col("df2"), F.col("ang"), F.lit(1.0), F.lit(500.0))
    return cells.select("p_partkey", "x", "y", F.round(ctf, 5).alias("ctf"))


@query(f"with {CELLS2} select vec_id, round(sum(v*cos((x*1.5 + y*0.5)*2*pi()/8)), 6) as re, round(sum(v*sin((x*1.5 + y*0.5)*2*pi()/8)), 6) as im from c group by vec_id")
def shift_phase(spark, d):
    re, im = optics.shift_phase(F.col("x"), F.col("y"), F.lit(1.5), F.lit(0.5), 8)
    return images(spark, d).groupBy("vec_id").agg(F.round(F.sum(F.col("v") * re), 6).alias("re"), F.round(F.sum(F.col("v") * im), 6).alias("im"))


POINTS = [(i, *p) for i, p in enumerate([(0.25, -0.5, 0.75), (-1.5, 0.125, 0.5), (0.9, 0.9, -1.9), (1.7, -2.4, 0.0)])]
POINT_ROWS = ", ".join(map(str, POINTS))
TRI = f"""q0(id, p0, p1, p2) as (values {POINT_ROWS}), q as (select id, p0::double as p0, p1::double as p1, p2::double as p2 from q0),
 o as (select unnest([0, 1]) as o), t as (select id, floor(p0) + a.o as x, floor(p1) + b.o as y, floor(p2) + e.o as z, (1 - abs(p0 - floor(p0) - a.o))*(1 - abs(p1 - floor(p1) - b.o))*(1 - abs(p2 - floor(p2) - e.o)) as w from q, o a, o b, o e)"""


def _points(spark):
    return spark.createDataFrame(POINTS, "id int, p0 double, p1 double, p2 double")


@query(f"with {CELLS3}, {TRI} select vec_id, id, round(sum(w*v), 6) as v from c join t on c.x = t.x and c.y = t.y and c.z = t.z where w <> 0 group by all")
def trilinear_sample(spark, d):
    return linear.sample_at(volumes(spark, d), _points(spark), 3, 4, key="vec_id").select("vec_id", "id", F.round("v", 6).alias("v"))


#: A point of each image: eight times its first three elements.
OWN_POINT = "select vec_id as id, 8*embedding[1]::double as p0, 8*embedding[2]::double as p1, 8*embedding[3]::double as p2 from embeddings"


@query(f"with q as ({OWN_POINT}), {TRI[TRI.index('o as'):]} select id, x::int as x, y::int as y, z::int as z, round(w, 6) as weight from t where w <> 0 and x between -2 and 1 and y between -2 and 1 and z between -2 and 1")
def interpolation_matrix(spark, d):
    """The weights of a grid's cells in a point of each image."""
    points = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), *[(8 * F.col("embedding")[k].cast("double")).alias(f"p{k}") for k in range(3)])
    return linear.interpolation_taps(points, 3, 4).withColumn("weight", F.round("weight", 6))


C4 = """r(op, a, b) as (values (0, 1, 0), (1, 0, -1), (2, -1, 0), (3, 0, 1)),
 g as (select c.vec_id, k.x, k.y, k.z, c.v from c join r on true join (select distinct x, y, z from c) k on c.x = k.x*a + k.y*b and c.y = k.x*-b + k.y*a and c.z = k.z)"""


@query(f"with {CELLS3}, {C4} select vec_id, (x + 2)*16 + (y + 2)*4 + z + 2 as id, round(sum(v)/4, 6) as v from g group by all")
def symmetrise_c4(spark, d):
    cells = volumes(spark, d)
    at = grid.grid(spark, 4, 3).select(((F.col("x") + 2) * 16 + (F.col("y") + 2) * 4 + F.col("z") + 2).alias("id"), *[F.col(a).cast("double").alias(f"p{i}") for i, a in enumerate("xyz")])
    at = at.select("id", "p0", "p1", "p2")
    turns = quadrature.symmetry_table(spark, "c4").select("op", *[F.round(f"r{i}{j}", 12).alias(f"r{i}{j}") for i in range(3) for j in range(3)])
    return linear.symmetrise(cells, at, turns, 3, 4, "vec_id").select("vec_id", "id", F.round("v", 6).alias("v"))


@query(f"with {CELLS2}, m as (select vec_id, (d0 + d1*2)::int as corner, ((x - d0 + 4 + 8) % 8 - 4)::int as ox, ((y - d1 + 4 + 8) % 8 - 4)::int as oy, v from c, (select unnest([0, 1]) as d0) a, (select unnest([0, 1]) as d1) b) select vec_id as id, ox as x, oy as y, list_transform(list(v order by corner), lambda e: round(e, 6)) as corners from m group by all")
def cell_layout(spark, d):
    out = linear.cell_corners(images(spark, d).withColumnRenamed("vec_id", "id"), 2, 8)
    # a negative value that is rounded to zero keeps its sign: elements of arrays are told apart by it
    return out.select("id", "x", "y", F.transform("corners", lambda e: F.when(F.round(e, 6) == 0, e * 0.0).otherwise(F.round(e, 6))).alias("corners"))


@query(f"with {CELLS2}, h as (select vec_id, x, y, v as re, v*x as im from c), b as (select * from h union all select vec_id, ((-x + 4 + 8) % 8 - 4), ((-y + 4 + 8) % 8 - 4), re, -im from h) select vec_id as id, x::int as x, y::int as y, round(sum(re)/2, 6) as re, round(sum(im)/2, 6) as im from b group by all")
def hermitian_part(spark, d):
    cells = images(spark, d).select(F.col("vec_id").alias("id"), "x", "y", F.col("v").alias("re"), (F.col("v") * F.col("x")).alias("im"))
    return linear.hermitian_part(cells, 2, 8).select("id", "x", "y", F.round("re", 6).alias("re"), F.round("im", 6).alias("im"))


def _volume_cells(spark, d):
    return volumes(spark, d).withColumnRenamed("vec_id", "id")


def _loss(df):
    return df.select("id", F.round("loss", 5).alias("loss"))


@query(f"with {CELLS3} select vec_id as id, round(sum(0.5*v*v/0.25 + ln(0.5) + 0.5*ln(2*pi())), 5) as loss from c group by vec_id")
def prior_gaussian(spark, d):
    return _loss(objectives.gaussian(0.5).evaluate(_volume_cells(spark, d)))


@query(f"with {CELLS3} select vec_id as id, round(sum(3.0*abs(v) - ln(3.0)), 5) as loss from c group by vec_id")
def prior_sparsity(spark, d):
    return _loss(objectives.sparsity(3.0).evaluate(_volume_cells(spark, d)))


@query(f"with {CELLS3} select vec_id as id, round(sum(case when v < 0 then 2.0/(8*100)*v*v else 0 end), 5) as loss from c group by vec_id")
def prior_negative(spark, d):
    return _loss(objectives.negative(2, 2.0, 2.0, 100).evaluate(_volume_cells(spark, d)))


MIX = "0.6/(2*0.25)*exp(-v/0.25)", "0.4/sqrt(2*pi()*0.09)*exp(-0.5*power(v - 0.1, 2)/0.09)"


@query(f"with {CELLS3} select vec_id as id, round(sum(-ln({MIX[0]} + {MIX[1]})), 5) as loss from c group by vec_id")
def prior_mixture(spark, d):
    return _loss(objectives.exponential_gaussian(0.6, 0.25, 0.1, 0.3).evaluate(_volume_cells(spark, d)))


@query(f"with {CELLS3} select vec_id as id, x, y, z, round(({MIX[0]}/0.25 + {MIX[1]}*(v - 0.1)/0.09)/({MIX[0]} + {MIX[1]}), 5) as g from c")
def prior_mixture_gradient(spark, d):
    return objectives.exponential_gaussian(0.6, 0.25, 0.1, 0.3).with_gradient(_volume_cells(spark, d)).select("id", "x", "y", "z", F.round("g", 5).alias("g"))


@query(f"with {CELLS3}, r as (select v, {MIX[0]} as e, {MIX[1]} as g from c) select round(sqrt(sum(g/(e+g)*power(v - 0.1, 2))/sum(g/(e+g))), 6) as sigma, round((select 1/avg(v) from c where v > 0), 6) as rate from r")
def prior_learning(spark, d):
    cells = _volume_cells(spark, d)
    a, b = objectives.mixture_sigma(cells, 0.6, 0.25, 0.1, 0.3), objectives.sparsity_rate(cells)
    return a.crossJoin(b).select(F.round("sigma", 6).alias("sigma"), F.round("rate", 6).alias("rate"))


@query(f"with {CELLS3} select vec_id as id, round(0.5*1.5*(power(sum(w*x)/sum(w), 2) + power(sum(w*y)/sum(w), 2) + power(sum(w*z)/sum(w), 2)), 5) as loss from (select *, abs(v) as w from c) group by vec_id")
def prior_centre(spark, d):
    return _loss(objectives.centre_penalty(_volume_cells(spark, d).withColumn("v", F.abs("v")), 1.5))


CAR = f"""with {CELLS3}, o as (select unnest(range(-2, 3)) as o), k0 as (select a.o as a, b.o as b, e.o as e, exp(-(a.o*a.o + b.o*b.o + e.o*e.o)/(2*0.36)) as w from o a, o b, o e where (a.o, b.o, e.o) <> (0, 0, 0)), k as (select a, b, e, w/sum(w) over () as w from k0),
 p as (select vec_id, x + a as x, y + b as y, z + e as z, sum(w*v) as p from c, k group by all), r as (select c.*, v - coalesce(p, 0) as err from c left join p using (vec_id, x, y, z))"""


@query(f"{CAR} select vec_id as id, round(0.5*sum(v*err)/0.25, 5) as loss from r group by all")
def prior_neighbours(spark, d):
    return _loss(objectives.neighbour_prior(_volume_cells(spark, d), 4, 0.5, 0.6))


@query(f"{CAR} select vec_id as id, x, y, z, round(err/0.25, 5) as g from r")
def prior_neighbours_gradient(spark, d):
    return objectives.neighbour_gradient(_volume_cells(spark, d), 4, 0.5, 0.6).select("id", "x", "y", "z", F.round("g", 5).alias("g"))


@query(f"with {CELLS3} select vec_id as id, round(sum(2.0*(0.5*v*v/0.25 + ln(0.5) + 0.5*ln(2*pi())) + 0.5*(3.0*abs(v) - ln(3.0))), 5) as loss from c group by vec_id")
def prior_sum(spark, d):
    return _loss(objectives.total(_volume_cells(spark, d), [(2.0, objectives.gaussian(0.5)), (0.5, objectives.sparsity(3.0)), (1.0, objectives.null_prior())]))


@query(f"with {CELLS2}, m as (select vec_id, sum(v*4) as t from c group by 1) select vec_id as id, x, y, round(4*v, 6) as v from c join m using (vec_id)")
def cell_layout_transposed(spark, d):
    """Summed back, every cell counts once for each of the four cells that gathered it."""
    layout = linear.cell_corners(images(spark, d).withColumnRenamed("vec_id", "id"), 2, 8)
    return linear.cells_from_corners(layout, 2, 8).withColumn("v", F.round("v", 6))


@query(f"with {CELLS3}, a as (select i.vec_id, k.* from (select distinct vec_id from c) i, (select distinct x, y, z from c) k) select a.vec_id, (a.x + 2)*16 + (a.y + 2)*4 + a.z + 2 as id, round(coalesce(c.v, 0), 6) as v from a left join c on c.vec_id = a.vec_id and c.x = -a.y and c.y = a.x and c.z = a.z")
def rotate_volume(spark, d):
    at = grid.grid(spark, 4, 3).select(((F.col("x") + 2) * 16 + (F.col("y") + 2) * 4 + F.col("z") + 2).alias("id"), *[F.col(a).cast("double").alias(f"p{i}") for i, a in enumerate("xyz")])
    turn = [[0.0, -1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]]
    return linear.rotate_volume(volumes(spark, d), at, turn, 4, "vec_id").withColumn("v", F.round("v", 6))


@query(f"with {CELLS2}, t(id, x, y, w) as (values (0, 1, -2, 0.375), (0, 2, -2, 0.125), (0, 1, -1, 0.375), (0, 2, -1, 0.125), (1, -4, 3, 0.25)) select vec_id, id, round(sum(w*v), 6)::double as v from c join t using (x, y) group by all")
def bilinear_sample(spark, d):
    points = spark.createDataFrame([(0, 1.25, -1.5), (1, -4.5, 3.5)], "id int, p0 double, p1 double")
    return linear.sample_at(images(spark, d), points, 2, 8, key="vec_id").withColumn("v", F.round("v", 6))


@query(f"with {CELLS2} select vec_id, x, y, round(case when x*x + y*y < 9 then v else 0 end, 6) as v from c")
def truncated_to_full(spark, d):
    cells = images(spark, d)
    part = cells.where(grid.inside(8, 2, 0.75))
    return grid.truncated_to_full(spark, part, 8, 2, cells.select("vec_id").distinct(), "vec_id").withColumn("v", F.round("v", 6))
