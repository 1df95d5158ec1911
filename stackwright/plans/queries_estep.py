"""The sampled expectation step over the images of `embeddings`, and sums of long arrays."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from stackwright.operators import blocks, descent, estep, histories, probability, sampler_state, tiles
from stackwright.plans.registry import query, table

#: Points of the domain: slices, turns, shifts; coefficients; noise variance. Distributions are drawn from elements of
#: the images: (axis, point, element, draws).
N_R, N_I, N_S, N_C, SIGMA2 = 2, 4, 3, 32, 1.5
ELEMENTS = [("r", 0, 1, 2), ("r", 1, 2, 2), *(("i", k, 3 + k, 3) for k in range(N_I)), *(("s", k, 7 + k, 2) for k in range(N_S))]


def domain() -> estep.Domain:
    c = np.arange(N_C)
    slices = np.array([np.sin(1 + r + c) + 1j * np.cos(r * c + 1) for r in range(N_R)])
    phases = np.array([np.exp(0.1j * s * c) for s in range(N_S)])
    turn_at = np.array([(c + i) % N_C for i in range(N_I)])[:, :, None]
    logw = (np.full(N_R, -math.log(N_R)), -math.log(N_I) + 0.01 * np.arange(N_I), np.full(N_S, -math.log(N_S)))
    return estep.Domain(slices, phases, turn_at, np.ones(turn_at.shape), logw, SIGMA2)


def sampled_images(spark, d):
    """Images with optics by label, and their candidates; every fifth image has all turns."""
    e = table(spark, d, "embeddings")
    double = lambda start: F.transform(F.slice("embedding", start, N_C), lambda v: v.cast("double"))
    optics = F.transform(F.sequence(F.lit(0), F.lit(N_C - 1)), lambda k: 1 / (1 + 0.02 * k * (1 + F.col("label") % 3)))
    images = e.select("vec_id", double(1).alias("re"), double(1 + N_C).alias("im"), optics.alias("optics"))
    points = F.inline(F.array(*[F.struct(F.lit(a).alias("axis"), F.lit(p).alias("point"), (F.abs(F.col("embedding")[k - 1].cast("double")) + 0.05).alias("p"), F.lit(n).alias("n")) for a, p, k, n in ELEMENTS]))
    shares = e.select("vec_id", points).where("axis != 'i' or vec_id % 5 != 0")
    samples = probability.draw(shares, ["vec_id", "axis"], "point", "p", "n", seed=9)
    return estep.candidates(images, samples, "vec_id")


SAMPLES = f"""with x(axis, point, k, n) as (values {', '.join(map(str, ELEMENTS))}),
 w as (select vec_id, axis, point, n, abs(embedding[k]::double) + 0.05 as p, ('0x' || substr(md5('9:' || vec_id || ':' || axis), 1, 8))::ubigint/4294967296.0 as u from embeddings, x where axis <> 'i' or vec_id % 5 <> 0),
 h as (select *, sum(p) over (partition by vec_id, axis order by point) as hi, sum(p) over (partition by vec_id, axis) as t from w),
 k as (select *, ceil(round(hi/t*n, 9) - u) - ceil(round((hi - p)/t*n, 9) - u) as count from h),
 z as (select vec_id, axis, point, count/(p/t*n) as weight from k where count > 0 union all select vec_id, 'i', i, 1.0 from embeddings, (select unnest(range({N_I}))::int as i) where vec_id % 5 = 0),
 d as (select vec_id, label, i, c, embedding[(c + i) % {N_C} + 1]::double as dr, embedding[(c + i) % {N_C} + {N_C + 1}]::double as di, 1/(1 + 0.02*((c + i) % {N_C})*(1 + label % 3))::double as o from embeddings, (select unnest(range({N_C})) as c), (select unnest(range({N_I})) as i)),
 b as (select r, s, c, sin(1 + r + c) as pr, cos(r*c + 1) as pi, cos(0.1*s*c) as sr, sin(0.1*s*c) as si from (select unnest(range({N_R})) as r), (select unnest(range({N_S})) as s), (select unnest(range({N_C})) as c)),
 g as (select r.vec_id, r.point as r, i.point as i, s.point as s, -ln({N_R}) - ln({N_I}) + 0.01*i.point - ln({N_S}) + ln(r.weight) + ln(i.weight) + ln(s.weight) as lw from z r join z i on r.vec_id = i.vec_id and r.axis = 'r' and i.axis = 'i' join z s on r.vec_id = s.vec_id and s.axis = 's'),
 e as (select g.vec_id, g.r, g.i, g.s, first(lw) - sum(power(o*(pr*sr - pi*si) - dr, 2) + power(o*(pr*si + pi*sr) - di, 2))/(2*{SIGMA2}) as e from g join d on g.vec_id = d.vec_id and g.i = d.i join b on g.r = b.r and g.s = b.s and d.c = b.c group by all),
 m as (select *, max(e) over (partition by vec_id) as m from e),
 l as (select vec_id, -(first(m) + ln(sum(exp(e - m)))) as nll, count(distinct r) as n_r, count(distinct i) as n_i, count(distinct s) as n_s from m group by 1),
 q as (select e.vec_id, r, i, s, exp(e + nll) as q from e join l using (vec_id))"""


@query(f"{SAMPLES} select vec_id, round(nll, 6) as nll, n_r::int as n_r, n_i::int as n_i, n_s::int as n_s from l")
def sampled_likelihood(spark, d):
    found = estep.e_step(sampled_images(spark, d), "vec_id", domain())
    return found.select("vec_id", F.round("nll", 6).alias("nll"), "n_r", "n_i", "n_s")


@query(f"""{SAMPLES}, f as (select vec_id, 'r' as axis, r as point, sum(q) as f from q group by all union all select vec_id, 'i', i, sum(q) from q group by all union all select vec_id, 's', s, sum(q) from q group by all),
 v as (select vec_id, axis, point, f/weight as v from f join z using (vec_id, axis, point))
 select vec_id, axis, point, round(v/sum(v) over (partition by vec_id, axis), 6) as p from v""")
def sampled_posterior(spark, d):
    """What the sampler's state holds of each image after the step, freed of the weights of the draws."""
    images = sampled_images(spark, d)
    rows = estep.posteriors(estep.e_step(images, "vec_id", domain()), images, "vec_id")
    state = sampler_state.record_update(rows.select(F.struct("vec_id", "axis").alias("image"), "point", "value", "weight"), log=True)
    return state.select("image.vec_id", "image.axis", "point", F.round("p", 6).alias("p"))


@query(f"""{SAMPLES} select r::int as r, b.c::int as c, round(sum(q*(o*o*pr - o*(dr*sr + di*si))/{SIGMA2}), 4) as re, round(sum(q*(o*o*pi - o*(di*sr - dr*si))/{SIGMA2}), 4) as im
 from q join d using (vec_id, i) join b using (r, s, c) group by all""")
def sampled_gradient(spark, d):
    """The gradient by the slices, one sum over all images."""
    sums = estep.e_step_sums(sampled_images(spark, d), "vec_id", domain(), block=16).where("what = 'gradient'")
    rows = blocks.elements(sums, [], ["re", "im"], 16)
    return rows.select(F.floor(F.col("at") / N_C).cast("int").alias("r"), (F.col("at") % N_C).cast("int").alias("c"), F.round("re", 4).alias("re"), F.round("im", 4).alias("im"))


@query("select label, i as at, round(sum(embedding[i + 1]::double), 5) as total from embeddings, (select unnest(range(64))::int as i) group by all")
def label_sums(spark, d):
    """Sums of whole vectors by label, in blocks of 24 elements."""
    sums = blocks.sum_arrays(table(spark, d, "embeddings").withColumnRenamed("embedding", "total"), ["label"], ["total"], 24)
    return blocks.elements(sums, ["label"], ["total"], 24).withColumn("total", F.round("total", 5))


#: Minibatches of images by id, the one of the step, its rate; parts of 16 coordinates.
N_B, NOW, RATE, SIZE = 5, 3, 0.5, 16
STEP = f"""with e as (select vec_id % {N_B} as b, i, embedding[i + 1]::double as v from embeddings, (select unnest(range(64)) as i)),
 m as (select b, i, avg(v) as m, count(*) as c from e group by all), x as (select i, m as x from m where b = 0),
 g0 as (select b, i, -m*(1 + i)/8.0 as g, power(0.9::double, {N_B} - 1 - b) as w from m),
 f as (select i, (x - m)*(1 + i)/8.0 as g from m join x using (i) where b = {NOW}),
 g1 as (select b, i, g, 0.9::double*w as w from g0 where b <> {NOW} union all select {NOW}, i, g, 1.0 from f),
 a0 as (select i, sum(g*w)/sum(w) as a from g0 group by 1), a1 as (select i, sum(g*w)/sum(w) as a, sum(g*g*w)/sum(w) as q, sum(w) as w from g1 group by 1),
 h as (select i, ((avg(q) over ())*10 + q*w)/(w + 10) as h from a1), k as (select i, greatest((min(h) over ()), (max(h) over ())/1000) as least, h from h)"""


def _gradients(spark, d):
    """A separable quadratic whose coordinates are curved by 1/8 to 8: minibatch means, the gradients at 0 and x, the prior's at x."""
    rows = table(spark, d, "embeddings").select((F.col("vec_id") % N_B).cast("int").alias("batch"), F.posexplode("embedding").alias("i", "v"))
    means = rows.groupBy("batch", F.floor(F.col("i") / SIZE).cast("int").alias("part"), "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    packed = means.groupBy("batch", "part").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("m"))
    curve = lambda c, part: F.transform(c, lambda v, k: v * (1 + k + part * SIZE) / 8.0)
    x = packed.where("batch = 0").select("part", F.col("m").alias("x"))
    at_zero = packed.select("batch", "part", curve(F.transform("m", lambda v: -v), F.col("part")).alias("g"), F.pow(F.lit(0.9), N_B - 1 - F.col("batch")).alias("weight"))
    fresh = packed.where(F.col("batch") == NOW).join(x, "part").select("part", curve(F.zip_with("x", "m", lambda a, b: a - b), F.col("part")).alias("g"))
    return x, at_zero, fresh, x.select("part", F.transform("x", lambda v: v / 4.0).alias("p"))


def _moved(x):
    return x.select("part", F.posexplode("x").alias("k", "x")).select((F.col("part") * SIZE + F.col("k")).cast("int").alias("i"), F.round("x", 7).alias("x"))


@query(f"{STEP} select i::int as i, round(x - {RATE}*(least/greatest(least, h))*(a0.a + f.g - g0.g + x/4), 7) as x from x join a0 using (i) join f using (i) join g0 using (i) join k using (i) where g0.b = {NOW}")
def saga_step(spark, d):
    x, latest, fresh, prior = _gradients(spark, d)
    return _moved(descent.descend(x, latest, fresh, NOW, prior, RATE, 0.9))


@query(f"{STEP} select i::int as i, round(x - {RATE}*(a1.a + x/4), 7) as x from x join a1 using (i)")
def average_gradient_step(spark, d):
    x, latest, fresh, prior = _gradients(spark, d)
    return _moved(descent.descend(x, latest, fresh, NOW, prior, RATE, 0.9, saga=False, precondition=False))


@query("""with a as (select l_orderkey as r, l_partkey as c, l_quantity as v from lineitem), y as (select r, sum(v*p_retailprice) as y from a join part on c = p_partkey group by 1), z as (select c, sum(v*y) as z from a join y using (r) group by 1)
 select 'y' as side, r as at, round(y, 2) as value from y where y <> 0 union all select 'z', c, round(z, 2) from z where z <> 0""")
def tiled_products(spark, d):
    """Orders by parts in tiles, times the prices, and the transposed matrix times the result: the tiles stay where they are."""
    matrix = tiles.tiled(table(spark, d, "lineitem"), "l_orderkey", "l_partkey", "l_quantity", cells=100_000)
    y = matrix.times(tiles.to_blocks(table(spark, d, "part"), "p_partkey", ["p_retailprice"]), ["p_retailprice"])
    z = matrix.transposed_times(y, ["p_retailprice"])
    rows = tiles.from_blocks(y, ["p_retailprice"]).select(F.lit("y").alias("side"), "at", F.round("p_retailprice", 2).alias("value"))
    other = tiles.from_blocks(z, ["p_retailprice"]).select(F.lit("z").alias("side"), "at", F.round("p_retailprice", 2).alias("value"))
    return rows.unionByName(other).where("value != 0")


RING = "floor(sqrt(x*x + y*y))::int"
HISTORY = f"""with px as (select vec_id % 2 as run, vec_id // 2 % 4 as batch, i // 8 - 4 as x, i % 8 - 4 as y, embedding[i + 1]::double as v, embedding[(i + 1) % 64 + 1]::double as u from embeddings, (select unnest(range(64)) as i)),
 b as (select run, batch, x, y, avg(v*v) as error, avg(v*u) as corr, avg(u*u) as power from px group by all),
 h as (select run, batch, x, y, case when batch % 2 = 0 then 0.5 else 1 end::double as k, case when x*x + y*y < case when batch % 2 = 0 then 16 else 9 end then 1.0 else 0.0 end as mask, error, corr, power from b),
 m as (select run, x, y, avg(k*error) as error, avg(k*corr) as corr, avg(k*power) as power, avg(mask) as mask from h group by all),
 l as (select *, {RING} as lo, sqrt(x*x + y*y) - {RING} as f from m),
 s as (select run, lo as bin, 1 - f as w, * exclude (run, lo, f) from l where lo + 1 < 6 union all select run, lo + 1, f, * exclude (run, lo, f) from l where lo + 1 < 6),
 p as (select run, bin, sum(w*error)/sum(w) as error, sum(w*corr)/sum(w) as corr, sum(w*power)/sum(w) as power, sum(w*mask) as mask from s group by all),
 r as (select l.run, l.x, l.y, (1 - f)*a.error + f*b.error as error, (1 - f)*a.corr + f*b.corr as corr, (1 - f)*a.power + f*b.power as power, (1 - f)*a.mask + f*b.mask as mask
       from l join p a on a.run = l.run and a.bin = least(lo, 5) join p b on b.run = l.run and b.bin = least(least(lo, 5) + 1, 5)),
 n as (select *, (error*mask*4*25 + 30*0.02)/(mask*4*25 + 30) as noise from r)"""


def _history(spark, d):
    """Two generations: all minibatches within radius 3, then the even ones within radius 4 with halved sums."""
    e = table(spark, d, "embeddings").withColumn("other", F.concat(F.slice("embedding", 2, 63), F.slice("embedding", 1, 1)))
    cells = e.select((F.col("vec_id") % 2).alias("run"), (F.floor(F.col("vec_id") / 2) % 4).alias("batch"), F.posexplode(F.arrays_zip("embedding", "other")).alias("i", "p"))
    cells = cells.select("run", "batch", (F.floor(F.col("i") / 8) - 4).alias("x"), (F.col("i") % 8 - 4).alias("y"), F.col("p.embedding").cast("double").alias("v"), F.col("p.other").cast("double").alias("u"))
    first = cells.groupBy("run", "batch", "x", "y").agg(F.avg(F.col("v") * F.col("v")).alias("error"), F.avg(F.col("v") * F.col("u")).alias("corr"), F.avg(F.col("u") * F.col("u")).alias("power"))
    inside = lambda r: ((F.col("x") * F.col("x") + F.col("y") * F.col("y")) < r * r).cast("double").alias("mask")
    again = first.where("batch % 2 = 0").select("run", F.lit(1).alias("gen"), "batch", "x", "y", *[(0.5 * F.col(k)).alias(k) for k in histories.SUMS[:3]], inside(4))
    return first.select("run", F.lit(0).alias("gen"), "batch", "x", "y", *histories.SUMS[:3], inside(3)).unionByName(again)


@query(f"""{HISTORY} select run, x, y, round(noise, 7) as noise, round(least(greatest(case when x*x + y*y < 2 then 1 else (corr*mask*4*25/noise + exp(-(x*x + y*y)/40.0)*50)/(power*mask*4*25/noise + 50) end, 0.05), 0.9), 6) as envelope from n""")
def noise_history(spark, d):
    r2 = F.col("x") * F.col("x") + F.col("y") * F.col("y")
    found = histories.noise_and_envelope(_history(spark, d), 8, 25.0, 0.02, 30.0, 50.0, F.exp(-r2 / 40.0), 0.05, 0.9, r2 < 2)
    return found.select("run", "x", "y", F.round("noise", 7).alias("noise"), F.round("envelope", 6).alias("envelope"))


@query(f"{HISTORY}, w as (select run, avg((error*mask*4*25 + 30*0.02)/(mask*4*25 + 30)) as noise from m group by 1) select run, x, y, round(noise, 7) as noise, round((corr*mask*4*25/noise + 50)/(power*mask*4*25/noise + 50), 6) as envelope from m join w using (run)")
def white_noise_history(spark, d):
    """Noise of one colour, frequency by frequency without rings."""
    found = histories.noise_and_envelope(_history(spark, d), 8, 25.0, 0.02, 30.0, 50.0, white=True, rotational=False)
    return found.select("run", "x", "y", F.round("noise", 7).alias("noise"), F.round("envelope", 6).alias("envelope"))


@query(f"""{SAMPLES}, o as (select q.vec_id, sum(q*(power(d.o*(b.pr*b.sr - b.pi*b.si) - d.dr, 2) + power(d.o*(b.pr*b.si + b.pi*b.sr) - d.di, 2))) as error, sum(q*d.o*d.o*(b.pr*b.pr + b.pi*b.pi)) as power from q join d using (vec_id, i) join b on q.r = b.r and q.s = b.s and d.c = b.c group by 1),
 fr as (select vec_id, 1/sum(f*f) as ess from (select vec_id, sum(q) as f from q group by vec_id, r) group by 1), fi as (select vec_id, 1/sum(f*f) as ess from (select vec_id, sum(q) as f from q group by vec_id, i) group by 1), fs as (select vec_id, 1/sum(f*f) as ess from (select vec_id, sum(q) as f from q group by vec_id, s) group by 1)
 select l.vec_id % 3 as batch, count(*) as n, round(avg(nll), 5) as like, round(sqrt(avg(error))/(8*sqrt(0.5::double)), 6) as rmse, round(sqrt(avg(power))/(8*sqrt(0.5::double)), 6) as signal, round(avg(fr.ess), 5) as ess_r, round(avg(fi.ess), 5) as ess_i, round(avg(fs.ess), 5) as ess_s,
  round(count(*)/sum(n_r/{N_R}), 6) as speed_r, round(count(*)/sum(n_i/{N_I}), 6) as speed_i, round(count(*)/sum(n_s/{N_S}), 6) as speed_s, round(count(*)/sum(n_r/{N_R}*n_i/{N_I}*n_s/{N_S}), 6) as speed_total
 from l join o using (vec_id) join fr using (vec_id) join fi using (vec_id) join fs using (vec_id) group by 1""")
def sampling_report(spark, d):
    """Likelihood, error, effective sizes and speed-ups of each minibatch."""
    found = estep.e_step(sampled_images(spark, d), "vec_id", domain()).withColumn("batch", F.col("vec_id") % 3)
    out = estep.report(found, ["batch"], {"r": N_R, "i": N_I, "s": N_S}, 0.5, 8)
    return out.select("batch", "n", *[F.round(c, 5).alias(c) for c in ("like", "ess_r", "ess_i", "ess_s")], *[F.round(c, 6).alias(c) for c in ("rmse", "signal", "speed_r", "speed_i", "speed_s", "speed_total")])


@query("""with p as (select vec_id, i, (i // 8 - 4)*(i // 8 - 4) + (i % 8 - 4)*(i % 8 - 4) as r2, embedding[i + 1]::double as re, embedding[(i + 1) % 64 + 1]::double as im, 1 + label as o from embeddings, (select unnest(range(64)) as i)),
 s as (select vec_id, count(*) filter (r2 < 9) as n_used, sum(re*re + im*im) filter (r2 >= 9) as outside, sum(o*exp(-125.0*r2/power(2.8*8, 2))) filter (r2 < 9) as passed, sum((i + 1)*re) filter (r2 < 9) as kept from p group by 1)
 select vec_id, n_used::int as n_used, round(outside, 6) as outside, round(outside/(2*0.02) + n_used/2*ln(2*pi()*0.015) + (64 - n_used)/2*ln(2*pi()*0.02), 5) as "constant", round(passed, 6) as passed, round(kept, 6) as kept from s""")
def kernel_preparation(spark, d):
    """Truncation, envelope and constants of each image's likelihood; sums of what stays."""
    e = table(spark, d, "embeddings")
    whole = F.transform("embedding", lambda v: v.cast("double"))
    images = e.select("vec_id", whole.alias("re"), F.concat(F.slice(whole, 2, 63), F.slice(whole, 1, 1)).alias("im"), F.transform("embedding", lambda v: (1.0 + F.col("label"))).alias("optics"))
    out = estep.prepare(images, "vec_id", 8, 0.75, 0.015, 0.02, 2.8, 500.0)
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    return out.select("vec_id", "n_used", F.round("outside", 6).alias("outside"), F.round("constant", 5).alias("constant"), F.round(add(F.col("optics")), 6).alias("passed"), F.round(add(F.zip_with("at", "re", lambda i, v: (i + 1) * v)), 6).alias("kept"))
