"""Queries over voxels, shells and resolution curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from orientlake.fourier import shells as V
from orientlake.functions import optics as O
from orientlake.plans import fixtures as fx
from orientlake.plans.registry import ORACLES, query
from orientlake.session import new_dir
from orientlake.sources.metrics import write_table_csv

SIDE = 8
QUAD_SQL = """quads as (select vol_id // 4 as q, z, y, x, max(case when vol_id % 4 = 0 then v end) as re1, max(case when vol_id % 4 = 1 then v end) as im1,
 max(case when vol_id % 4 = 2 then v end) as re2, max(case when vol_id % 4 = 3 then v end) as im2 from voxels
 where vol_id // 4 in (select vol_id // 4 from voxels group by 1 having count(*) = 2048) group by 1, 2, 3, 4)"""
R3 = "sqrt(cast((z - 4) * (z - 4) + (y - 4) * (y - 4) + (x - 4) * (x - 4) as double))"
SHELL = f"case when {R3} = 3.5 then 3 else floor({R3} + 0.5) end"
SH_SQL = f"sh as (select *, cast({SHELL} as bigint) as shell from quads where {SHELL} between 1 and 3)"
FSC_SQL = "fs as (select q, shell, sum(re1 * re2 + im1 * im2) / sqrt(greatest(sum(re1 * re1 + im1 * im1) * sum(re2 * re2 + im2 * im2), 1e-9)) as fsc from sh group by 1, 2)"


def quads(spark, sf):
    """Four volumes read as two complex Fourier maps."""
    v = fx.voxels(spark, sf).withColumn("q", F.expr("vol_id div 4"))
    full = v.select("q", "vol_id").distinct().groupBy("q").count().where("count = 4").select("q")
    at = lambda i: F.max(F.when(F.col("vol_id") % 4 == i, F.col("v")))
    return v.join(full, "q", "left_semi").groupBy("q", "z", "y", "x").agg(
        at(0).alias("re1"), at(1).alias("im1"), at(2).alias("re2"), at(3).alias("im2"))


@query("fsc", fx.sql_with("voxels", QUAD_SQL, SH_SQL, FSC_SQL, body="select q, shell, round(fsc, 6) + 0.0 as fsc from fs"))
def fsc(spark, sf):
    return V.shell_correlation(quads(spark, sf), SIDE, ["q"]).select("q", "shell", (F.round("fsc", 6) + F.lit(0.0)).alias("fsc"))


@query("curve_csv", ORACLES["fsc"])
def curve_csv(spark, sf):
    """The curves written as CSV with a fixed header, and read back by it."""
    path = new_dir(spark, "curves")
    write_table_csv(fsc(spark, sf), path, ["q", "shell", "fsc"], ["q", "shell"])
    return spark.read.option("header", True).schema("q bigint, shell bigint, fsc double").csv(path)


@query("shell_amplitude", fx.sql_with("voxels", QUAD_SQL, SH_SQL, body="""
select q, shell, round(avg(sqrt(re1 * re1 + im1 * im1)), 6) as amplitude from sh group by 1, 2"""))
def shell_amplitude(spark, sf):
    return V.shell_amplitude(quads(spark, sf), SIDE, ["q"]).withColumn("amplitude", F.round("amplitude", 6))


HALF_PLANE = "hp as (select *, cast(floor(sqrt(cast((z - 4) * (z - 4) + (y - 4) * (y - 4) + x * x as double))) as bigint) as shell from voxels where x <= 4)"


@query("radial_average", fx.sql_with("voxels", HALF_PLANE, body="""
select vol_id, z, y, x, shell, round(avg(v) over (partition by vol_id, shell), 6) + 0.0 as mean from hp"""))
def radial_average(spark, sf):
    h = fx.voxels(spark, sf).where("x <= 4")
    return V.with_shell_average(h, SIDE, ["vol_id"], "v", "mean").select(
        "vol_id", "z", "y", "x", "shell", (F.round("mean", 6) + F.lit(0.0)).alias("mean"))


@query("otsu", fx.sql_with("voxels", body="""
, r as (select vol_id, min(v) as lo, max(v) as hi from voxels group by 1),
h as (select vol_id, lo, hi, cast(least(floor((v - lo) / ((hi - lo) / 256)), 255) as bigint) as bin, count(*) as n from voxels join r using (vol_id) group by 1, 2, 3, 4),
c as (select *, lo + (bin + 0.5) * ((hi - lo) / 256) as c from h),
w as (select *, sum(n) over (partition by vol_id order by bin) / sum(n) over (partition by vol_id) as w0,
 sum(n * c) over (partition by vol_id order by bin) / sum(n) over (partition by vol_id) as m0, sum(n * c) over (partition by vol_id) / sum(n) over (partition by vol_id) as mt from c),
s as (select *, case when w0 >= 1e-10 and 1 - w0 >= 1e-10 then round(w0 * (1 - w0) * pow(m0 / w0 - (mt - m0) / (1 - w0), 2), 12) end as var from w)
select vol_id, round(c, 6) + 0.0 as threshold from (select *, row_number() over (partition by vol_id order by var desc nulls last, bin) as k from s) q where k = 1"""))
def otsu(spark, sf):
    return V.otsu(fx.voxels(spark, sf), ["vol_id"], "v").select("vol_id", (F.round("threshold", 6) + F.lit(0.0)).alias("threshold"))


# --- curves: each embedding as a falling curve of 64 shells with its own noise ---------------

CURVES = """curves as (select vec_id, cast(i as bigint) as shell, 1 - i / 40.0 + cast(embedding[i] as double) as fsc, 128.0 / i as res, i / 128.0 as s,
 exp(2.0 - 5.0 * (i / 128.0) * (i / 128.0)) * (1 + abs(cast(embedding[i] as double)) / 10) as amplitude from (select vec_id, embedding, unnest(range(1, 65)) as i from embeddings) u)"""


def curves(spark, sf):
    c = fx.table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "e"))
    return c.selectExpr("vec_id", "cast(i + 1 as bigint) as shell", "1 - (i + 1) / cast(40 as double) + cast(e as double) as fsc",
                        "cast(128 as double) / (i + 1) as res", "(i + 1) / cast(128 as double) as s", "cast(e as double) as e").withColumn(
        "amplitude", F.exp(F.lit(2.0) - F.lit(5.0) * F.col("s") * F.col("s")) * (F.lit(1.0) + F.abs("e") / 10)).drop("e")


def _crossing_sql(level):
    return f"""(select vec_id, min(shell) as at_shell, round(arg_min(case when f0 - fsc > 1e-10 then r0 + (f0 - {level}) / (f0 - fsc) * (res - r0) else res end, shell), 6) as resolution
 from w where fsc < {level} - 1e-3 and f0 >= {level} - 1e-3 and (res <= 15 or (n3 = 3 and top < {level} - 1e-3)) group by vec_id)"""


@query("fsc_resolution", fx.sql_with(CURVES, """w as (select *, lag(fsc) over o as f0, lag(res) over o as r0, max(fsc) over p as top, count(*) over p as n3 from curves
 window o as (partition by vec_id order by shell), p as (partition by vec_id order by shell rows between current row and 2 following))""", body=f"""
select v.vec_id, a.resolution as res_05, a.at_shell as shell_05, b.resolution as res_0143, b.at_shell as shell_0143 from embeddings v
 left join {_crossing_sql(0.5)} a on a.vec_id = v.vec_id left join {_crossing_sql(0.143)} b on b.vec_id = v.vec_id"""))
def fsc_resolution(spark, sf):
    c = curves(spark, sf)
    out = None
    for level, tag in ((0.5, "05"), (0.143, "0143")):
        r = V.first_crossing(c, "vec_id", level).select("vec_id", F.round("resolution", 6).alias(f"res_{tag}"), F.col("at_shell").alias(f"shell_{tag}"))
        out = r if out is None else out.join(r, "vec_id")
    return out


@query("first_below", fx.sql_with(CURVES, body="""
select vec_id, coalesce(min(case when fsc < 0.8 then shell end), max(shell)) as at_shell from curves group by 1"""))
def first_below(spark, sf):
    return V.first_below(curves(spark, sf), "vec_id", 0.8)


@query("fsc_corrected", fx.sql_with(CURVES, "st as (select vec_id, coalesce(min(case when fsc < 0.8 then shell end), max(shell)) as start from curves group by 1)", body="""
select vec_id, shell, round(greatest(-0.1, least(1.0, case when shell >= start then (fsc - rnd) / (1.0 - rnd + 1e-6) else fsc end)), 6) + 0.0 as corrected
from (select vec_id, shell, fsc, (fsc - 0.5) / 4 as rnd from curves) c join st using (vec_id)"""))
def fsc_corrected(spark, sf):
    c = curves(spark, sf)
    start = V.first_below(c, "vec_id", 0.8)
    return c.join(start, "vec_id").select("vec_id", "shell", (F.round(V.corrected_fsc(
        F.col("fsc"), (F.col("fsc") - 0.5) / 4, F.col("shell"), F.col("at_shell")), 6) + F.lit(0.0)).alias("corrected"))


@query("guinier_points", fx.sql_with(CURVES, body="""
select vec_id, shell, round(s * s, 8) as s2, round(ln(amplitude), 6) + 0.0 as ln_amplitude from curves where s >= 1 / 10.0 and s <= 1 / 3.2 and amplitude > 0"""))
def guinier_points(spark, sf):
    return V.guinier_points(curves(spark, sf), 10.0, 3.2).select("vec_id", "shell", F.round("s2", 8).alias("s2"), (F.round("ln_amplitude", 6) + F.lit(0.0)).alias("ln_amplitude"))


@query("guinier_bfactor", fx.sql_with(CURVES, """st as (select vec_id, min(case when s >= 0.1 and s <= 0.5 and fsc < 1e-4 then shell end) as stop,
 min(case when s >= 0.1 and s <= 0.5 and fsc < 1e-4 then s end) as cut from curves group by 1)""",
    """u as (select c.vec_id, s * s as x, ln(amplitude * sqrt(2 * least(1.0, fsc) / (1 + least(1.0, fsc) + 1e-9))) as y
 from curves c join st using (vec_id) where s >= 0.1 and s <= 0.5 and (stop is null or shell < stop) and fsc > 0)""",
    "f as (select vec_id, count(*) as n, regr_slope(y, x) as a, regr_intercept(y, x) as b, regr_r2(y, x) as r from u group by 1)", body="""
select st.vec_id, coalesce(n, 0) as n_shells, round(case when n >= 3 then 4 * a else 0.0 end, 4) + 0.0 as bfactor, round(case when n >= 3 then b else 0.0 end, 4) + 0.0 as intercept,
 round(case when n >= 3 then r else 0.0 end, 4) + 0.0 as r2, round(1 / cut, 4) as cutoff from st left join f using (vec_id)"""))
def guinier_bfactor(spark, sf):
    g = V.guinier_bfactor(curves(spark, sf), "vec_id", 1.0)
    return g.select("vec_id", "n_shells", *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("bfactor", "intercept", "r2")], F.round("cutoff", 4).alias("cutoff"))


# --- gains on voxel rows -----------------------------------------------------------------------

DIST = "sqrt((z - 4.0) * (z - 4.0) + (y - 4.0) * (y - 4.0) + (x - 4.0) * (x - 4.0))"
MASK = f"case when {DIST} <= 2.0 then 1.0 when {DIST} >= 4.0 then 0.0 else 0.5 + 0.5 * cos(pi() * ({DIST} - 2.0) / 2.0) end"


def mask_column():
    return O.soft_sphere(F.col("z"), F.col("y"), F.col("x"), SIDE, 2.0, 2.0)


@query("soft_mask", fx.sql_with("voxels", body=f"select vol_id, z, y, x, round(v * ({MASK}), 6) + 0.0 as masked from voxels"))
def soft_mask(spark, sf):
    return fx.voxels(spark, sf).select("vol_id", "z", "y", "x", (F.round(F.col("v") * mask_column(), 6) + F.lit(0.0)).alias("masked"))


def _sinc_sql(a):
    t = f"(pi() * ({a} - 3.5) / 8.0)"
    return f"pow(sin({t}) / {t}, 2)"


@query("sinc2", fx.sql_with("voxels", body=f"""
select vol_id, z, y, x, round(v / greatest({_sinc_sql('z')} * {_sinc_sql('y')} * {_sinc_sql('x')}, 1e-3), 6) + 0.0 as flat from voxels"""))
def sinc2(spark, sf):
    gain = O.gridding_gain(F.col("z"), F.col("y"), F.col("x"), SIDE)
    return fx.voxels(spark, sf).select("vol_id", "z", "y", "x", (F.round(F.col("v") / gain, 6) + F.lit(0.0)).alias("flat"))


@query("lowpass_gain", fx.sql_with("voxels", QUAD_SQL, body=f"""
, r as (select *, {R3} / 8.0 as r from quads), g as (select *, case when r < 0.25 then 1.0 when r > 0.35 then 0.0 else (cos(pi() * (r - 0.25) / 0.1) + 1) / 2 end as g from r)
select q, z, y, x, round(re1 * g, 6) + 0.0 as re, round(im1 * g, 6) + 0.0 as im from g"""))
def lowpass_gain(spark, sf):
    g = O.raised_cosine_gain(V.radius(SIDE) / float(SIDE), 0.25, 0.1)
    return quads(spark, sf).withColumn("g", g).select("q", "z", "y", "x", *[
        (F.round(F.col(c) * F.col("g"), 6) + F.lit(0.0)).alias(n) for c, n in (("re1", "re"), ("im1", "im"))])


@query("mask_volume", fx.sql_with("voxels", body=f"""
, m as (select *, {MASK} as m from voxels), b as (select vol_id, coalesce(avg(v) filter (where m > 0 and m < 1), avg(v) filter (where m = 0), 0.0) as bg from m group by 1)
select vol_id, z, y, x, round((v - bg) * m, 6) + 0.0 as v from m join b using (vol_id)"""))
def mask_volume(spark, sf):
    m = V.subtract_background(fx.voxels(spark, sf).withColumn("m", mask_column()), ["vol_id"], "v", "m", "out")
    return m.select("vol_id", "z", "y", "x", (F.round("out", 6) + F.lit(0.0)).alias("v"))


PHASE = "(((z * 8 + y) * 8 + x + 1) * 2654435761 % 4294967296) / cast(4294967296 as double) * 2 * pi()"


@query("randomize_phases", fx.sql_with("voxels", QUAD_SQL, body=f"""
select q, z, y, x, round(case when {R3} >= 1.5 then sqrt(re1 * re1 + im1 * im1) * cos({PHASE.replace('z *', 'cast(z as bigint) *')}) else re1 end, 6) + 0.0 as re,
 round(case when {R3} >= 1.5 then sqrt(re1 * re1 + im1 * im1) * sin({PHASE.replace('z *', 'cast(z as bigint) *')}) else im1 end, 6) + 0.0 as im from quads"""))
def randomize_phases(spark, sf):
    r = V.randomize_phases(quads(spark, sf), SIDE, F.lit(1.5), "re1", "im1")
    return r.select("q", "z", "y", "x", *[(F.round(c, 6) + F.lit(0.0)).alias(n) for c, n in (("re1", "re"), ("im1", "im"))])


@query("fourier_crop", fx.sql_with("voxels", QUAD_SQL, body="""
, pad as (select q, z, y, x from (select distinct q from quads) d, range(10) a(z), range(10) b(y), range(10) c(x))
select 6 as side, q, z - 1 as z, y - 1 as y, x - 1 as x, re1 as re, im1 as im from quads where z between 1 and 6 and y between 1 and 6 and x between 1 and 6
union all select 10, p.q, cast(p.z as int), cast(p.y as int), cast(p.x as int), coalesce(re1, 0.0), coalesce(im1, 0.0) from pad p
 left join quads k on k.q = p.q and k.z + 1 = p.z and k.y + 1 = p.y and k.x + 1 = p.x"""))
def fourier_crop(spark, sf):
    k = quads(spark, sf).select("q", "z", "y", "x", F.col("re1").alias("re"), F.col("im1").alias("im"))
    small = V.fourier_resize(k, ["q"], ["re", "im"], SIDE, 6).withColumn("side", F.lit(6))
    large = V.fourier_resize(k, ["q"], ["re", "im"], SIDE, 10).withColumn("side", F.lit(10))
    return small.unionByName(large)


ACC_SQL = """parts as (select vol_id // 4 as part, 1 + (vol_id // 4) % 2 as half, z, y, x, max(case when vol_id % 4 = 0 then v end) as re, max(case when vol_id % 4 = 1 then v end) as im,
 abs(max(case when vol_id % 4 = 2 then v end)) as w, pow(max(case when vol_id % 4 = 3 then v end), 2) as ctfsq from voxels
 where x <= 4 and vol_id // 4 in (select vol_id // 4 from voxels group by 1 having count(*) = 2048) group by 1, 2, 3, 4, 5)"""
SUM_SQL = "acc as (select half, z, y, x, sum(re) as re, sum(im) as im, sum(w) as w, sum(ctfsq) as ctfsq from parts group by 1, 2, 3, 4)"


def accumulators(spark, sf):
    """Each quad read as the partial accumulator of one worker and half."""
    return quads(spark, sf).where("x <= 4").selectExpr(
        "q as part", "1 + q % 2 as half", "z", "y", "x", "re1 as re", "im1 as im", "abs(re2) as w", "im2 * im2 as ctfsq")


@query("accum_merge", fx.sql_with("voxels", ACC_SQL, SUM_SQL, body="""
select half, z, y, x, round(re, 6) + 0.0 as re, round(im, 6) + 0.0 as im, round(w, 6) as w, round(ctfsq, 6) as ctfsq from acc"""))
def accum_merge(spark, sf):
    """Partials are written by half, as workers would append them, read back and summed."""
    from orientlake.session import new_dir
    path = new_dir(spark, "accumulators")
    accumulators(spark, sf).write.mode("append").partitionBy("half").parquet(path)
    stored = spark.read.parquet(path).withColumn("half", F.col("half").cast("bigint"))
    return V.merge_accumulators(stored).select("half", "z", "y", "x", *[
        (F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("re", "im", "w", "ctfsq")])


@query("normalize_voxels", fx.sql_with("voxels", ACC_SQL, SUM_SQL, body="""
, s as (select *, avg(ctfsq) over (partition by half, floor(sqrt(cast((z - 4) * (z - 4) + (y - 4) * (y - 4) + x * x as double)))) as mean from acc),
d as (select *, greatest(ctfsq, mean / 1000.0) as d1, ctfsq + 0.1 * w as d2 from s where w > 1e-6)
select half, z, y, x, round(re / greatest(d1, 1e-6), 4) + 0.0 as re, round(im / greatest(d1, 1e-6), 4) + 0.0 as im, round(re / greatest(d2, 1e-6), 4) + 0.0 as re_flat, round(re / w, 4) + 0.0 as re_noctf from d"""))
def normalize_voxels(spark, sf):
    acc = V.merge_accumulators(accumulators(spark, sf))
    key = ["half", "z", "y", "x"]
    a = V.normalize_voxels(acc, SIDE, ["half"]).select(*key, F.round("re", 4).alias("re"), F.round("im", 4).alias("im"))
    b = V.normalize_voxels(acc, SIDE, ["half"], eps=0.1).select(*key, F.round("re", 4).alias("re_flat"))
    c = V.normalize_voxels(acc, SIDE, ["half"], use_ctf=False).select(*key, F.round("re", 4).alias("re_noctf"))
    return a.join(b, key).join(c, key).select(*key, *[(F.col(n) + F.lit(0.0)).alias(n) for n in ("re", "im", "re_flat", "re_noctf")])


@query("sharpen_gain", fx.sql_with("voxels", QUAD_SQL, SH_SQL, FSC_SQL, body=f"""
, wt as (select q, shell, sqrt(2 * greatest(0.0, least(1.0, fsc)) / (1 + greatest(0.0, least(1.0, fsc)))) as w from fs),
p as (select *, {R3} as r, least(greatest({R3}, 1.0), 3.0) as c from quads),
g as (select p.q, z, y, x, re1, r, lo.w + (hi.w - lo.w) * (c - floor(c)) as w from p join wt lo on lo.q = p.q and lo.shell = floor(c)
 join wt hi on hi.q = p.q and hi.shell = least(floor(c) + 1, 3))
select q, z, y, x, round(case when r / 12.0 > 0.3 then 0.0 else w * exp(40.0 * (r / 12.0) * (r / 12.0) / 4) end, 6) + 0.0 as gain from g"""))
def sharpen_gain(spark, sf):
    k = quads(spark, sf)
    weights = V.fom_curve(V.shell_correlation(k, SIDE, ["q"]))
    g = V.sharpening_gain(k, weights, ["q"], SIDE, 1.5, F.lit(-40.0), F.lit(0.3))
    return g.select("q", "z", "y", "x", (F.round("gain", 6) + F.lit(0.0)).alias("gain"))
