"""Queries over images, projections and reconstructions."""

from __future__ import annotations

from pyspark.sql import functions as F

from orientlake.fourier import postprocess as P, shells as V
from orientlake.fourier.transform import transform3
from orientlake.functions import optics as O, rotations as R
from orientlake.images import jobs as J, kernels as K
from orientlake.plans import fixtures as fx
from orientlake.plans.poses import LAMBDA
from orientlake.plans.registry import query
from orientlake.plans.sqltext import ctf_sql
from orientlake.session import shuffle_width

SIDE = 8
CTF = ["defocus_u", "defocus_v", "defocus_ang", "kv", "cs", "w", "px"]


def posed(spark, sf):
    """Every particle with its optics and picture: the pictures are dealt to the particles in turn."""
    p = fx.particles(spark, sf).select("pid", "half", "optics_group", "rot", "tilt", "psi", "dx", "dy", "defocus_u", "defocus_v", "defocus_ang", "fom")
    im = fx.images(spark, sf).select("vec_id", F.col("pixels"))
    n = im.agg(F.count(F.lit(1))).scalar()
    # few bytes per image but much work: the kernels need many tasks, whatever the size of the table says; rows are dealt before they get their pictures
    rows = p.withColumn("vec_id", F.pmod(F.col("pid") - 1, n)).repartition(shuffle_width(spark), "pid")
    return rows.join(im, "vec_id").join(fx.optics(spark, sf).drop("box"), "optics_group")


def pixel_sums(df, col="pixels_out", digits=4):
    """Per particle the sum of all pixels, and two sums in which every pixel has a weight of its own."""
    def total(values):
        return F.round(F.reduce(values, F.lit(0.0), lambda t, v: t + v), digits) + F.lit(0.0)

    return df.select("pid", total(F.col(col)).alias("total"), total(F.transform(col, lambda v, i: v * (i + 1))).alias("by_place"),
                     total(F.transform(col, lambda v, i: v * ((i * 37) % 64))).alias("by_turn"))


def pixel_rows(df, col="pixels_out", digits=6):
    return df.select("vec_id", F.posexplode(col).alias("i", "v")).select("vec_id", "i", (F.round("v", digits) + F.lit(0.0)).alias("v"))


PIX = "px as (select vec_id, i - 1 as i, cast(embedding[i] as double) as v, sqrt(pow(-4.0 + 8.0 * ((i - 1) // 8) / 7, 2) + pow(-4.0 + 8.0 * ((i - 1) % 8) / 7, 2)) as r from (select vec_id, embedding, unnest(range(1, 65)) as i from embeddings) u)"


@query("normalize_noise", fx.sql_with(PIX, body="""
, s as (select vec_id, avg(v) as m, stddev_samp(v) as d from px where r > 3.2 group by 1)
select vec_id, cast(i as int) as i, round((v - m) / d, 4) + 0.0 as v from px join s using (vec_id)"""))
def normalize_noise(spark, sf):
    im = fx.images(spark, sf)
    out = J.map_images(im, ["vec_id"], {"pixels_out": J.ARRAY}, lambda c: {"pixels_out": K.normalize_background(J.stacked(c["pixels"]), 3.2)})
    return pixel_rows(out, digits=4)


@query("circular_mask", fx.sql_with(PIX, body="select vec_id, cast(i as int) as i, round(case when r > 3.2 then 0.0 else v end, 6) + 0.0 as v from px"))
def circular_mask(spark, sf):
    """Pixels outside the circle set to zero, in generated code."""
    outside = F.lit([bool(b) for b in K.outside_circle(SIDE, 3.2).ravel()]).cast("array<boolean>")
    m = fx.images(spark, sf).withColumn("pixels_out", F.transform("pixels", lambda v, i: F.when(F.get(outside, i), F.lit(0.0)).otherwise(v.cast("double"))))
    return pixel_rows(m)


POSED_SQL = """posed as (select pid, vec_id, half, optics_group, rot, tilt, psi, dx, dy, defocus_u, defocus_v, defocus_ang, fom, px, kv, cs, w
 from particles join optics using (optics_group) join (select vec_id, (select count(*) from embeddings) as n_images from embeddings) e on (pid - 1) % n_images = vec_id)"""


@query("ctf_image", fx.sql_with("particles", "optics", POSED_SQL, body=f"""
, f as (select posed.*, i, ((i // 5) - 4) / 8.0 / px as fy, (i % 5) / 8.0 / px as fx from posed, range(40) r(i))
select pid, round(sum(v), 4) + 0.0 as total, round(sum(v * (i + 1)), 4) + 0.0 as by_place, round(sum(v * ((i * 37) % 64)), 4) + 0.0 as by_turn
from (select pid, i, {ctf_sql(LAMBDA)} as v from f) group by 1"""))
def ctf_image(spark, sf):
    return pixel_sums(J.ctf_image(posed(spark, sf).select("pid", *CTF), ["pid"], SIDE), "ctf")


@query("phase_flip", fx.sql_with(PIX, "particles", "optics", POSED_SQL, body=f"""
, part as (select vec_id, ky, kx, case when kx in (0, 4) then 1 else 2 end * sum(v * cos(2 * pi() * (ky * (i // 8) + kx * (i % 8)) / 8.0)) as re,
 case when kx in (0, 4) then 1 else 2 end * -sum(v * sin(2 * pi() * (ky * (i // 8) + kx * (i % 8)) / 8.0)) as im from px, range(-4, 4) a(ky), range(5) b(kx) group by 1, 2, 3),
-- what one term of the transform adds to each weighted sum of pixels
term as (select ky, kx, sum(g * c) / 64 as c1, sum(g * s) / 64 as s1, sum(h * c) / 64 as c2, sum(h * s) / 64 as s2, sum(c) / 64 as c0, sum(s) / 64 as s0
 from (select ky, kx, i + 1 as g, (i * 37) % 64 as h, cos(2 * pi() * (ky * (i // 8) + kx * (i % 8)) / 8.0) as c, sin(2 * pi() * (ky * (i // 8) + kx * (i % 8)) / 8.0) as s
  from range(64) p(i), range(-4, 4) a(ky), range(5) b(kx)) group by 1, 2),
f as (select posed.*, ky, kx, ky / 8.0 / px as fy, kx / 8.0 / px as fx from posed, range(-4, 4) a(ky), range(5) b(kx)),
sign as (select pid, vec_id, ky, kx, sign({ctf_sql(LAMBDA)}) as t from f)
select pid, round(sum(t * (re * c0 - im * s0)), 4) + 0.0 as total, round(sum(t * (re * c1 - im * s1)), 4) + 0.0 as by_place, round(sum(t * (re * c2 - im * s2)), 4) + 0.0 as by_turn
from sign join part using (vec_id, ky, kx) join term using (ky, kx) group by 1"""))
def phase_flip(spark, sf):
    return pixel_sums(J.correct_ctf(posed(spark, sf).select("pid", "pixels", *CTF), ["pid"]))


@query("preprocess_images")
def preprocess_images(spark, sf):
    return pixel_sums(J.preprocess(posed(spark, sf).select("pid", "pixels", *CTF), ["pid"], 0.8, 12, radius=4.5))


def _spectrum_sql(value, name="ft"):
    """Plain transform of each 8 x 8 picture at every (ky, kx) from 0 to 7."""
    arg = "2 * pi() * (ky * (i // 8) + kx * (i % 8)) / 8.0"
    return f"""{name} as (select vec_id, ky, kx, sum(({value}) * cos({arg})) as re, -sum(({value}) * sin({arg})) as im
 from px, range(8) a(ky), range(8) b(kx) group by 1, 2, 3)"""


R_SQL = "sqrt(pow(case when ky < 4 then ky else ky - 8 end / 8.0, 2) + pow(case when kx < 4 then kx else kx - 8 end / 8.0, 2))"


@query("lowpass", fx.sql_with(PIX, _spectrum_sql("v"), body=f"""
, g as (select *, {R_SQL} as r from ft), h as (select vec_id, ky, kx, re, im, case when r < 0.25 then 1.0 when r > 0.35 then 0.0 else (cos(pi() * (r - 0.25) / 0.1) + 1) / 2 end as g from g)
select vec_id, cast(i as int) as i, round(sum(g * (re * cos(2 * pi() * (ky * (i // 8) + kx * (i % 8)) / 8.0) - im * sin(2 * pi() * (ky * (i // 8) + kx * (i % 8)) / 8.0))) / 64, 6) + 0.0 as v
from h, range(64) p(i) group by 1, 2"""))
def lowpass(spark, sf):
    return pixel_rows(J.low_pass(fx.images(spark, sf).select("vec_id", "pixels"), ["vec_id"], 0.25, 0.1))


SOFT_SQL = "(case when {d} <= 4 then 1.0 when {d} >= 4.2 then 0.0 else 0.5 * (1 + cos(pi() * ({d} - 4) / 0.2)) end)".format(
    d="sqrt(pow(i // 8 - 4, 2) + pow(i % 8 - 4, 2))")


@query("to_fourier", fx.sql_with(PIX, _spectrum_sql(f"v * (1 - {SOFT_SQL})"), _spectrum_sql(f"v * {SOFT_SQL}", "fm"), body=f"""
, amp as (select ky, kx, {R_SQL} <= 0.5 as band, avg(sqrt(re * re + im * im)) as a from ft where kx <= 4 group by 1, 2, 3),
white as (select ky, kx, case when band then 1 / (a + (select avg(a) * 1e-3 + 1e-8 from amp where band)) else 0 end as w from amp),
out as (select vec_id, cast((ky + 4) % 8 * 5 + kx as int) as i, case when ky = 0 and kx = 0 then 0 else w * case when (ky + kx) % 2 = 0 then 1 else -1 end end as t, re, im
 from fm join white using (ky, kx))
select vec_id, i, round(t * re, 6) + 0.0 as re, round(t * im, 6) + 0.0 as im from out"""))
def to_fourier(spark, sf):
    im = fx.images(spark, sf).select("vec_id", "pixels")
    whiten = J.whitening_map(J.noise_spectrum(im, SIDE), SIDE)
    f = J.to_fourier(im, ["vec_id"], whiten)
    return f.select("vec_id", F.posexplode(F.arrays_zip("re", "im")).alias("i", "p")).select(
        "vec_id", "i", (F.round("p.re", 6) + F.lit(0.0)).alias("re"), (F.round("p.im", 6) + F.lit(0.0)).alias("im"))


@query("noise_psd", fx.sql_with(PIX, _spectrum_sql(f"v * (1 - {SOFT_SQL})"), body="""
select cast((ky + 4) % 8 as int) as ky, cast(kx as int) as kx, round(avg(sqrt(re * re + im * im)), 6) as amplitude from ft where kx <= 4 group by 1, 2"""))
def noise_psd(spark, sf):
    return J.noise_spectrum(fx.images(spark, sf), SIDE).withColumn("amplitude", F.round("amplitude", 6))


@query("augment_images")
def augment_images(spark, sf):
    copies = posed(spark, sf).select("pid", "pixels", "psi").withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(4))))
    seeded = copies.withColumn("seed", (F.col("pid") * 4 + F.col("copy")) * F.lit(2654435761) % F.lit(4294967296))
    a = J.augment(seeded, ["pid", "copy"], 0.05)
    return a.select("pid", "copy", "turns", F.round("psi_out", 4).alias("psi"), F.round(F.reduce("pixels_out", F.lit(0.0), lambda t, v: t + v), 6).alias("total"))


def mean_volume(spark, sf):
    """The mean of all volumes as the reference; a missing plane counts as zero."""
    every = fx.table(spark, sf, "embeddings").select(F.expr("vec_id div 8").alias("vol_id"), F.expr("cast(vec_id % 8 as int)").alias("z"), F.posexplode("embedding").alias("i", "v"))
    n = fx.table(spark, sf, "embeddings").agg(F.count_distinct(F.expr("vec_id div 8"))).scalar()
    sums = every.groupBy("z", "i").agg((F.sum(F.col("v").cast("double")) / n).alias("v"))
    return J.share_reference(spark, J.load_volume(sums.selectExpr("z", "cast(i div 8 as int) as y", "cast(i % 8 as int) as x", "v"), SIDE))


@query("project_slices")
def project_slices(spark, sf):
    p = J.project(fx.particles(spark, sf).select("pid", "rot", "tilt", "psi"), ["pid"], mean_volume(spark, sf))
    power = F.reduce(F.zip_with("re", "im", lambda a, b: a * a + b * b), F.lit(0.0), lambda t, v: t + v)
    return p.select("pid", F.round(power, 6).alias("power"), F.round(F.get("re", F.lit(20)), 6).alias("centre"))


@query("match_projection")
def match_projection(spark, sf):
    """Each image against the reference at its own pose only."""
    m = J.match_to_reference(posed(spark, sf), ["pid"], mean_volume(spark, sf), distance=0.0, step=1.0, max_shift=0.5)
    return m.select("pid", F.round("corr_1", 6).alias("corr"), F.round("dx_1", 4).alias("dx"), F.round("dy_1", 4).alias("dy"))


def _best(m, k=1):
    return m.select("pid", *[F.round(f"{n}_{i + 1}", 4).alias(f"{n}_{i + 1}") for i in range(k) for n in ("corr", "rot", "tilt", "psi", "dx", "dy", "confidence")])


@query("projection_matching")
def projection_matching(spark, sf):
    """The two best of 27 candidate poses around that of each particle."""
    return _best(J.match_to_reference(posed(spark, sf), ["pid"], mean_volume(spark, sf), 4.0, 4.0, top_k=2, max_shift=0.5), 2)


@query("two_stage_search")
def two_stage_search(spark, sf):
    """The best of 27 candidate poses of each particle, and of a finer grid around every one of them."""
    return _best(J.match_to_reference(posed(spark, sf), ["pid"], mean_volume(spark, sf), 4.0, 4.0, max_shift=0.5, two_stage=True, fine=(2.0, 2.0), refine=True))


@query("backproject")
def backproject(spark, sf):
    """Images inserted with CTF, confidence and C2 copies."""
    acc = J.backproject(R.with_matrix(posed(spark, sf), "rot", "tilt", "psi", "r"), SIDE, True, "fom", symmetry="C2")
    return acc.select("half", "z", "y", "x", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("re", "im", "w", "ctfsq")])


@query("reconstruct")
def reconstruct(spark, sf):
    v = P.reconstruct(J.backproject(posed(spark, sf), SIDE, True, "fom"), SIDE)
    return v.withColumn("v", F.round("v", 6) + F.lit(0.0))


def _dft_sql():
    return """, w as (select vol_id, kz, ky, kx, sum(v * cos(2 * pi() * ((kz - 4) * z + (ky - 4) * y + (kx - 4) * x) / 8.0)) as re,
 sum(-v * sin(2 * pi() * ((kz - 4) * z + (ky - 4) * y + (kx - 4) * x) / 8.0)) as im from voxels, range(8) a(kz), range(8) b(ky), range(8) c(kx) group by 1, 2, 3, 4)
select vol_id, cast(kz as int) as z, cast(ky as int) as y, cast(kx as int) as x, round(re, 6) + 0.0 as re, round(im, 6) + 0.0 as im from w"""


@query("fft3", fx.sql_with("voxels", body=_dft_sql()))
def fft3(spark, sf):
    f = transform3(fx.voxels(spark, sf), ["vol_id"], SIDE, "forward", "v", None)
    return f.select("vol_id", "z", "y", "x", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("re", "im")])


def half_maps(spark, sf):
    """Volumes 2k and 2k + 1 as half maps of one structure, under a soft sphere."""
    v = fx.voxels(spark, sf)
    pair = v.select("vol_id").distinct().groupBy(F.expr("vol_id div 2").alias("q")).count().where("count = 2").select("q")
    z, y, x = (F.col(a) for a in "zyx")
    return v.selectExpr("vol_id div 2 as q", "cast(1 + vol_id % 2 as int) as map", "z", "y", "x", "v").join(pair, "q", "left_semi").withColumn(
        "mask", O.soft_sphere(z, y, x, SIDE, 2.0, 2.0))


def with_signal(spark, sf):
    """Half maps that share a structure: the mean of both plus a share of their difference."""
    m = half_maps(spark, sf)
    both = m.groupBy("q", "z", "y", "x").agg(F.avg("v").alias("c"))
    return m.join(both, ["q", "z", "y", "x"]).withColumn("v", F.col("c") + 0.4 * (F.col("v") - F.col("c"))).drop("c")


@query("gold_fsc")
def gold_fsc(spark, sf):
    c = P.gold_standard(with_signal(spark, sf), ["q"], SIDE, 1.5)
    return c.select("q", "shell", *[F.round(n, 6).alias(n) for n in ("s", "res", "unmasked", "masked", "randomized", "fsc")])


@query("postprocess")
def postprocess(spark, sf):
    sharp, _, summary = P.postprocess(with_signal(spark, sf), "q", SIDE, 1.5, guinier_lo=20.0)
    return sharp.groupBy("q").agg(F.count("v").alias("n"), F.round(F.sqrt(F.sum(F.col("v") * F.col("v"))), 6).alias("norm")).join(
        summary.select("q", F.round("bfactor", 3).alias("bfactor"), F.round("res_0143", 4).alias("res_0143"), F.round("lowpass", 4).alias("lowpass")), "q")
