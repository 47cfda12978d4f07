"""Queries over ranked candidates and grid look-ups."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from orientlake.functions import grids as G, gridtables as GT, rotations as R
from orientlake.images.jobs import map_images
from orientlake.operators import ranking as K
from orientlake.plans import fixtures as fx
from orientlake.plans.registry import query
from orientlake.plans.sqltext import SQL_MATRIX, grid_sql, normal_cdf_sql, ops_sql, trace_sql

LOGITS = "lg as (select vec_id, i - 1 as cand, cast(embedding[i] as double) as s from (select vec_id, embedding, unnest(range(1, 65)) as i from embeddings) u)"
#: One score per rotation of the smallest grid (72): the 64 values of a row, then its first eight again.
GRID_LOGITS = "lg as (select vec_id, i - 1 as cand, cast(embedding[(i - 1) % 64 + 1] as double) as s from (select vec_id, embedding, unnest(range(1, 73)) as i from embeddings) u)"
RANKED = "rk as (select *, row_number() over (partition by vec_id order by s desc, cand) as r from lg)"


def logits(spark, sf):
    return fx.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("logits"))


def grid_logits(spark, sf):
    return logits(spark, sf).withColumn("logits", F.concat("logits", F.slice("logits", 1, 8)))


@query("topk_poses", fx.sql_with(GRID_LOGITS, RANKED, f"grid as ({grid_sql(0)})", body="""
select vec_id, cast(r as int) as rank, cast(cand as int) as cand, round(s, 6) as score, round(g02, 6) + 0.0 as vx, round(g12, 6) + 0.0 as vy, round(g22, 6) + 0.0 as vz
from rk join grid on idx = cand where r <= 5"""))
def topk_poses(spark, sf):
    top = K.top_rows(grid_logits(spark, sf), "logits", 5)
    rot, tilt, psi = G.grid_angles(F.col("cand"), 0)
    posed = R.with_matrix(top.withColumns({"rot": rot, "tilt": tilt, "psi": psi}), "rot", "tilt", "psi", "g")
    return posed.select("vec_id", "rank", "cand", F.round("score", 6).alias("score"), *[
        (F.round(c, 6) + F.lit(0.0)).alias(n) for c, n in (("g02", "vx"), ("g12", "vy"), ("g22", "vz"))])


@query("topk_pivot", fx.sql_with(LOGITS, RANKED, body="""
select vec_id, """ + ", ".join(f"cast(max(case when r = {r} then cand end) as int) as cand{s}, round(max(case when r = {r} then s end), 6) as score{s}"
                               for r, s in ((1, ""), (2, "_top2"), (3, "_top3"))) + " from rk group by vec_id"))
def topk_pivot(spark, sf):
    w = K.spread_ranks(logits(spark, sf), "logits", 3)
    return w.select("vec_id", *[c for s in ("", "_top2", "_top3") for c in (F.col(f"cand{s}"), F.round(f"score{s}", 6).alias(f"score{s}"))])


EQ_SQL = (f"grid as ({grid_sql(0)})", f"ops as ({ops_sql(['C2'])})", """
tr as (select a.idx as i, o.op, g.idx as j, """ + " + ".join(f"(s{r}0*a.g0{c} + s{r}1*a.g1{c} + s{r}2*a.g2{c}) * g.g{r}{c}" for r in range(3) for c in range(3)) + """ as t
 from grid a cross join ops o cross join grid g),
eq as (select i, op, j from (select *, row_number() over (partition by i, op order by round(t, 9) desc, j) as k from tr) q where k = 1)""")


@query("grid_softmax", fx.sql_with(GRID_LOGITS, *EQ_SQL, body="""
, su as (select vec_id, eq.i as cand, sum(s) as s from eq join lg on lg.cand = eq.j group by 1, 2),
e as (select vec_id, cand, exp(s - max(s) over (partition by vec_id)) as e from su)
select vec_id, cast(cand as int) as cand, round(e / sum(e) over (partition by vec_id), 6) as p from e"""))
def grid_softmax(spark, sf):
    p = grid_logits(spark, sf).withColumn("p", K.softmax(K.symmetry_sum("logits", GT.equivalents(0, "C2").tolist())))
    return p.select("vec_id", F.posexplode("p").alias("cand", "v")).select(
        "vec_id", "cand", F.round("v", 6).alias("p"))


@query("top10_confidence", fx.sql_with(LOGITS, body="""
, e as (select vec_id, exp(8 * (s - max(s) over (partition by vec_id))) as e from lg), p as (select vec_id, e / sum(e) over (partition by vec_id) as p from e),
r as (select vec_id, p, row_number() over (partition by vec_id order by p desc) as k from p)
select vec_id, round(sum(p), 6) as confidence from r where k <= 10 group by vec_id"""))
def top10_confidence(spark, sf):
    p = logits(spark, sf).withColumn("p", K.softmax(F.transform("logits", lambda v: v.cast("double") * 8)))
    return p.select("vec_id", F.round(K.top_sum("p"), 6).alias("confidence"))


@query("corr_confidence", fx.sql_with(LOGITS, body=f"""
, w as (select vec_id, avg(s) as mean, stddev_samp(s) as std, max(s) as best from lg group by vec_id), z as (select *, (best - mean) / (std + 1e-6) as z from w)
select vec_id, round(mean, 6) + 0.0 as mean, round(std, 6) as std, round(best, 6) as best, round({normal_cdf_sql('z')}, 6) as confidence from z"""))
def corr_confidence(spark, sf):
    w = K.winner_statistics(logits(spark, sf), "logits")
    return w.select("vec_id", (F.round("mean", 6) + F.lit(0.0)).alias("mean"), *[F.round(c, 6).alias(c) for c in ("std", "best", "confidence")])


def _axis_sql(stride, tag):
    p, m, c = f"e[cast(w + {stride} + 1 as int)]", f"e[cast(w - {stride} + 1 as int)]", "e[w + 1]"
    bend = f"(2.0 * {m} - 4.0 * {c} + 2.0 * {p})"
    inside = f"(w // {stride}) % 4 > 0 and (w // {stride}) % 4 < 3 and {bend} < -1e-8"
    return f"round(case when {inside} then greatest(-1.0, least(1.0, ({m} - {p}) / {bend} * 2.0)) else 0.0 end, 6) + 0.0 as d{tag}"


@query("substep_refine", fx.sql_with(LOGITS, RANKED, "wi as (select vec_id, cast(cand as int) as w from rk where r = 1)", body=f"""
, j as (select vec_id, w, list_transform(embedding, lambda x: cast(x as double)) as e from wi join embeddings using (vec_id))
select vec_id, w as cand, {_axis_sql(16, 'rot')}, {_axis_sql(4, 'tilt')}, {_axis_sql(1, 'psi')} from j"""))
def substep_refine(spark, sf):
    """The 64 scores of a row read as a 4 x 4 x 4 grid of angle steps of 2 degrees."""
    s = K.substep(logits(spark, sf), "logits", 4, 2.0)
    return s.select("vec_id", "cand", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("drot", "dtilt", "dpsi")])


@query("neighbor_pose")
def neighbor_pose(spark, sf):
    p = grid_logits(spark, sf).select("vec_id", K.softmax(F.transform("logits", lambda v: v.cast("double") * 8)).alias("p"))

    def fn(c):
        m, score = GT.neighbour_pose(c["p"], 0, 5)
        return {"score": score, **{name: m[:, i] for i, name in enumerate(R.entries("r"))}}
    q = map_images(p, ["vec_id"], {n: T.DoubleType() for n in ["score", *R.entries("r")]}, fn)
    return q.select("vec_id", F.round("score", 6).alias("score"), *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in R.entries("r")])


GRID_TRACES = fx.sql_with("particles", SQL_MATRIX("m", "particles", "r"), f"grid as ({grid_sql(0)})",
                          f"t as (select m.pid, g.idx, round({trace_sql('r', 'g')}, 9) as tr, {trace_sql('r', 'g')} as exact from m cross join grid g)",
                          "nn as (select *, row_number() over (partition by pid order by tr desc, idx) as k from t)", body="")


@query("rotation_knn", GRID_TRACES + "select pid, cast(k as int) as k, idx, round((3.0 - exact) / 4.0, 6) + 0.0 as gap from nn where k <= 4")
def rotation_knn(spark, sf):
    near = fx.particles(spark, sf).select("pid", F.posexplode(GT.nearest_k(0, 4)("rot", "tilt", "psi")).alias("k", "n"))
    return near.select("pid", (F.col("k") + 1).cast("int").alias("k"), "n.idx", (F.round("n.gap", 6) + F.lit(0.0)).alias("gap"))


@query("sym_representatives", GRID_TRACES.rstrip() + f""",
ops as ({ops_sql(['D2'])}),
tr as (select a.idx as i, o.op, g.idx as j, """ + " + ".join(f"(s{r}0*a.g0{c} + s{r}1*a.g1{c} + s{r}2*a.g2{c}) * g.g{r}{c}" for r in range(3) for c in range(3)) + """ as t
 from grid a cross join ops o cross join grid g),
eq as (select i, j from (select *, row_number() over (partition by i, op order by round(t, 9) desc, j) as k from tr) q where k = 1),
mag as (select idx, round(acos(greatest(-1.0, least(1.0, (g00 + g11 + g22 - 1) / 2))), 5) as m from grid),
rep as (select i, j as rep from (select i, j, row_number() over (partition by i order by m, j) as k from eq join mag on mag.idx = eq.j) q where k = 1)
select rep, count(*) as n from nn join rep on rep.i = nn.idx where nn.k = 1 group by rep""")
def sym_representatives(spark, sf):
    table = F.lit([int(v) for v in GT.representatives(0, "D2")]).cast("array<bigint>")
    idx = fx.particles(spark, sf).select(G.nearest_grid_index(0)("rot", "tilt", "psi").alias("idx"))
    return idx.select(F.get(table, F.col("idx").cast("int")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n"))


RASTER = "raster as (select pid, round_even(rot / 5, 0) * 5 + (pid % 5) * 0.03::double as rot, round_even(tilt / 5, 0) * 5 + (pid % 3) * 0.03::double as tilt, round_even(psi / 5, 0) * 5 as psi from particles)"
_EITHER = "unnest(list_distinct([floor(({c} - 0.0018) / 0.02), floor(({c} + 0.0018) / 0.02)]))"  # 0.1 degrees move an entry by less


@query("grid_dedupe", fx.sql_with("particles", RASTER, SQL_MATRIX("m", "raster", "r"), f"""
e as (select {", ".join(f"m.r{i}{j} as e{i}{j}" for i in range(3) for j in range(3))}, m.pid as k, a, b, c from m, {_EITHER.format(c="m.r00")} t(a), {_EITHER.format(c="m.r10")} u(b), {_EITHER.format(c="m.r02")} v(c))""", body=f"""
select raster.pid, rot, tilt, psi from raster where not exists (
 select 1 from m join e on e.a = floor(m.r00 / 0.02) and e.b = floor(m.r10 / 0.02) and e.c = floor(m.r02 / 0.02) and e.k < m.pid
 where m.pid = raster.pid and {trace_sql("m.r", "e.e")} >= 1 + 2 * cos(radians(0.1)))"""))
def grid_dedupe(spark, sf):
    """Poses on a 5 degree raster with small deviations, freed of those within 0.1 degrees of an earlier one."""
    p = fx.particles(spark, sf).selectExpr(
        "pid", "rint(rot / 5) * 5 + (pid % 5) * 0.03D as rot", "rint(tilt / 5) * 5 + (pid % 3) * 0.03D as tilt", "rint(psi / 5) * 5 as psi")
    return K.drop_near_duplicates(p, "pid")
