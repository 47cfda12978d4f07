"""Queries that unite, split and regroup particle tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from orientlake.functions import rotations as R
from orientlake.operators import sets as T
from orientlake.plans import fixtures as fx
from orientlake.plans.poses import TARGET, VIEW, _copies_sql
from orientlake.plans.registry import query

H = "(pid * 2654435761) % 4294967296"


@query("join_stars", fx.sql_with("particles", "particles_c", "optics", body="""
, u as (select pid, optics_group, fom, defocus_u from particles union all select pid, optics_group, fom, null from particles_c),
o as (select * from optics union select * from optics)
select u.pid, u.optics_group, u.fom, u.defocus_u, o.px, o.kv from u join o using (optics_group)"""))
def join_stars(spark, sf):
    p = T.join_tables([fx.particles(spark, sf).select("pid", "optics_group", "fom", "defocus_u"),
                       fx.particles_c(spark, sf).select("pid", "optics_group", "fom")])
    o = T.join_optics([fx.optics(spark, sf), fx.optics(spark, sf)])
    return p.join(o, "optics_group").select("pid", "optics_group", "fom", "defocus_u", "px", "kv")


@query("union_first_optics", fx.sql_with("particles", "particles_c", "optics", body="""
, o as (select optics_group, px, kv from (select *, row_number() over (partition by optics_group order by f) as k from (
 select 0 as f, optics_group, px, kv from optics where optics_group <> 2 union all
 select 1 as f, optics_group, px * 2 as px, cast(200 as double) as kv from optics) q) z where k = 1)
select o.optics_group, o.px, o.kv, count(*) as n from (select optics_group from particles union all select optics_group from particles_c) u
 join o using (optics_group) group by 1, 2, 3"""))
def union_first_optics(spark, sf):
    o = fx.optics(spark, sf).select("optics_group", "px", "kv")
    merged = T.first_optics([o.where("optics_group <> 2"), o.selectExpr("optics_group", "px * 2 as px", "cast(200 as double) as kv")])
    p = T.join_tables([fx.particles(spark, sf).select("optics_group"), fx.particles_c(spark, sf).select("optics_group")])
    return p.join(merged, "optics_group").groupBy("optics_group", "px", "kv").agg(F.count(F.lit(1)).alias("n"))


@query("merge_halves", fx.sql_with("particles", "particles_c", "optics", body="""
select u.pid, u.half, o.px from (select pid, cast(1 as bigint) as half, optics_group from particles where half = 1
 union all select pid, cast(2 as bigint) as half, optics_group from particles_c where half = 2) u join optics o using (optics_group)"""))
def merge_halves(spark, sf):
    a = fx.particles(spark, sf).where("half = 1").select("pid", "optics_group")
    b = fx.particles_c(spark, sf).where("half = 2").select("pid", "optics_group")
    o = fx.optics(spark, sf)
    rows, optics = T.merge_halves({"out/particles_half1.star": a, "out/particles_half2.star": b}, [o, o])
    return rows.join(optics, "optics_group").select("pid", "half", "px")


@query("split_star", fx.sql_with("particles", body=f"select pid, cast(ntile(7) over (order by {H}, pid) as bigint) as chunk from particles"))
def split_star(spark, sf):
    return T.split(fx.particles(spark, sf).select("pid"), "pid", 7)


@query("assign_halves", fx.sql_with("particles", body=f"select pid, cast(ntile(2) over (order by {H}, pid) as bigint) as half from particles"))
def assign_halves(spark, sf):
    return T.assign_halves(fx.particles(spark, sf).select("pid"), "pid")


@query("train_val_split", fx.sql_with("particles", "particles_c", body=f"""
, a as (select pid, row_number() over (order by {H}, pid) as k, count(*) over () as n from particles),
c as (select pid, row_number() over (order by {H}, pid) as k, count(*) over () as n from particles_c)
select pid, cast(0 as bigint) as dataset, case when k <= round(0.7 * n) then 'train' else 'validation' end as split from a
union all select pid, cast(1 as bigint), case when k <= round(0.7 * n) then 'train' else 'unused' end from c"""))
def train_val_split(spark, sf):
    return T.train_validation([fx.particles(spark, sf).select("pid"), fx.particles_c(spark, sf).select("pid")], "pid")


@query("sample_fraction", fx.sql_with("particles", body=f"""
select pid, score from (select pid, score, row_number() over (order by {H}, pid) as k, count(*) over () as n from particles) q where k <= round(0.3 * n)"""))
def sample_fraction(spark, sf):
    return T.sample_exact(fx.particles(spark, sf).select("pid", "score"), "pid", 0.3)


@query("thin_view_cone", fx.sql_with("particles", f"v as (select pid, {VIEW} from particles)", body=f"""
, d as (select pid, degrees(acos(greatest(-1.0, least(1.0, {_copies_sql('D2', TARGET)})))) <= 30 as inside from v),
r as (select pid, inside, row_number() over (partition by inside order by {H}, pid) as k, count(*) over (partition by inside) as n from d)
select pid, inside from r where not inside or k <= round(0.25 * n)"""))
def thin_view_cone(spark, sf):
    p = fx.particles(spark, sf).withColumn("inside", R.view_distance(
        R.view_of_angles(F.col("rot"), F.col("tilt")), TARGET, "D2") <= 30.0).select("pid", "inside")
    return T.thin(p, "pid", F.col("inside"), 0.75)


@query("optics_prune", fx.sql_with("particles", "optics", body="""
select o.optics_group, o.px, o.kv, o.cs, o.w from optics o where optics_group in (select optics_group from particles where score > 3 and optics_group <> 2)"""))
def optics_prune(spark, sf):
    return T.prune_optics(fx.optics(spark, sf), fx.particles(spark, sf).where("score > 3 and optics_group <> 2")).drop("box")


@query("regroup_stacks", fx.sql_with("particles", """
g as (select row_number() over (order by optics_group, micrograph) as ord, optics_group, micrograph, count(*) as size from particles group by optics_group, micrograph)""", """
w as (select ord, optics_group, micrograph, size, size as fill, 1 as stack, 0 as off from g where ord = 1
 union all select g.ord, g.optics_group, g.micrograph, g.size, case when w.fill + g.size > 1500 then g.size else w.fill + g.size end,
 case when w.fill + g.size > 1500 then w.stack + 1 else w.stack end, case when w.fill + g.size > 1500 then 0 else w.fill end from w join g on g.ord = w.ord + 1)""",
    recursive=True, body="""
select p.pid, cast(w.stack as bigint) as new_stack, cast(w.off + row_number() over (partition by p.optics_group, p.micrograph order by p.pid) as bigint) as new_index
from particles p join w on w.optics_group = p.optics_group and w.micrograph = p.micrograph"""))
def regroup_stacks(spark, sf):
    p = fx.particles(spark, sf).select("pid", "optics_group", "micrograph")
    return T.regroup_stacks(p, 1500).select("pid", "new_stack", "new_index")
