"""Queries over names, keys and row filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from orientlake.functions import strings as S
from orientlake.operators import filters
from orientlake.plans import fixtures as fx
from orientlake.plans.registry import query


@query("split_image_name", fx.sql_with("particles", body="""
select pid, cast(regexp_extract(image_name, '^\\s*(\\d+)\\s*@', 1) as bigint) as image_index,
 regexp_extract(image_name, '^[^@]*@(.*)/[^/]*$', 1) as folder,
 regexp_extract(image_name, '([^/@]*)$', 1) as base from particles"""))
def split_image_name(spark, sf):
    name = F.col("image_name")
    return fx.particles(spark, sf).select(
        "pid", S.image_index(name).alias("image_index"), S.dirname(S.image_stack(name)).alias("folder"),
        S.basename(S.image_stack(name)).alias("base"))


@query("rebase_star", fx.sql_with("particles", body="""
select pid, concat(cast(cast(substr(image_name, 1, 6) as bigint) as string), '@new/root/', regexp_extract(image_name, '([^/]*)$', 1)) as moved,
 concat(cast(cast(substr(image_name, 1, 6) as bigint) as string), '@new/root/', substr(image_name, 8)) as mirrored,
 concat(substr(image_name, 1, 7), regexp_extract(image_name, '([^/]*)$', 1)) as bare from particles"""))
def rebase_star(spark, sf):
    name = F.col("image_name")
    return fx.particles(spark, sf).select(
        "pid", S.rebase(name, "new/root").alias("moved"),
        S.rebase(name, "new/root", keep_basename=False).alias("mirrored"),
        S.rebase(name, "", remove_zeros=False).alias("bare"))


@query("micrograph_key", fx.sql_with("particles_b", body="""
select pid, regexp_extract(micrograph, '([^/]*)$', 1) as mic, regexp_extract(image_name, '([^/]*)$', 1) as stack from particles_b"""))
def micrograph_key(spark, sf):
    return fx.particles_b(spark, sf).select(
        "pid", S.micrograph_key(F.col("micrograph")).alias("mic"), S.micrograph_key(F.col("image_name")).alias("stack"))


@query("micrograph_relpath", fx.sql_with("particles_b", body="""
select pid, substr(micrograph, 6) as below, regexp_extract(micrograph, '([^/]*)$', 1) as base from particles_b"""))
def micrograph_relpath(spark, sf):
    m = F.col("micrograph")
    return fx.particles_b(spark, sf).select(
        "pid", S.micrograph_below(m, "/abs").alias("below"), S.micrograph_below(m, "/elsewhere").alias("base"))


@query("particle_id", fx.sql_with("particles", body="""
select pid, concat(cast(1 + (pid - 1) % 500 as string), '_stack_', cast((pid - 1) // 500 as string), '.mrcs') as particle_id from particles"""))
def particle_id(spark, sf):
    return fx.particles(spark, sf).select("pid", S.particle_id(F.col("image_name")).alias("particle_id"))


@query("coord_key", fx.sql_with("particles", body="""
select pid, regexp_extract(micrograph, '([^/]*)$', 1) as mic, cast(round_even(x / 0.5, 0) as bigint) as cx,
 cast(round_even(y / 0.5, 0) as bigint) as cy from particles"""))
def coord_key(spark, sf):
    return fx.particles(spark, sf).select(
        "pid", S.micrograph_key(F.col("micrograph")).alias("mic"),
        S.coordinate_cell(F.col("x"), 0.5).alias("cx"), S.coordinate_cell(F.col("y"), 0.5).alias("cy"))


@query("path_policy", fx.sql_with("particles", "particles_b", body="""
select pid, 1 as source, concat('out/', micrograph) as target,
 concat(substr(image_name, 1, 7), '/data/', regexp_extract(image_name, '([^/]*)$', 1)) as absolute,
 concat(substr(image_name, 1, 7), regexp_extract(image_name, '([^/]*)$', 1)) as relative from particles
union all
select pid, 2 as source, concat('out/', regexp_extract(micrograph, '([^/]*)$', 1)) as target,
 concat(substr(image_name, 1, 7), '/data/', regexp_extract(image_name, '([^/]*)$', 1)) as absolute,
 concat(substr(image_name, 1, 7), regexp_extract(image_name, '([^/]*)$', 1)) as relative from particles_b"""))
def path_policy(spark, sf):
    def policy(df, source):
        name = F.col("image_name")
        return df.select("pid", F.lit(source).alias("source"), S.output_path(F.col("micrograph"), "out").alias("target"),
                         S.stack_reference(name, "/data", True).alias("absolute"),
                         S.stack_reference(name, "/data", False).alias("relative"))
    return policy(fx.particles(spark, sf), 1).union(policy(fx.particles_b(spark, sf), 2))


@query("basename_collisions", fx.sql_with("particles", "particles_b", body="""
, u as (select optics_group, micrograph from particles union all select optics_group, micrograph from particles_b)
select optics_group, count(distinct micrograph) as n_paths, count(distinct regexp_extract(micrograph, '([^/]*)$', 1)) as n_names,
 count(distinct micrograph) > count(distinct regexp_extract(micrograph, '([^/]*)$', 1)) as collides from u group by optics_group"""))
def basename_collisions(spark, sf):
    both = fx.particles(spark, sf).select("optics_group", "micrograph").unionByName(
        fx.particles_b(spark, sf).select("optics_group", "micrograph"))
    paths = both.distinct().withColumn("base", S.micrograph_key(F.col("micrograph")))
    n_paths, n_names = F.count_distinct("micrograph"), F.count_distinct("base")
    return paths.groupBy("optics_group").agg(n_paths.alias("n_paths"), n_names.alias("n_names"),
                                             (n_paths > n_names).alias("collides"))


@query("select_subset", fx.sql_with("particles", body="""
select pid, defocus_u, fom, optics_group, 'ge' as test from particles where defocus_u >= 17500
union all select pid, defocus_u, fom, optics_group, 'eq' as test from particles where optics_group = 3"""))
def select_subset(spark, sf):
    p = fx.particles(spark, sf).select("pid", "defocus_u", "fom", "optics_group")
    return filters.select_subset(p, "defocus_u", "ge", "17500").withColumn("test", F.lit("ge")).union(
        filters.select_subset(p, "optics_group", "eq", "3").withColumn("test", F.lit("eq")))


@query("first_n", fx.sql_with("particles", body="""
select pid, image_name, score from particles where pid <= (select count(*) / 4 from particles)"""))
def first_n(spark, sf):
    p = fx.particles(spark, sf)
    quarter = p.agg((F.count(F.lit(1)) / 4).alias("n")).scalar()
    return filters.first_rows(p, "pid", quarter).select("pid", "image_name", "score")


@query("subset_idx", fx.sql_with("particles", body="""
, ranked as (select *, row_number() over (partition by half order by pid) - 1 as position from particles),
wanted as (select distinct half, pid // 3 as position from particles where pid % 2 = 0)
select r.pid, r.half, r.score from ranked r join wanted w on r.half = w.half and r.position = w.position"""))
def subset_idx(spark, sf):
    p = fx.particles(spark, sf)
    wanted = p.where("pid % 2 = 0").selectExpr("half", "pid div 3 as position").distinct()
    return filters.subset_by_index(p, wanted, "pid", "half").select("pid", "half", "score")


@query("half_filter", fx.sql_with("particles", body="select pid, half, score from particles where half = 1"))
def half_filter(spark, sf):
    return filters.half_filter(fx.particles(spark, sf), 1).select("pid", "half", "score")


@query("min_conf", fx.sql_with("particles", body="select pid, fom from particles where fom >= 0.5"))
def min_conf(spark, sf):
    return filters.min_confidence(fx.particles(spark, sf), "fom", 0.5).select("pid", "fom")


LISTING_SQL = """listing as (
select concat('Extract/job012/stack_', cast(s as string), '.mrcs') as path, 1024 + 256 * n as length
from (select (pid - 1) // 500 as s, count(*) as n from particles group by 1) k where s % 2 = 0)"""


def stack_listing(spark, sf):
    """Stacks that exist: those with an even number, sized like an 8 x 8 float stack."""
    return fx.particles(spark, sf).groupBy(F.expr("(pid - 1) div 500").alias("s")).agg(F.count(F.lit(1)).alias("n")) \
        .where("s % 2 = 0").selectExpr("concat('Extract/job012/stack_', cast(s as string), '.mrcs') as path",
                                       "1024 + 256 * n as length")


@query("remove_not_found", fx.sql_with("particles", LISTING_SQL, body="""
select pid, image_name from particles where substr(image_name, 8) in (select path from listing)"""))
def remove_not_found(spark, sf):
    return filters.existing_only(fx.particles(spark, sf).select("pid", "image_name"),
                                 S.image_stack(F.col("image_name")), stack_listing(spark, sf))


@query("stack_bytes", fx.sql_with("particles", LISTING_SQL, body="""
select cast(count(*) as bigint) as n_stacks, cast(count(l.path) as bigint) as n_found,
 cast(coalesce(sum(l.length), 0) as bigint) as bytes
from (select distinct substr(image_name, 8) as path from particles) s left join listing l on s.path = l.path"""))
def stack_bytes(spark, sf):
    stacks = fx.particles(spark, sf).select(S.image_stack(F.col("image_name")).alias("path")).distinct()
    return stacks.join(stack_listing(spark, sf).withColumn("found", F.lit(1)), "path", "left").agg(
        F.count(F.lit(1)).alias("n_stacks"), F.count("found").alias("n_found"),
        F.coalesce(F.sum("length"), F.lit(0)).cast("bigint").alias("bytes"))


@query("stack_plan", fx.sql_with("particles", body="""
select regexp_extract(image_name, '([^/]*)$', 1) as stack, cast(max(cast(substr(image_name, 1, 6) as bigint)) as bigint) as n_images,
 count(distinct optics_group) as n_groups, count(distinct optics_group) > 1 as conflict from particles group by 1"""))
def stack_plan(spark, sf):
    name = F.col("image_name")
    pairs = fx.particles(spark, sf).groupBy(S.basename(S.image_stack(name)).alias("stack"), "optics_group").agg(
        F.max(S.image_index(name)).alias("n"))
    return pairs.groupBy("stack").agg(F.max("n").alias("n_images"), F.count(F.lit(1)).alias("n_groups"),
                                      (F.count(F.lit(1)) > 1).alias("conflict"))


@query("zscore_filter", fx.sql_with("particles", body="""
, s as (select pid, case when pid % 11 = 0 then cast('NaN' as double) else score end as z from particles)
select pid, z from s where z > 1 and not isnan(z)"""))
def zscore_filter(spark, sf):
    s = fx.particles(spark, sf).selectExpr("pid", "case when pid % 11 = 0 then double('NaN') else score end as z")
    return filters.score_filter(s, "z", 1.0)


@query("skip_steps", fx.sql_with("metrics", body="""
select run, step, loss from metrics where step >= (select min(step) from metrics) + 1000"""))
def skip_steps(spark, sf):
    return filters.skip_steps(fx.train_metrics(spark, sf), "step", 1000).select("run", "step", "loss")


@query("metrics_select", fx.sql_with("metrics", body="select step, epoch, loss from metrics where loss is not null"))
def metrics_select(spark, sf):
    from orientlake.sources.metrics import known_columns
    return known_columns(fx.train_metrics(spark, sf)).where("loss is not null")


@query("clip_percentile", "select event_id, least(greatest(value, lo), hi) as clipped from events, (select quantile_cont(value, 0.01) as lo, quantile_cont(value, 0.99) as hi from events) q")
def clip_percentile(spark, sf):
    return filters.clip_quantiles(fx.events(spark, sf).select("event_id", "value"), "value", 0.01, 0.99, "clipped").drop("value")


@query("winsorize", fx.sql_with("particles", body="""
select pid, least(greatest(score, lo), hi) as winsorized from particles,
 (select quantile_cont(score, 0.005) as lo, quantile_cont(score, 0.995) as hi from particles) q"""))
def winsorize(spark, sf):
    return filters.clip_quantiles(fx.particles(spark, sf).select("pid", "score"), "score", 0.005, 0.995, "winsorized").drop("score")
