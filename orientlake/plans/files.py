"""Queries that write the derived tables as STAR, MRC and log files and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from orientlake.operators.ordered import grouped_quantiles
from orientlake.plans import fixtures as fx
from orientlake.plans.registry import query
from orientlake.session import cut, new_dir
from orientlake.sources import metrics, mrc, star


@query("star_roundtrip", fx.sql_with("particles", "optics", body="""
select pid, image_name, micrograph, optics_group, x, y, rot, tilt, psi, score, px, kv from particles join optics using (optics_group)"""))
def star_roundtrip(spark, sf):
    path = new_dir(spark, "star")
    p = fx.particles(spark, sf).select("pid", "image_name", "micrograph", "optics_group", "x", "y", "rot", "tilt", "psi", "score")
    star.write_star(p, fx.optics(spark, sf), path)
    particles, optics = star.read_star(spark, path, ["pid", "optics_group"])
    return particles.drop("file", "file_order").join(optics.select("optics_group", F.col("px").cast("double").alias("px"), F.col("kv").cast("double").alias("kv")), "optics_group")


@query("star_pick_block", fx.sql_with("particles", body="""
select 'picks' as block, pid, x, y from particles where half = 1 union all select 'particles' as block, pid, x, y from particles where half = 2"""))
def star_pick_block(spark, sf):
    """One folder without a particles block, one where it comes last: the right block is found in both."""
    out = None
    for half, block, other in ((1, "picks", "model"), (2, "particles", "picks")):
        path = new_dir(spark, "blocks")
        rows = fx.particles(spark, sf).where(F.col("half") == half).select("pid", "micrograph", "x", "y")
        star.star_lines(rows, block, [f"data_{other}", "", "_version 3", "_note 'two words'"]).write.text(path)
        blocks = cut(star.read_blocks(spark, path), "blocks")
        found = star.block_layouts(blocks)
        picked = star.pick_block(found, ["micrograph", "x", "y"])
        part = star.typed_table(blocks, picked, found[picked]).select(F.lit(picked).alias("block"), "pid", "x", "y")
        out = part if out is None else out.unionByName(part)
    return out


@query("scan_stacks", """select vec_id, cast(i - 1 as int) as i, round(cast(embedding[i] as double), 6) + 0.0 as v
from (select vec_id, embedding, unnest(range(1, 65)) as i from embeddings) u""")
def scan_stacks(spark, sf):
    folder = new_dir(spark, "stacks")
    im = fx.images(spark, sf).selectExpr("concat('s', vec_id div 100, '.mrcs') as stack", "vec_id % 100 as index", "8 as nx", "8 as ny", "pixels")
    mrc.write_stacks(im, folder, px=1.5).agg(F.sum("n")).first()
    rows = mrc.scan_images(spark, f"{folder}/*.mrcs")
    number = F.regexp_extract("path", r"s(\d+)\.mrcs$", 1).cast("bigint") * 100 + F.col("index") - 1
    return rows.select(number.alias("vec_id"), F.posexplode("pixels").alias("i", "v")).select(
        "vec_id", "i", (F.round(F.col("v").cast("double"), 6) + F.lit(0.0)).alias("v"))


@query("scan_volume", fx.sql_with("voxels", body="select vol_id, z, y, x, round(v, 6) + 0.0 as v, cast(1.25 as double) as px from voxels"))
def scan_volume(spark, sf):
    folder = new_dir(spark, "volumes")
    im = fx.planes(spark, sf).selectExpr("concat('v', vol_id, '.mrc') as stack", "z as index", "8 as nx", "8 as ny", "plane as pixels")
    mrc.write_stacks(im, folder, px=1.25).agg(F.sum("n")).first()
    v = mrc.scan_volumes(spark, f"{folder}/*.mrc", 1.25)
    return v.select(F.regexp_extract("path", r"v(\d+)\.mrc$", 1).cast("bigint").alias("vol_id"), "z", "y", "x",
                    (F.round("v", 6) + F.lit(0.0)).alias("v"), F.round("px", 4).alias("px"))


@query("log_metrics", fx.sql_with("pe", body="""
, h as (select optics_group, half, count(*) as n, round(avg(err), 2) as mean_deg, round(median(err), 2) as median_deg,
 round(avg(case when err < 5 then 100.0 else 0.0 end), 1) as pct5, round(avg(shift_err), 2) as shift_mean from pe group by 1, 2)
select concat('run=', optics_group) as run, cast(sum(n) as bigint) as n, round(avg(mean_deg), 6) as mean_deg, round(avg(median_deg), 6) as median_deg,
 round(avg(cast(pct5 as double)), 6) as pct5, round(avg(shift_mean), 6) as shift_mean, round(sum(round(n / 60.0, 1)), 6) as minutes from h group by 1"""))
def log_metrics(spark, sf):
    """One log per run and half, written as text, parsed and rolled up."""
    p = fx.pairs(spark, sf)
    key = ["optics_group", "half"]
    s = p.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.avg("err").alias("mean"), F.stddev_pop("err").alias("std"), F.avg("shift_err").alias("sm"),
        F.avg(F.when(F.col("err") < 5, F.lit(100.0)).otherwise(F.lit(0.0))).alias("p5"),
        F.avg(F.when(F.col("err") < 10, F.lit(100.0)).otherwise(F.lit(0.0))).alias("p10")).join(
        grouped_quantiles(p.select(*key, "err"), "err", {"med": .5}, key), key)
    text = F.format_string(
        "Found %d matching particles.\n\nAnalyzing angular differences with D2 symmetry:\nMean: %.2f°\nStandard Deviation: %.2f°\nMedian: %.2f°\n\n"
        "Percentage of particles with angular error:\n< 5°: %.1f%%\n< 10°: %.1f%%\n\nShift errors (Å):\nMean: %.2f\n\nRun time: %.1f min\n",
        "n", "mean", "std", "med", "p5", "p10", "sm", F.col("n") / 60.0)
    path = new_dir(spark, "logs")
    s.select(F.col("optics_group").alias("run"), text.alias("value")).write.option("maxRecordsPerFile", 1).partitionBy("run").text(path)
    runs = metrics.roll_up_runs(metrics.read_run_logs(spark, f"{path}/*/*.txt"))
    return runs.select("run", "n", *[F.round(c, 6).alias(c) for c in ("mean_deg", "median_deg", "pct5", "shift_mean", "minutes")])
