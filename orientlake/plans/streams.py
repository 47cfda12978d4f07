"""Streaming queries replayed from files; each returns what its sink holds at the end."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from orientlake.operators.filters import score_filter
from orientlake.plans import fixtures as fx
from orientlake.plans.registry import query
from orientlake.plans.volumes import ACC_SQL, SUM_SQL, accumulators
from orientlake.session import new_dir, source_fingerprint
from orientlake.sources import star
from orientlake.streaming import ingest as I

_DAYS: dict[tuple, str] = {}


def day_files(spark, sf):
    """Events as one folder of files per day; (path, schema)."""
    e = fx.events(spark, sf).select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value").withColumn("day", F.to_date("ts").cast("string"))
    key = (spark.sparkContext.applicationId, sf, source_fingerprint(spark, f"{sf}/events.parquet"))
    if key not in _DAYS:
        path = new_dir(spark, "days")
        e.write.partitionBy("day").parquet(path)
        _DAYS[key] = path
    return _DAYS[key], e.schema


def day_stream(spark, sf, per_trigger=64):
    path, schema = day_files(spark, sf)
    return I.file_stream(spark, path, schema, per_trigger)


def sink_of(spark, stream, mode="append"):
    """Run a stream to its end into a numbered sink and give its rows."""
    path = new_dir(spark, "sink")
    I.run_to_end(I.start(stream, I.numbered_sink(path), new_dir(spark, "state"), mode))
    return I.read_sink(spark, path, stream.schema)


@query("stream_ingest", fx.sql_with("particles", body="""
select half, optics_group, count(*) as n, round(sum(score), 4) as total, cast(sum(pid) as bigint) as pids from particles group by 1, 2"""))
def stream_ingest(spark, sf):
    """STAR files of the first half, and the second half pushed from memory, taken in by one stream that starts twice."""
    inbox, sink, state = new_dir(spark, "inbox"), new_dir(spark, "sink"), new_dir(spark, "state")
    p, o = fx.particles(spark, sf).select("pid", "half", "optics_group", "score"), fx.optics(spark, sf)
    columns = {"pid": "bigint", "half": "bigint", "optics_group": "bigint", "score": "double"}
    for half in (1, 2):
        I.push_table(p.where(F.col("half") == half), o, f"{inbox}/half{half}")
        I.run_to_end(I.ingest_star(spark, f"{inbox}/half*", sink, state, columns, per_trigger=64))
    schema = T.StructType([p.schema[c] for c in columns])
    return I.read_sink(spark, sink, schema).groupBy("half", "optics_group").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 4).alias("total"), F.sum("pid").alias("pids"))


@query("stream_by_queue", "select event_type as queue, count(*) as n, round(sum(value), 4) as total from events group by 1")
def stream_by_queue(spark, sf):
    """One stream per queue, each over its own folder with its own bound and checkpoint."""
    inbox, sink = new_dir(spark, "queues"), new_dir(spark, "sink")
    fx.events(spark, sf).select("event_type", "event_id", "value").write.partitionBy("event_type").parquet(inbox)
    names = [r[0] for r in spark.read.parquet(inbox).select("event_type").distinct().collect()]
    schema = fx.events(spark, sf).select("event_id", "value").schema
    streams = {name: I.file_stream(spark, f"{inbox}/event_type={name}", schema, 1 + i) for i, name in enumerate(sorted(names))}
    failed = I.finish_queues(I.start_queues(streams, lambda name: I.numbered_sink(f"{sink}/queue={name}"), new_dir(spark, "state")))
    if any(failed.values()):
        raise RuntimeError(f"queues failed: {failed}")
    return spark.read.parquet(sink).groupBy("queue").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("stream_zscore", "select event_id, event_type, value from events where value > 20")
def stream_zscore(spark, sf):
    return sink_of(spark, score_filter(day_stream(spark, sf), "value", 20.0)).select("event_id", "event_type", "value")


@query("stream_partial", "select event_type, cast(date_trunc('day', ts) as date) as day, count(*) as n, round(sum(value), 4) as total from events where value > 5 group by 1, 2")
def stream_partial(spark, sf):
    """Partial rows appended batch by batch, combined at the end."""
    part = sink_of(spark, score_filter(day_stream(spark, sf, 16), "value", 5.0))
    return part.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("stream_buffer", """with s as (select count(*) as n, sum(value) as t from events where value > 5)
select cast(n // 256 as bigint) as full_buffers, cast(n % 256 as bigint) as rest, n, round(t, 4) as total from s""")
def stream_buffer(spark, sf):
    root = new_dir(spark, "buffer")
    handle, flush = I.buffer_survivors("value", 5.0, 256, root, "event_id")
    q = I.start(day_stream(spark, sf, 16).drop("day"), handle, new_dir(spark, "state"))
    I.run_to_end(q)
    rows = flush(spark, I.last_batch(q))
    buffers = rows.groupBy("batch", "buffer", "full").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("t"))
    return buffers.agg(F.count(F.when(F.col("full") & (F.col("n") == 256), 1)).alias("full_buffers"),
                       F.coalesce(F.sum(F.when(~F.col("full"), F.col("n"))), F.lit(0)).cast("bigint").alias("rest"),
                       F.sum("n").cast("bigint").alias("n"), F.round(F.sum("t"), 4).alias("total"))


@query("stream_accum", fx.sql_with("voxels", ACC_SQL, SUM_SQL, body="""
select half, z, y, x, round(re, 6) + 0.0 as re, round(im, 6) + 0.0 as im, round(w, 6) as w, round(ctfsq, 6) as ctfsq from acc"""))
def stream_accum(spark, sf):
    """Partial accumulators arrive as files; the state after the last batch is their sum."""
    parts = accumulators(spark, sf)
    path, root = new_dir(spark, "parts"), new_dir(spark, "running")
    parts.repartition(8, "part").write.parquet(path)
    q = I.start(I.file_stream(spark, path, parts.schema, 4), I.running_accumulators(root, compact=3), new_dir(spark, "state"))
    I.run_to_end(q)
    return I.accumulator_state(spark, root).select("half", "z", "y", "x", *[
        (F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("re", "im", "w", "ctfsq")])


@query("stream_dedupe", "select event_type, count(*) as n, cast(sum(event_id) as bigint) as ids from events group by 1")
def stream_dedupe(spark, sf):
    """Every event is sent twice; one of each remains."""
    twice = day_stream(spark, sf).withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_copy")
    once = sink_of(spark, I.dedupe(twice, ["event_id"], "ts", "60 days"))
    return once.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query("stream_cone_stats", """select date_trunc('day', ts) as from_ts, user_id, count(*) as n, round(avg(value), 6) as mean, min(value) as low, max(value) as high
from events group by 1, 2""")
def stream_cone_stats(spark, sf):
    s = I.cone_statistics(day_stream(spark, sf), "user_id", "value", "ts", "1 day", "60 days")
    return I.latest(sink_of(spark, s, "update"), ["from_ts", "user_id"]).withColumn("mean", F.round("mean", 6))
