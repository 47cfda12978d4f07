"""Streams of arriving table files: discovery once, filter, partial results, running sums.

Every sink writes a micro-batch under its own number, so a batch that is
repeated after a failure replaces itself and nothing is counted twice. A
stopped stream goes on from its checkpoint; there is no end marker to lose.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from orientlake.fourier.shells import merge_accumulators
from orientlake.operators.filters import score_filter
from orientlake.session import batches_in, new_dir, remove_dir
from orientlake.sources.star import _position, assign_blocks, write_star


def run_to_end(query: StreamingQuery) -> None:
    """Wait until everything available has been taken in."""
    query.awaitTermination()


def start(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append",
          every: str | None = None) -> StreamingQuery:
    """A stream handing batches to ``handle``; without ``every`` it drains what is there and stops."""
    writer = stream.writeStream.outputMode(mode).foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def numbered_sink(path: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
    return write


def read_sink(spark: SparkSession, path: str, schema) -> DataFrame:
    """All batches of a numbered sink, with their number as ``batch``."""
    from pyspark.sql import types as T
    full = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    return spark.read.schema(full).parquet(path)


def file_stream(spark: SparkSession, path: str, schema, per_trigger: int | None = None, glob: str | None = None) -> DataFrame:
    """New parquet files below ``path``; ``per_trigger`` bounds how many a batch may take."""
    reader = spark.readStream.schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


# --- STAR files ---------------------------------------------------------------------------------

def star_stream(spark: SparkSession, folder: str, glob: str = "*", per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format("text").option("pathGlobFilter", glob)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.load(folder).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block_at"), "value")


def ingest_star(spark: SparkSession, folder: str, sink: str, checkpoint: str, columns: dict[str, str], block: str = "particles",
                glob: str = "*", per_trigger: int | None = None, every: str | None = None) -> StreamingQuery:
    """Rows of one block of every new STAR file, typed by ``columns``, into a numbered sink.

    A file always arrives whole in one batch, so its header is at hand there.
    """
    write = numbered_sink(sink)

    def handle(batch: DataFrame, number: int) -> None:
        lines = batch.withColumn("line_at", F.monotonically_increasing_id()).withColumn("text", F.trim("value")).where(
            (F.col("text") != "") & ~F.col("text").startswith("#")).select("file", "text", _position(F.col("block_at"), F.col("line_at")).alias("at"))
        rows = assign_blocks(lines).where(F.col("block") == block)
        typed = rows.select(*[F.get("tokens", F.array_position("columns", F.lit(c)).cast("int") - 1).cast(t).alias(c) for c, t in columns.items()])
        write(typed, number)
    return start(star_stream(spark, folder, glob, per_trigger), handle, checkpoint, every=every)


def push_table(df: DataFrame, optics: DataFrame | None, inbox: str) -> None:
    """A table already in memory enters the same stream as a file: it is written to the watched folder."""
    write_star(df, optics, new_dir(df.sparkSession, "push") if not inbox else inbox)


# --- operators ----------------------------------------------------------------------------------

def start_queues(streams: dict[str, DataFrame], handle: Callable[[str], Callable[[DataFrame, int], None]], checkpoints: str,
                 every: str | None = None) -> dict[str, StreamingQuery]:
    """One streaming query per named queue: its own source and bound, its own checkpoint below ``checkpoints``, its own failure.

    ``handle`` gives the batch handler of a queue. A queue that fails stops
    alone; started again under its name it goes on from its checkpoint.
    """
    return {name: start(stream, handle(name), f"{checkpoints}/{name}", every=every) for name, stream in streams.items()}


def finish_queues(queries: dict[str, StreamingQuery]) -> dict[str, str | None]:
    """Wait for every queue; what it failed with, or None."""
    ended: dict[str, str | None] = {}
    for name, query in queries.items():
        try:
            query.awaitTermination()
            ended[name] = None
        except StreamingQueryException as failure:
            ended[name] = str(failure)
    return ended


def latest(sink: DataFrame, keys: list[str]) -> DataFrame:
    """Last value of every key in a sink fed in update mode."""
    rest = [c for c in sink.columns if c not in (*keys, "batch")]
    last = sink.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("v"))
    return last.select(*keys, *[F.col(f"v.{c}").alias(c) for c in rest])


def buffer_survivors(score: str, threshold: float, size: int, root: str, key: str) -> tuple[Callable[[DataFrame, int], None], Callable[[SparkSession], DataFrame]]:
    """(batch handler, flush): survivors wait until ``size`` of them are there and leave in full buffers.

    What waits between batches is a table in the shared folder. Flush gives all
    buffers with the last, part-filled one.
    """
    from orientlake.operators.ordered import ordered_rank

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        waiting = score_filter(batch, score, threshold)
        if number > 0:
            waiting = spark.read.parquet(f"{root}/wait-{number - 1}").unionByName(waiting)
        ranked = ordered_rank(waiting, key, "_k")
        full = F.expr(f"(_k_total div {size}) * {size}")
        sized = ranked.withColumns({"buffer": F.expr(f"(_k - 1) div {size}"), "_full": F.col("_k") <= full})
        path = f"{root}/ranked-{number}"
        sized.write.mode("overwrite").parquet(path)
        stored = spark.read.parquet(path)
        stored.where("_full").drop("_k", "_k_total", "_full").write.mode("overwrite").parquet(f"{root}/out/batch={number}")
        stored.where("not _full").drop("_k", "_k_total", "_full", "buffer").write.mode("overwrite").parquet(f"{root}/wait-{number}")

    def flush(spark: SparkSession, last: int) -> DataFrame:
        out = spark.read.parquet(f"{root}/out").withColumn("full", F.lit(True)).withColumn("batch", F.col("batch").cast("bigint"))
        rest = spark.read.parquet(f"{root}/wait-{last}").withColumns({"buffer": F.lit(0).cast("bigint"), "full": F.lit(False), "batch": F.lit(last + 1).cast("bigint")})
        return out.unionByName(rest)
    return handle, flush


_VOXEL = ("half", "z", "y", "x", "re", "im", "w", "ctfsq")


def running_accumulators(root: str, compact: int = 8) -> Callable[[DataFrame, int], None]:
    """Running sums as a base and the batches after it.

    A batch writes its own voxels only, summed. Every ``compact`` batches the
    base and all batches after it become the next base, and what went into it
    is deleted once the new base is whole. A batch that is repeated replaces
    itself, before or after that.
    """
    def handle(batch: DataFrame, number: int) -> None:
        spark, bases = batch.sparkSession, batches_in(f"{root}/base")
        if not bases or bases[-1] < number:
            merge_accumulators(batch.select(*_VOXEL)).write.mode("overwrite").parquet(f"{root}/delta/batch={number}")
            if (number + 1) % compact == 0:
                accumulator_state(spark, root, number).write.mode("overwrite").parquet(f"{root}/base/batch={number}")
                bases.append(number)
        if bases:
            for kind in ("base", "delta"):
                for old in batches_in(f"{root}/{kind}"):
                    if old < bases[-1] or (kind == "delta" and old == bases[-1]):
                        remove_dir(f"{root}/{kind}/batch={old}")
    return handle


def accumulator_state(spark: SparkSession, root: str, upto: int | None = None) -> DataFrame:
    """Sums of everything taken in so far (up to batch ``upto``)."""
    numbers = {kind: [n for n in batches_in(f"{root}/{kind}") if upto is None or n <= upto] for kind in ("base", "delta")}
    base = numbers["base"][-1:]
    paths = [f"{root}/base/batch={n}" for n in base] + [f"{root}/delta/batch={n}" for n in numbers["delta"] if not base or n > base[0]]
    return merge_accumulators(spark.read.parquet(*paths).select(*_VOXEL))


def last_batch(query: StreamingQuery) -> int:
    return query.lastProgress["batchId"] if query.lastProgress else -1


def dedupe(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """First row of each key within the watermark; state older than ``delay`` is dropped."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def cone_statistics(stream: DataFrame, cone: str, score: str, time: str, width: str, delay: str) -> DataFrame:
    """Count, mean, least and largest score per time window and cone."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), cone).agg(
        F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean"), F.min(score).alias("low"), F.max(score).alias("high")).select(
        F.col("w.start").alias("from_ts"), cone, "n", "mean", "low", "high")
