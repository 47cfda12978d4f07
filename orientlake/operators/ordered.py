"""Order-based operators that never put one unbounded group into one task.

A total order is cut into buckets; sums inside a bucket come from a window
over that bucket, sums of the buckets before it from a table with one row
per bucket. Hot values cost nothing extra, because callers first count rows
per distinct value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from orientlake.session import cut, shuffle_width

HASH_RANGE = 4294967296
_ROWS_PER_COPY_RUN = 4096
PARTS_PER_SPLIT = 8  # a split of a file holds some 100 MB packed, several times that as rows to sort


def seeded_order(col: str | Column) -> Column:
    """Reproducible pseudo-random order key in [0, 2^32), by integer arithmetic only.

    The key times a constant, modulo 2^32. The key is reduced first and its
    upper 16 bits are multiplied apart, so no key is too large.
    """
    key = F.pmod((F.col(col) if isinstance(col, str) else col).cast("bigint"), F.lit(HASH_RANGE))
    low, high = key.bitwiseAND(F.lit(0xFFFF)), F.shiftright(key, 16)
    return F.pmod(F.pmod(high * F.lit(2654435761), F.lit(65536)) * F.lit(65536) + low * F.lit(2654435761), F.lit(HASH_RANGE))


def small_parts(df: DataFrame) -> int:
    """Parts enough that each part of a table read from files is sorted in memory."""
    return max(shuffle_width(df.sparkSession), PARTS_PER_SPLIT * df.rdd.getNumPartitions())


def number_rows(df: DataFrame, order: Sequence[str], name: str, keep: Sequence[str] | None = None, scanned: bool = False) -> DataFrame:
    """Row numbers from 1 over a total order of ``order``; the columns ``keep`` of them stay, all by default.

    Equal rows are first counted and split into runs of bounded length, so that
    a range partitioning on (columns, run) spreads even a single repeated row.
    Rows that are ``scanned``, that is read straight from files and so in the
    same order by every attempt of a task, take their place in the file instead
    of a run: nothing is gathered before the one shuffle, and there are parts
    enough that each is sorted in memory.
    """
    spark = df.sparkSession
    keep = list(order if keep is None else keep)
    if scanned:
        parts = max(shuffle_width(spark), PARTS_PER_SPLIT * df.rdd.getNumPartitions())
        rows = df.select(*order).withColumn("_run", F.monotonically_increasing_id())
        ranged = rows.repartitionByRange(parts, *order, "_run").sortWithinPartitions(*order, "_run").select(*keep)
    else:
        runs = (
            df.groupBy(*order).agg(F.count(F.lit(1)).alias("_n"))
            .withColumn("_run", F.explode(F.sequence(F.lit(0), F.expr(f"(_n - 1) div {_ROWS_PER_COPY_RUN}"))))
            .withColumn("_len", F.least(F.lit(_ROWS_PER_COPY_RUN), F.expr(f"_n - _run * {_ROWS_PER_COPY_RUN}")).cast("int"))
        )
        ranged = (
            runs.repartitionByRange(shuffle_width(spark), *order, "_run").sortWithinPartitions(*order, "_run")
            .select(*keep, F.explode(F.array_repeat(F.lit(0), F.col("_len"))).alias("_copy"))
            .drop("_copy")
        )
    ranged = ranged.withColumn("_place", F.monotonically_increasing_id())
    placed = cut(ranged, "numbered")
    part = F.shiftright("_place", 33)
    # one row per partition comes back, never more than there are parts
    sizes = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, total = [], 0
    for p in range(max(sizes, default=0) + 1):
        starts.append(total)
        total += sizes.get(p, 0)
    offset = F.element_at(F.lit(starts).cast("array<bigint>"), (part + 1).cast("int"))
    number = offset + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.select(number.alias(name), *keep)


def value_bucket(df: DataFrame, col: str, buckets: int | None = None) -> DataFrame:
    """Add ``_bucket``: the place of ``col`` among approximate quantiles of the whole column.

    The cut points are a bounded array from one mergeable sketch, read as a
    scalar subquery; each row finds its place by bisection.
    """
    buckets = buckets or shuffle_width(df.sparkSession)
    if buckets <= 1:
        return df.withColumn("_bucket", F.lit(0))
    probs = [i / buckets for i in range(1, buckets)]
    cuts = df.agg(F.percentile_approx(F.col(col).cast("double"), probs, F.lit(50 * buckets)).alias("c"))
    steps = []
    step = 1
    while step < buckets:
        steps.insert(0, step)
        step *= 2
    with_cuts = df.withColumn("_cuts", cuts.scalar())
    place = F.reduce(
        F.lit(steps).cast("array<int>"), F.lit(0).cast("int"),
        lambda pos, s: F.when(F.get("_cuts", pos + s - 1) <= F.col(col).cast("double"), (pos + s)).otherwise(pos).cast("int"))
    return with_cuts.withColumn("_bucket", place).drop("_cuts")


def prefix_sums(df: DataFrame, order: Sequence[str | Column], sums: Sequence[str], group: Sequence[str] = (),
                bucket: Column | None = None, by: str | None = None) -> DataFrame:
    """Add ``<s>_before`` (sum over earlier rows) and ``<s>_total`` for each ``s`` in ``sums``.

    ``bucket`` must grow with the order. Without it the rows are bucketed by
    the quantiles of column ``by``, which must be the leading order column.
    """
    placed = df.withColumn("_bucket", bucket) if bucket is not None else value_bucket(df, by)
    keys = [*group, "_bucket"]
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = placed.withColumns({f"_in_{s}": F.sum(s).over(inside) for s in sums})
    per_bucket = placed.groupBy(*keys).agg(*[F.sum(s).alias(f"_sum_{s}") for s in sums])
    # at most one row per bucket and group
    across = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_bucket")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    everything = across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = per_bucket.select(
        *[F.col(g).alias(f"_g_{g}") for g in group], F.col("_bucket").alias("_b"),
        *[F.coalesce(F.sum(f"_sum_{s}").over(before), F.lit(0)).alias(f"_off_{s}") for s in sums],
        *[F.sum(f"_sum_{s}").over(everything).alias(f"{s}_total") for s in sums])
    same = F.col("_bucket") == F.col("_b")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    out = rows.join(offsets, same)
    for s in sums:
        out = out.withColumn(f"{s}_before", F.col(f"_off_{s}") + F.col(f"_in_{s}") - F.col(s))
    drop = ["_bucket", "_b", *[f"_g_{g}" for g in group], *[f"_in_{s}" for s in sums], *[f"_off_{s}" for s in sums]]
    return out.drop(*drop)


def seeded_rank(df: DataFrame, key: str, name: str, group: Sequence[str] = ()) -> DataFrame:
    """Rank from 1 in seeded order, per group, with ``<name>_total`` rows in the group."""
    buckets = shuffle_width(df.sparkSession)
    h = seeded_order(key)
    ranked = prefix_sums(
        df.withColumns({"_h": h, "_one": F.lit(1).cast("bigint")}), ["_h", key], ["_one"], group,
        bucket=F.floor(F.col("_h") / F.lit(HASH_RANGE / buckets)).cast("int"))
    return ranked.withColumnsRenamed({"_one_total": f"{name}_total"}).withColumn(
        name, F.col("_one_before") + 1).drop("_h", "_one", "_one_before")


def ordered_rank(df: DataFrame, key: str, name: str, group: Sequence[str] = ()) -> DataFrame:
    """Rank from 1 in the order of a unique numeric ``key``, per group."""
    ranked = prefix_sums(df.withColumn("_one", F.lit(1).cast("bigint")), [key], ["_one"], group, by=key)
    return ranked.withColumn(name, F.col("_one_before") + 1).withColumnRenamed(
        "_one_total", f"{name}_total").drop("_one", "_one_before")


def counted_values(df: DataFrame, col: str, group: Sequence[str] = (), **sums: Column) -> DataFrame:
    """One row per distinct value (and group) with its count ``n`` and any extra sums."""
    return df.groupBy(*group, col).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(k) for k, c in sums.items()])


def grouped_quantiles(df: DataFrame, col: str, probs: dict[str, float], group: Sequence[str] = ()) -> DataFrame:
    """Exact linearly interpolated quantiles, one column per entry of ``probs``.

    NULL values are left out. Works on counts per distinct value, so neither a
    hot group nor a hot value meets in one task. Totals per bucket tell which
    buckets hold the wanted ranks; only those are sorted.
    """
    counts = value_bucket(cut(counted_values(df.where(F.col(col).isNotNull()), col, group), "counts"), col)
    keys = [*group, "_bucket"]
    # at most one row per bucket and group
    across = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_bucket")
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("_sum")).select(
        *keys, "_sum", F.coalesce(F.sum("_sum").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
        F.sum("_sum").over(across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_total"))
    ranks = {}
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("_total") - 1)
        ranks[name] = (F.floor(pos), F.ceil(pos), pos - F.floor(pos))
    wanted = F.lit(False)
    for lo, hi, _ in ranks.values():
        for k in (lo, hi):
            wanted = wanted | ((F.col("_off") <= k) & (k < F.col("_off") + F.col("_sum")))
    rows = counts.join(totals.where(wanted), keys)
    inside = Window.partitionBy(*keys).orderBy(col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("_end", F.col("_off") + F.sum("n").over(inside))
    aggs = []
    for name, (lo, hi, t) in ranks.items():
        holds = lambda k: (F.col("_end") - F.col("n") <= k) & (k < F.col("_end"))
        aggs += [F.max(F.when(holds(lo), F.col(col))).alias(f"_lo_{name}"),
                 F.max(F.when(holds(hi), F.col(col))).alias(f"_hi_{name}"), F.max(t).alias(f"_t_{name}")]
    out = placed.groupBy(*group).agg(*aggs)
    return out.select(*group, *[
        (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_t_{n}")).alias(n) for n in probs])


def average_ranks(df: DataFrame, col: str) -> DataFrame:
    """Per distinct value: count ``n``, average rank ``rank`` and total ``n_total``."""
    placed = prefix_sums(cut(counted_values(df, col), "counts"), [col], ["n"], by=col)
    return placed.select(col, "n", "n_total", (F.col("n_before") + (F.col("n") + 1) / F.lit(2.0)).alias("rank"))
