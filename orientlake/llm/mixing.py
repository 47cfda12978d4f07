"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from orientlake.llm.bloom import Bloom
from orientlake.llm.common import keep_columns
from orientlake.operators.ordered import number_rows
from orientlake.session import cut, shuffle_width

_BANDS = 32


def source_targets(per_source: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """Add ``target`` to (source, source_size): a weighted share of the whole, at most ``cap`` times the source.

    Sources get the weights in turn, in ascending order, null last. A share
    above its cap is cut and the excess is shared again by weight, until none
    is above; the shares left uncapped are then weight times one level. Each
    round brings three sums to the driver.
    """
    order = per_source.select(F.col("source").isNull().alias("last"), "source").distinct()
    number = number_rows(order, ["last", "source"], "place")
    weight = F.element_at(F.lit([float(w) for w in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    table = cut(per_source.alias("s").join(number.alias("o"), F.col("s.source").eqNullSafe(F.col("o.source"))).select(
        F.col("s.source").alias("source"), "source_size", weight.alias("weight"), (cap * F.col("source_size")).alias("most")), "sources")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, before = 0.0, -1
    while True:
        over = F.col("most") <= F.col("weight") * F.lit(level) if before >= 0 else F.lit(False)
        full, free, n = table.agg(F.sum(F.when(over, F.col("most")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))),
                                  F.sum(over.cast("int"))).first()
        if not free or n == before:
            break
        level, before = (total - full) / free, n
    target = F.least("most", F.col("weight") * F.lit(level)) if free else F.col("most")
    return table.select("source", "source_size", target.alias("target"))


def _rates(classes: DataFrame, targets: DataFrame, cap: float, steps: int, tolerance: float) -> DataFrame:
    """Tilt of each source: Newton steps on the dual, one pair of sums per source and step.

    The rates r = min(cap, exp(t * size / mean)) have least relative entropy
    to 1 among all rates up to ``cap`` whose sizes add up to the target; the
    multiplier t is the root of the dual's gradient. Every step keeps a
    bracket of the root and halves it where Newton would leave it.
    """
    facts = classes.groupBy("source").agg(F.sum("n").alias("docs"), F.sum(F.col("n") * F.col("size")).alias("sum"), F.min("size").alias("low"))
    ask = F.col("target") / F.col("sum")
    least = F.col("low") * F.col("docs") / F.col("sum")
    state = targets.alias("t").join(facts.alias("f"), F.col("t.source").eqNullSafe(F.col("f.source"))).select(
        F.col("f.source").alias("source"), "target", (F.col("sum") / F.col("docs")).alias("mean"),
        (ask >= cap * (1 - 1e-12)).alias("full"), F.lit(0.0).alias("t"),
        F.when(ask < 1, F.log(F.greatest(ask, F.lit(1e-300))) / least).otherwise(0.0).alias("lo"),
        F.when(ask > 1, F.lit(math.log(cap)) / least).otherwise(0.0).alias("hi"))
    state = cut(state, "tilt")
    for _ in range(steps):
        r, free = _rate(cap)
        sums = classes.alias("c").join(state.alias("s"), F.col("c.source").eqNullSafe(F.col("s.source"))).select(
            F.col("s.source").alias("source"), (F.col("n") * F.col("size") * r).alias("got"),
            F.when(free, F.col("n") * F.col("size") * r * F.col("size") / F.col("mean")).otherwise(0.0).alias("slope"))
        sums = sums.groupBy("source").agg(F.sum("got").alias("got"), F.sum("slope").alias("slope"))
        miss = F.col("got") - F.col("target")
        lo, hi = F.when(miss < 0, F.col("t")).otherwise(F.col("lo")), F.when(miss > 0, F.col("t")).otherwise(F.col("hi"))
        moved = F.col("t") - F.try_divide(miss, F.col("slope"))
        state = cut(state.alias("s").join(sums.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source"))).select(
            F.col("s.source").alias("source"), "target", "mean", "full", "t", lo.alias("lo"), hi.alias("hi"), moved.alias("to"), miss.alias("miss")
        ).select("source", "target", "mean", "full", F.when(F.abs("miss") <= tolerance * F.col("target"), F.col("t")).when(
            (F.col("to") > F.col("lo")) & (F.col("to") < F.col("hi")), F.col("to")).otherwise((F.col("lo") + F.col("hi")) / 2).alias("t"),
            "lo", "hi", (F.abs("miss") > tolerance * F.col("target")).alias("open")), "tilt")
        if not state.where("open and not full").take(1):
            break
        state = state.drop("open")
    # the last digits depend on the order of sums
    return state.select("source", "mean", "full", F.round("t", 9).alias("t"))


def _rate(cap: float) -> tuple[Column, Column]:
    power = F.col("t") * F.col("size") / F.col("mean")
    free = ~F.col("full") & (power < math.log(cap))
    return F.when(free, F.exp(F.least(power, F.lit(math.log(cap))))).otherwise(F.lit(cap)), free


def mix_sources(rows: DataFrame, key: str = "micrograph", source: str = "optics_group", size: str = "n_particles",
                weights: Sequence[float] = (5, 2, 1), cap: int = 3, steps: int = 60, tolerance: float = 1e-7) -> DataFrame:
    """How often each row enters a mix in which sources have their target shares.

    Takes any table with a key, a source and a whole-numbered size: the
    micrographs of several optics groups with their particle counts, or texts
    with their words. Returns per row ``key``, ``source``, ``size``,
    ``source_size``, ``target`` (see ``source_targets``), ``rate`` (the
    exponential tilt) and ``copies``, a whole number from 0 to ``cap``.

    Method: rows are counted by (source, size); all sums run over these
    counts. Newton steps find the tilt of every source at once. Rates become
    whole copies per (source, size); what is left of a source's target is then
    settled on at most two sizes out of each narrow band of sizes, the largest first. Inside a (source, size) the copies are
    dealt evenly over the rows by number, which comes from a range
    partitioning, so one size with a third of all rows is still spread.

    Null source: a source of its own, the last. Null or negative size: 0. A
    row of size 0 gets one copy and moves nothing. A null key is a key like
    any other. Repeated rows count as rows of their own and all come back;
    which of them gets a copy more is not told apart. No rows: empty result.
    """
    docs = keep_columns(rows, key, source, size, where="rows").select(
        F.col(key).alias("key"), F.col(source).alias("source"), F.greatest(F.coalesce(F.col(size).cast("bigint"), F.lit(0)), F.lit(0)).alias("size"))
    numbered = cut(number_rows(docs, ["source", "size", "key"], "number"), "mixed")
    classes = cut(numbered.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"), F.min("number").alias("start")), "classes")
    per_source = classes.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    targets = cut(source_targets(per_source, weights, cap), "targets")
    sized = classes.where("size > 0")
    tilt = _rates(sized, targets, float(cap), steps, tolerance)
    rate, _ = _rate(float(cap))
    rated = sized.alias("c").join(tilt.alias("t"), F.col("c.source").eqNullSafe(F.col("t.source"))).select(
        F.col("c.source").alias("source"), "size", "n", rate.alias("rate"))
    plan = cut(_whole_copies(rated, targets, cap), "plan")
    full = classes.alias("c").join(plan.alias("p"), F.col("c.source").eqNullSafe(F.col("p.source")) & (F.col("c.size") == F.col("p.size")), "left").select(
        F.col("c.source").alias("source"), F.col("c.size").alias("size"), F.col("c.n").alias("n"), "start",
        F.coalesce("rate", F.lit(1.0)).alias("rate"), F.coalesce("m", F.col("c.n")).alias("m"))
    full = full.alias("c").join(targets.alias("t"), F.col("c.source").eqNullSafe(F.col("t.source"))).select("c.*", "source_size", "target")
    copies = F.expr("((number - start + 1) * m) div n - ((number - start) * m) div n")
    return numbered.alias("d").join(full.alias("c"), F.col("d.source").eqNullSafe(F.col("c.source")) & (F.col("d.size") == F.col("c.size"))).select(
        F.col("d.key").alias(key), F.col("d.source").alias(source), F.col("d.size").alias(size), "source_size", "target", "rate", copies.alias("copies"))


def _whole_copies(rated: DataFrame, targets: DataFrame, cap: int) -> DataFrame:
    """Whole copies ``m`` for the ``n`` rows of each (source, size), so that sizes come as near to the target as they can.

    Each (source, size) rounds its own count. The rest of a source goes to two
    sizes per band at most (the one with most copies and the one with most
    room), ``_BANDS`` bands to a power of two, so the list of a source is bounded.
    """
    base = rated.withColumn("m", F.least(F.round(F.col("n") * F.col("rate")), F.col("n") * F.lit(cap)).cast("bigint"))
    got = base.groupBy("source").agg(F.sum(F.col("m") * F.col("size")).alias("got"))
    one = F.struct("size", "n", "m")
    steps = base.groupBy("source", F.floor(_BANDS * F.log2("size")).alias("band")).agg(
        F.max_by(one, F.struct("m", -F.col("size"))).alias("less"), F.max_by(one, F.struct(F.col("n") * cap - F.col("m"), -F.col("size"))).alias("more"))
    ladder = steps.groupBy("source").agg(F.sort_array(F.array_distinct(F.concat(F.collect_list("less"), F.collect_list("more"))), asc=False).alias("ladder"))
    state = ladder.alias("l").join(got.alias("g"), F.col("l.source").eqNullSafe(F.col("g.source"))).join(
        targets.alias("t"), F.col("l.source").eqNullSafe(F.col("t.source"))).select(
        F.col("l.source").alias("source"), "ladder", F.round(F.col("target") - F.col("got")).cast("bigint").alias("rest"))

    def settle(done: Column, s: Column) -> Column:
        # half a size more decides the rounding; division truncates toward zero
        want = F.round(done["rest"] / s["size"]).cast("bigint")
        step = F.greatest(F.least(want, s["n"] * cap - s["m"]), -s["m"])
        return F.struct((done["rest"] - step * s["size"]).alias("rest"),
                        F.concat(done["given"], F.array(F.struct(s["size"].alias("size"), step.alias("more")))).alias("given"))

    none = F.from_json(F.lit("[]"), "array<struct<size:bigint,more:bigint>>")
    given = F.aggregate("ladder", F.struct(F.col("rest").alias("rest"), none.alias("given")), settle)
    more = state.select("source", F.inline(given["given"]))
    return base.alias("b").join(more.alias("m"), F.col("b.source").eqNullSafe(F.col("m.source")) & (F.col("b.size") == F.col("m.size")), "left").select(
        F.col("b.source").alias("source"), F.col("b.size").alias("size"), "n", "rate", (F.col("b.m") + F.coalesce("more", F.lit(0))).alias("m"))


def word_count(text: str) -> Column:
    """Words of a text column: runs of anything but blanks and the control characters 9 to 13; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def repeat_rows(rows: DataFrame, mixed: DataFrame, key: str) -> DataFrame:
    """The rows of a table as often as ``copies`` says, with all their columns, whatever these are called.

    Rows that repeat a key (null is a key like any other) share its copies in
    sum, dealt evenly over them in the order of a hash of the whole row.
    Only these rows are numbered: they are laid out by key and hash over all
    tasks, numbered within a task, and the numbers of the tasks before are
    added, so a key that a third of all rows have is no task of its own. Rows
    whose key is surely not repeated are moved once at most, to meet their
    copies. A key that ``mixed`` does not have is left out. No rows: an empty
    result.
    """
    if rows.columns.count(key) != 1:
        raise ValueError(f"need one column {key}")
    spark = rows.sparkSession
    held = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"))
    own = F.col(f"row.`{key}`")
    per_key = cut(mixed.groupBy(F.col(key).alias("key")).agg(F.sum("copies").alias("copies")).join(
        rows.groupBy(F.col(f"`{key}`").alias("of")).agg(F.count(F.lit(1)).alias("rows")), F.col("key").eqNullSafe(F.col("of"))).select(F.col("of").alias("key"), "copies", "rows"), "per-key")

    def met(some: DataFrame, copies: DataFrame) -> DataFrame:
        return some.join(copies, own.eqNullSafe(F.col("key")))

    def repeated(some: DataFrame) -> DataFrame:
        return some.select("row", F.explode(F.array_repeat(F.lit(0), F.col("times"))).alias("copy")).select("row.*")

    many = cut(per_key.where("rows > 1"), "many")
    once = F.col("copies").cast("int").alias("times")
    if not many.take(1):
        return repeated(met(held, per_key).select("row", once))
    bloom = Bloom(many.select(F.xxhash64("key")))
    clear, doubtful = (bloom.filter(held, F.xxhash64(own), inside) for inside in (False, True))
    single = met(clear, per_key).select("row", once).unionByName(met(doubtful, per_key.where("rows = 1")).select("row", once))
    # equal rows may stand in any order
    order = [F.col("key").asc_nulls_first(), F.col("hash").asc(), F.col("tie").asc()]
    laid = cut(met(doubtful, many).select("row", "key", "copies", "rows", F.xxhash64("row").alias("hash"), F.pmod(F.monotonically_increasing_id(), F.lit(64)).alias("tie"))
               .repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "repeated")
    task = F.shiftright("place", 33)
    first = laid.groupBy("key", task.alias("task")).agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    before = first.select("key", "task", "first", F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    numbered = laid.alias("r").join(before.alias("b"), F.col("r.key").eqNullSafe(F.col("b.key")) & (F.shiftright(F.col("r.place"), 33) == F.col("b.task"))).select(
        "row", "copies", "rows", (F.col("place") - F.col("first") + F.col("before") + 1).alias("i"))
    shared = numbered.select("row", F.expr("cast((i * copies) div rows - ((i - 1) * copies) div rows as int)").alias("times"))
    return repeated(single.unionByName(shared))
