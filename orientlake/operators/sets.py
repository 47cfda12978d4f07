"""Union, splitting, sampling and regrouping of particle tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from orientlake.operators.ordered import number_rows, ordered_rank, prefix_sums, seeded_rank, value_bucket
from orientlake.session import cut


def join_tables(particles: list[DataFrame]) -> DataFrame:
    """Bag union; columns missing in one table become NULL there."""
    out = particles[0]
    for p in particles[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def join_optics(optics: list[DataFrame], group: str = "optics_group") -> DataFrame:
    """Distinct optics rows; two definitions of one group raise an error when read."""
    rows = join_tables(optics).distinct()
    counts = rows.groupBy(F.col(group).alias("_g")).agg(F.count(F.lit(1)).alias("_n"))
    one = F.when(F.col("_n") == 1, F.col(group)).otherwise(
        F.raise_error(F.concat(F.lit("optics group with two definitions: "), F.col(group).cast("string"))).cast("bigint"))
    return rows.join(counts, F.col(group) == F.col("_g")).withColumn(group, one).drop("_g", "_n")


def first_optics(optics: list[DataFrame], group: str = "optics_group") -> DataFrame:
    """Per group the definition of the first table that has it."""
    tagged = None
    for i, o in enumerate(optics):
        t = o.withColumn("_file", F.lit(i))
        tagged = t if tagged is None else tagged.unionByName(t, allowMissingColumns=True)
    rest = [c for c in tagged.columns if c not in (group, "_file")]
    best = tagged.groupBy(group).agg(F.min(F.struct("_file", *rest)).alias("b"))
    return best.select(group, *[F.col(f"b.{c}").alias(c) for c in rest])


def half_of_file(path: F.Column) -> F.Column:
    """Half-set named at the end of an output file."""
    return F.regexp_extract(path, r"half(?:set)?_?([12])(?:[._]|$)", 1).cast("bigint")


def merge_halves(frames: dict[str, DataFrame], optics: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Output tables by file name, merged with a half label; optics without repeats."""
    parts = [df.withColumn("half", half_of_file(F.lit(name))) for name, df in frames.items()]
    return join_tables(parts), join_tables(optics).distinct()


def split(df: DataFrame, key: str, n: int) -> DataFrame:
    """``chunk`` 1..n in seeded order; sizes differ by at most one, larger first."""
    ranked = seeded_rank(df, key, "_k")
    small = F.expr(f"_k_total div {n}")
    large = F.expr(f"_k_total % {n}")
    border = large * (small + 1)
    zero = F.col("_k") - 1
    chunk = F.when(zero < border, F.floor(zero / (small + 1))).otherwise(large + F.floor((zero - border) / F.greatest(small, F.lit(1))))
    return ranked.withColumn("chunk", (chunk + 1).cast("bigint")).drop("_k", "_k_total")


def assign_halves(df: DataFrame, key: str, name: str = "half") -> DataFrame:
    """Exact 50/50 half-sets in seeded order, unless the table has them."""
    if name in df.columns:
        return df
    return split(df, key, 2).withColumnRenamed("chunk", name)


def train_validation(datasets: list[DataFrame], key: str, train: float = 0.7, validation_from: Sequence[int] = (0,)) -> DataFrame:
    """``split`` = train or validation per dataset; only the datasets in ``validation_from`` give validation rows.

    What is not drawn for training from any other dataset is labelled unused, so every row comes back.
    """
    out = None
    for i, d in enumerate(datasets):
        ranked = seeded_rank(d, key, "_k")
        is_train = F.col("_k") <= F.round(F.lit(float(train)) * F.col("_k_total"))
        rest = "validation" if i in validation_from else "unused"
        part = ranked.withColumns({"dataset": F.lit(i).cast("bigint"), "split": F.when(is_train, "train").otherwise(rest)}).drop("_k", "_k_total")
        out = part if out is None else out.unionByName(part)
    return out


def sample_exact(df: DataFrame, key: str, fraction: float) -> DataFrame:
    """Reproducible sample of round(n * fraction) rows."""
    return seeded_rank(df, key, "_k").where(F.col("_k") <= F.round(F.lit(float(fraction)) * F.col("_k_total"))).drop("_k", "_k_total")


def thin(df: DataFrame, key: str, inside: F.Column, drop_fraction: float) -> DataFrame:
    """All rows outside, and an exact share of the rows inside, a region."""
    ranked = seeded_rank(df.withColumn("_in", F.coalesce(inside, F.lit(False))), key, "_k", ["_in"])
    kept = F.col("_k") <= F.round(F.lit(1.0 - drop_fraction) * F.col("_k_total"))
    return ranked.where(~F.col("_in") | kept).drop("_in", "_k", "_k_total")


def prune_optics(optics: DataFrame, particles: DataFrame, group: str = "optics_group") -> DataFrame:
    """Optics rows that are used; a used group without a row raises an error."""
    used = particles.select(group).distinct()
    missing = used.join(optics, group, "left_anti").take(10)
    if missing:
        raise ValueError(f"particles use optics groups without a row: {[r[0] for r in missing]}")
    return optics.join(used, group, "left_semi")


def regroup_stacks(df: DataFrame, target: int, key: str = "pid", group: tuple[str, str] = ("optics_group", "micrograph")) -> DataFrame:
    """New stack number and 1-based place in it, whole groups in order, each stack closed before it would overflow.

    Where a stack starting at a group ends is a look-up among running sums.
    The starts that are really used are then found by doubling jumps, a number
    of rounds that grows with the logarithm of the number of stacks, so no
    task ever walks all groups.
    """
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("size"))
    ordered = number_rows(sizes, [*group, "size"], "ord")
    summed = cut(prefix_sums(ordered, ["ord"], ["size"], by="ord").select("ord", *group, "size", F.col("size_before").alias("start"))
                 .withColumn("end", F.col("start") + F.col("size")), "groups")
    limits = summed.select((F.col("start") + target).alias("v"), F.lit(0).cast("bigint").alias("point"), "ord")
    ends = summed.select(F.col("end").alias("v"), F.lit(1).cast("bigint").alias("point"), "ord")
    events = prefix_sums(limits.unionByName(ends), ["v", F.col("point").desc(), "ord"], ["point"], by="v")
    jump = events.where("point = 0").select("ord", F.greatest(F.col("point_before") + 1, F.col("ord") + 1).alias("next"))
    jump = cut(jump, "jump")
    starts = jump.where("ord = 1").select("ord")
    known = starts.count()
    while True:
        reached = cut(starts.unionByName(starts.join(jump, "ord").select(F.col("next").alias("ord"))).distinct()
                      .join(summed.select("ord"), "ord", "left_semi"), "starts")
        n = reached.count()
        if n == known:
            break
        known, starts = n, reached
        far = jump.select(F.col("ord").alias("next"), F.col("next").alias("far"))
        jump = cut(jump.join(far, "next").select("ord", F.col("far").alias("next")), "jump")
    marked = summed.join(starts.withColumn("mark", F.lit(1).cast("bigint")), "ord", "left").fillna(0, ["mark"])
    stacked = prefix_sums(marked, ["ord"], ["mark"], by="ord").withColumn("new_stack", F.col("mark_before") + F.col("mark"))
    first = stacked.where("mark = 1").select("new_stack", F.col("start").alias("stack_start"))
    place = stacked.join(first, "new_stack").select(*group, "new_stack", (F.col("start") - F.col("stack_start")).alias("_off"))
    ranked = ordered_rank(df, key, "_k", list(group)).drop("_k_total")
    return ranked.join(place, list(group)).withColumn("new_index", F.col("_off") + F.col("_k")).drop("_off", "_k")


def in_order_of(df: DataFrame, first: DataFrame, key: str, order: str = "file_order", name: str = "place") -> DataFrame:
    """Rows of ``df`` with their place (from 1) in the order that their keys have in ``first``.

    Keys that ``first`` does not hold come last, by key. Sort by ``name`` on
    writing; the place itself needs no global sort. ``df`` is written once,
    since its rows are read for the places and for the result.
    """
    df = cut(df, "ordered")
    known = first.select(F.col(key).alias("_key"), F.col(order).alias("_order"))
    rows = df.join(known, F.col(key) == F.col("_key"), "left").drop("_key").withColumn("_last", F.col("_order").isNull())
    places = number_rows(rows.select("_last", "_order", key), ["_last", "_order", key], name)
    return df.join(places.select(name, F.col(key).alias("_key")), F.col(key) == F.col("_key")).drop("_key")
