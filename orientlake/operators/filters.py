"""Row selection on particle and metric tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from orientlake.frames import finite, require_columns
from orientlake.operators.ordered import grouped_quantiles, ordered_rank

COMPARISONS = ("gt", "lt", "ge", "le", "eq")


def select_subset(df: DataFrame, col: str, op: str, value: str, sort: bool = False) -> DataFrame:
    """Rows whose ``col`` compares as asked with ``value`` read as the type of the column."""
    require_columns(df, [col], "select_subset")
    if op not in COMPARISONS:
        raise ValueError(f"comparison must be one of {COMPARISONS}")
    kind = df.schema[col].dataType
    literal = F.lit(value == "True") if isinstance(kind, T.BooleanType) else F.lit(value).cast(kind)
    c = F.col(col)
    test = {"gt": c > literal, "lt": c < literal, "ge": c >= literal, "le": c <= literal, "eq": c == literal}[op]
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        test = test & ~F.isnan(c)
    kept = df.where(test)
    return kept.orderBy(col) if sort else kept


def first_rows(df: DataFrame, row_no: str, n: int) -> DataFrame:
    """First n rows of the file order held in ``row_no`` (from 1)."""
    return df.where(F.col(row_no) <= n)


def half_filter(df: DataFrame, half: int, col: str = "half") -> DataFrame:
    if half not in (1, 2):
        raise ValueError("half must be 1 or 2")
    checked = F.when(F.col(col).isin(1, 2), F.col(col)).otherwise(
        F.raise_error(F.lit("half-set values must be 1 or 2")).cast("bigint"))
    return df.where(checked == half)


def subset_by_index(df: DataFrame, positions: DataFrame, row_no: str, half: str | None = None) -> DataFrame:
    """Rows at the given 0-based positions of each half's own order; positions out of range find nothing.

    ``positions`` has column ``position`` and, when ``half`` is given, that column too.
    """
    group = [half] if half else []
    placed = ordered_rank(df, row_no, "_rank", group).drop("_rank_total").withColumn("position", F.col("_rank") - 1)
    return placed.join(positions, [*group, "position"], "left_semi").drop("_rank", "position")


def min_confidence(df: DataFrame, col: str, least: float) -> DataFrame:
    """Rows with at least the given confidence; all rows when the table has no such column."""
    if col not in df.columns:
        return df
    return df.where((F.col(col) >= least) & ~F.isnan(col))


def existing_only(df: DataFrame, stack: Column, listing: DataFrame) -> DataFrame:
    """Rows whose stack file is in ``listing`` (column ``path``)."""
    return df.withColumn("_path", stack).join(
        listing.select(F.col("path").alias("_path")), "_path", "left_semi").drop("_path")


def score_filter(df: DataFrame, col: str, threshold: float) -> DataFrame:
    """Strictly above the threshold; a missing or NaN score never passes."""
    c = F.col(col)
    return df.where(c.isNotNull() & ~F.isnan(c) & (c > threshold))


def skip_steps(df: DataFrame, step: str, skip: int) -> DataFrame:
    if skip <= 0 or step not in df.columns:
        return df
    first = df.agg(F.min(step).alias("m")).scalar()
    return df.where(F.col(step) >= first + F.lit(skip))


def clip_quantiles(df: DataFrame, col: str, low: float, high: float, name: str) -> DataFrame:
    """Values clipped to two exact quantiles; every row stays."""
    q = grouped_quantiles(df.where(finite(F.col(col))).select(col), col, {"lo": low, "hi": high})
    return df.withColumns({"_lo": q.select("lo").scalar(), "_hi": q.select("hi").scalar()}).withColumn(
        name, F.least(F.greatest(F.col(col), F.col("_lo")), F.col("_hi"))).drop("_lo", "_hi")
