"""Summaries, histograms, rank statistics and calibration measures of scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from orientlake.frames import finite
from orientlake.operators.ordered import average_ranks, counted_values, grouped_quantiles, prefix_sums
from orientlake.session import cut


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: count, mean, median, least, largest and population spread of its numbers."""
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns]))).where(finite(F.col("v")))
    stats = long.groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.min("v").alias("min"),
                                       F.max("v").alias("max"), F.stddev_pop("v").alias("std"))
    return stats.join(grouped_quantiles(long, "v", {"median": .5}, ["column"]), "column")


def histogram(df: DataFrame, col: str, bins: int, low: Column | None = None, high: Column | None = None,
              group: list[str] = ()) -> DataFrame:
    """Counts and percentages in equal bins over [low, high], last bin closed; the column's range by default."""
    rows = df.where(finite(F.col(col)))
    lo = low if low is not None else rows.agg(F.min(col)).scalar()
    hi = high if high is not None else rows.agg(F.max(col)).scalar()
    placed = rows.select(*group, F.col(col).alias("_v")).withColumns({"_lo": lo, "_hi": hi})
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    flat = F.col("_hi") <= F.col("_lo")
    bin_no = F.when(flat, F.lit(0)).otherwise(F.least(F.floor((F.col("_v") - F.col("_lo")) / width), F.lit(bins - 1)))
    counts = placed.where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))).groupBy(
        *group, bin_no.cast("bigint").alias("bin"), (F.col("_lo") + F.lit(0.0)).alias("lo"), width.alias("width")).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*group).agg(F.sum("n").alias("_t")) if group else None
    out = counts.join(totals, list(group)) if group else counts.withColumn("_t", counts.agg(F.sum("n")).scalar())
    return out.select(*group, "bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("edge"), "n",
                      (F.col("n") * 100.0 / F.col("_t")).alias("pct"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation with average ranks; NULL below three rows or without variance."""
    rows = df.where(finite(F.col(x)) & finite(F.col(y))).select(x, y)
    pairs = rows.groupBy(x, y).agg(F.count(F.lit(1)).alias("_n"))
    rx = average_ranks(rows, x).select(x, F.col("rank").alias("_rx"))
    ry = average_ranks(rows, y).select(y, F.col("rank").alias("_ry"))
    m = pairs.join(rx, x).join(ry, y)
    n = F.sum("_n").cast("double")
    mean = (n + 1) / 2
    def moment(a, b):
        return F.sum(F.col("_n") * F.col(a) * F.col(b)) - n * mean * mean
    sxx, syy, sxy = moment("_rx", "_rx"), moment("_ry", "_ry"), moment("_rx", "_ry")
    return m.agg(F.when((n >= 3) & (sxx > 0) & (syy > 0), sxy / F.sqrt(sxx * syy)).alias("spearman"), n.cast("bigint").alias("n"))


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    rows = df.where(finite(F.col(x)) & finite(F.col(y)))
    n = F.count(F.lit(1))
    ok = (n >= 3) & (F.var_pop(x) > 0) & (F.var_pop(y) > 0)
    return rows.agg(F.when(ok, F.corr(x, y)).alias("pearson"), n.alias("n"))


def _by_score(df: DataFrame, score: str, label: str) -> DataFrame:
    rows = df.where(finite(F.col(score)) & F.col(label).isNotNull())
    counts = cut(counted_values(rows, score, pos=F.col(label).cast("bigint")), "counts")
    return prefix_sums(counts, [score], ["n", "pos"], by=score)


def ranking_measures(df: DataFrame, score: str, label: str) -> DataFrame:
    """roc_auc (ties counted half) and pr_auc (average precision over distinct thresholds); NULL with one class only."""
    r = _by_score(df, score, label)
    p, n = F.max("pos_total").cast("double"), F.max("n_total").cast("double")
    both = (p > 0) & (p < n)
    rank_sum = F.sum(F.col("pos") * (F.col("n_before") + (F.col("n") + 1) / 2.0))
    above = (F.col("n_total") - F.col("n_before")).cast("double")
    hits = (F.col("pos_total") - F.col("pos_before")).cast("double")
    return r.agg(F.when(both, (rank_sum - p * (p + 1) / 2) / (p * (n - p))).alias("roc_auc"),
                 F.when(both, F.sum(F.col("pos") / F.col("pos_total") * hits / above)).alias("pr_auc"))


def roc_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    return ranking_measures(df, score, label).select("roc_auc")


def pr_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    return ranking_measures(df, score, label).select("pr_auc")


def youden(df: DataFrame, score: str, label: str, fn_cost: float = 2.0) -> DataFrame:
    """Threshold with the largest true-positive rate minus false-positive rate over ``fn_cost``, highest on ties."""
    r = _by_score(df, score, label)
    tp = (F.col("pos_total") - F.col("pos_before")) / F.col("pos_total").cast("double")
    fp = ((F.col("n_total") - F.col("n_before")) - (F.col("pos_total") - F.col("pos_before"))) / (F.col("n_total") - F.col("pos_total")).cast("double")
    j = F.round(tp - fp / fn_cost, 12)
    best = r.agg(F.max(F.struct(j.alias("j"), F.col(score).alias("t"))).alias("b"))
    return best.select(F.when(F.col("b.j") > 0, F.col("b.t")).otherwise(F.lit(float("inf"))).alias("threshold"),
                       F.greatest(F.col("b.j"), F.lit(0.0)).alias("quality"))


def brier(df: DataFrame, p: str, y: str) -> DataFrame:
    rows = df.where(finite(F.col(p)))
    gap = F.col(p) - F.col(y)
    return rows.agg(F.avg(gap * gap).alias("brier"))


def log_loss(df: DataFrame, p: str, y: str) -> DataFrame:
    rows = df.where(finite(F.col(p)))
    c = F.least(F.greatest(F.col(p), F.lit(1e-6)), F.lit(1 - 1e-6))
    loss = F.when(F.col(y) == 1, -F.ln(c)).otherwise(-F.ln(F.lit(1.0) - c))
    return rows.agg(F.when(F.min(y) < F.max(y), F.avg(loss)).alias("logloss"))


def calibration_error(df: DataFrame, p: str, y: str, bins: int = 15) -> DataFrame:
    """Expected calibration error over equal bins of [0, 1], last one closed."""
    rows = df.where(finite(F.col(p)) & (F.col(p) >= 0) & (F.col(p) <= 1))
    per_bin = rows.groupBy(F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).alias("_b")).agg(
        F.count(F.lit(1)).alias("_n"), F.avg(p).alias("_p"), F.avg(F.col(y).cast("double")).alias("_y"))
    return per_bin.agg((F.sum(F.col("_n") * F.abs(F.col("_y") - F.col("_p"))) / F.sum("_n")).alias("ece"))


def quantile_bin_count(n: int, bins: int) -> int:
    return min(bins, max(2, n // 200))


def with_quantile_bin(df: DataFrame, col: str, bins: int) -> DataFrame:
    """Add ``bin`` from 1: right-closed intervals between distinct quantile edges, the lowest value in the first."""
    n = df.count()
    q = quantile_bin_count(n, bins)
    edges = grouped_quantiles(df.select(col), col, {f"e{i}": i / q for i in range(q + 1)})
    array = edges.select(F.array_sort(F.array_distinct(F.array(*[f"e{i}" for i in range(q + 1)]))).alias("e")).scalar()
    below = F.size(F.filter("_edges", lambda e: e < F.col(col)))
    return df.withColumn("_edges", array).withColumn("bin", F.greatest(below, F.lit(1)).cast("bigint")).drop("_edges")


def quantile_bins(df: DataFrame, score: str, label: str, err: str, bins: int = 15) -> DataFrame:
    """Per score quantile bin: rows, mean score, accuracy, mean and median error."""
    rows = with_quantile_bin(df.where(finite(F.col(score)) & finite(F.col(err))), score, bins)
    stats = rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("score_mean"),
                                    F.avg(F.col(label).cast("double")).alias("acc"), F.avg(err).alias("err_mean"))
    return stats.join(grouped_quantiles(rows.select("bin", err), err, {"err_median": .5}, ["bin"]), "bin")


def reliability(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    rows = with_quantile_bin(df.where(finite(F.col(p))), p, bins)
    return rows.groupBy("bin").agg(F.avg(p).alias("p_mean"), F.avg(F.col(y).cast("double")).alias("y_mean"))


def robust_limits(df: DataFrame, col: str, group: list[str], low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Axis limits per group: two quantiles widened by a tenth; positive numbers only once any is not positive."""
    rows = df.where(finite(F.col(col)))
    any_low = rows.groupBy(*group).agg((F.min(col) <= 0).alias("_neg"))
    kept = rows.join(any_low, group).where(~F.col("_neg") | (F.col(col) > 0)).select(*group, col)
    q = grouped_quantiles(kept, col, {"lo": low, "hi": high}, group)
    pad = (F.col("hi") - F.col("lo")) * 0.1
    wide = F.col("hi") > F.col("lo")
    return q.select(*group, F.when(wide, F.col("lo") - pad).alias("y_min"), F.when(wide, F.col("hi") + pad).alias("y_max"))
