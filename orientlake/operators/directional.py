"""Score statistics per view-direction cone."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from orientlake.operators.ordered import grouped_quantiles
from orientlake.session import cut


def fit(df: DataFrame, n_cones: int, cone: str = "cone", score: str = "score", true_cone: str | None = None,
        top: float = 0.95, least: int = 10) -> DataFrame:
    """Median and MAD of the scores per cone, one row for each of ``n_cones``.

    A cone uses the scores of rows whose true cone agrees if there are enough,
    else its top scores, else all. Cones without rows get the median over cones.
    """
    rows = cut(df.where(F.col(score).isNotNull()).select(
        F.col(cone).alias("cone"), F.col(score).alias("s"),
        (F.col(true_cone) == F.col(cone) if true_cone else F.lit(False)).alias("good")), "scores")
    counts = rows.groupBy("cone").agg(F.count(F.lit(1)).alias("n_all"), F.count(F.when(F.col("good"), 1)).alias("n_good"))
    edge = grouped_quantiles(rows.select("cone", "s"), "s", {"edge": top}, ["cone"])
    rule = counts.join(edge, "cone")
    chosen = cut(rows.join(rule, "cone").where(
        F.when(F.col("n_good") >= least, F.col("good"))
        .when((F.col("n_all") >= least), F.col("s") >= F.col("edge")).otherwise(F.lit(True))).select("cone", "s"), "chosen")
    med = cut(grouped_quantiles(chosen, "s", {"median": .5}, ["cone"]), "medians")
    gaps = chosen.join(med, "cone").select("cone", F.abs(F.col("s") - F.col("median")).alias("g"))
    mad = grouped_quantiles(gaps, "g", {"mad": .5}, ["cone"]).withColumn("mad", F.greatest("mad", F.lit(1e-8)))
    stats = cut(med.join(mad, "cone"), "cones")
    # medians over cones: at most n_cones rows
    overall = stats.agg(F.median("median").alias("m"), F.greatest(F.median("mad"), F.lit(1e-8)).alias("d"))
    cones = df.sparkSession.range(n_cones).withColumnRenamed("id", "cone")
    return cones.join(stats, "cone", "left").withColumns({
        "median": F.coalesce("median", overall.select("m").scalar()), "mad": F.coalesce("mad", overall.select("d").scalar())})


def zscores(df: DataFrame, stats: DataFrame, cone: str = "cone", score: str = "score", name: str = "z") -> DataFrame:
    s = stats.select(F.col("cone").alias(cone), F.col("median").alias("_m"), F.col("mad").alias("_d"))
    return df.join(s, cone).withColumn(name, (F.col(score) - F.col("_m")) / F.col("_d")).drop("_m", "_d")
