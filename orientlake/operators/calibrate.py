"""Logistic calibration of scores and the report built on it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from orientlake.frames import finite
from orientlake.functions.optics import logistic
from orientlake.operators import stats as S
from orientlake.operators.filters import clip_quantiles
from orientlake.operators.ordered import seeded_rank
from orientlake.session import cut


def logistic_fit(df: DataFrame, score: str, label: str, ridge: float = 1.0, rounds: int = 25) -> tuple[float, float]:
    """(slope, intercept) of a logistic curve with a penalty of ``ridge`` / 2 on the squared slope.

    Newton steps over one row per distinct (score, label): each round is one
    aggregate of five sums, and a 2 x 2 solve on the driver.
    """
    points = cut(df.where(finite(F.col(score))).groupBy(score, label).agg(F.count(F.lit(1)).alias("n")), "points")
    a = b = 0.0
    for _ in range(rounds):
        p = logistic(F.lit(a) * F.col(score) + F.lit(b))
        g = F.col("n") * (F.col(label) - p)
        w = F.col("n") * p * (F.lit(1.0) - p)
        s = points.agg(F.sum(g * F.col(score)), F.sum(g), F.sum(w * F.col(score) * F.col(score)), F.sum(w * F.col(score)), F.sum(w)).first()
        hess = np.array([[s[2] + ridge, s[3]], [s[3], s[4]]])
        step = np.linalg.solve(hess + 1e-12 * np.eye(2), np.array([s[0] - ridge * a, s[1]]))
        a, b = a + float(step[0]), b + float(step[1])
        if np.abs(step).max() < 1e-10:
            break
    return a, b


def stratified_split(df: DataFrame, key: str, label: str, test: float = 0.3) -> DataFrame:
    """Column ``is_test``: the same share of each class in seeded order."""
    ranked = seeded_rank(df, key, "_k", [label])
    return ranked.withColumn("is_test", F.col("_k") <= F.round(F.lit(float(test)) * F.col("_k_total"))).drop("_k", "_k_total")


def evaluate(df: DataFrame, score: str, label: str, err: str, key: str, winsor: float = 0.0) -> DataFrame | None:
    """One row of ranking and held-out calibration figures for one score; None when there is nothing to fit."""
    rows = df.where(finite(F.col(score)) & finite(F.col(err))).select(key, F.col(score).alias("s"), F.col(label).alias("y"), F.col(err).alias("e"))
    if winsor:
        rows = clip_quantiles(rows, "s", winsor, 1 - winsor, "f")
    else:
        rows = rows.withColumn("f", F.col("s"))
    rows = cut(stratified_split(rows, key, "y"), "scored")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p"), F.min(F.when(~F.col("is_test"), F.col("f"))).alias("lo"),
                    F.max(F.when(~F.col("is_test"), F.col("f"))).alias("hi")).first()
    if size["n"] < 10 or size["p"] in (0, size["n"]):
        return None
    a, b = logistic_fit(rows.where("not is_test"), "f", "y")
    span = F.lit(size["hi"] - size["lo"] + 1e-12)
    raw = F.least(F.greatest((F.col("f") - F.lit(size["lo"])) / span, F.lit(1e-6)), F.lit(1 - 1e-6))
    test = rows.where("is_test").withColumns({"p_raw": raw, "p_cal": logistic(F.lit(a) * F.col("f") + F.lit(b))})
    test = cut(test.select("y", "p_raw", "p_cal"), "heldout")
    out = S.spearman(rows, "s", "e").select(F.lit(score).alias("score"), "n", "spearman").withColumns({
        "a": F.lit(a), "b": F.lit(b), "pearson": S.pearson(rows, "s", "e").select("pearson").scalar()})
    measures = lambda df, s: S.ranking_measures(df, s, "y").select(F.struct("roc_auc", "pr_auc")).scalar()
    out = out.withColumn("_m", measures(rows, "s")).withColumns({m: F.col(f"_m.{m}") for m in ("roc_auc", "pr_auc")})
    for tag, p in (("raw", "p_raw"), ("cal", "p_cal")):
        out = out.withColumn("_m", measures(test, p)).withColumns({f"test_{m}_{tag}": F.col(f"_m.{m}") for m in ("roc_auc", "pr_auc")})
        out = out.withColumns({
            f"test_brier_{tag}": S.brier(test, p, "y").scalar(), f"test_logloss_{tag}": S.log_loss(test, p, "y").scalar(),
            f"test_ece_{tag}": S.calibration_error(test, p, "y").scalar()})
    return out.drop("_m")


def report(df: DataFrame, scores: dict[str, float], label: str, err: str, key: str) -> DataFrame:
    """One row per score; ``scores`` maps a column to its winsorising share."""
    rows = [r for r in (evaluate(df, s, label, err, key, w) for s, w in scores.items()) if r is not None]
    if not rows:
        raise ValueError("no score has both classes and at least ten rows")
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
