"""One-dimensional Gaussian mixtures and the score threshold between two of them.

All passes run over one row per distinct value with its count; a round of
expectation-maximisation is one aggregate of three sums per component.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from orientlake.frames import finite
from orientlake.operators.filters import clip_quantiles
from orientlake.operators.ordered import counted_values, prefix_sums
from orientlake.operators.stats import youden
from orientlake.session import cut

VARIANCE_FLOOR = 1e-6


@dataclass(frozen=True)
class Mixture:
    weights: tuple[float, ...]
    means: tuple[float, ...]
    stds: tuple[float, ...]
    bic: float
    n: int

    @property
    def size(self) -> int:
        return len(self.means)


def _log_parts(v: Column, w, m, s) -> list[Column]:
    return [F.lit(math.log(wk) - 0.5 * math.log(2 * math.pi) - math.log(sk)) - F.lit(0.5 / (sk * sk)) * (v - F.lit(mk)) * (v - F.lit(mk))
            for wk, mk, sk in zip(w, m, s)]


def _log_sum(parts: list[Column]) -> tuple[Column, Column]:
    top = parts[0] if len(parts) == 1 else F.greatest(*parts)
    total = F.exp(parts[0] - top)
    for p in parts[1:]:
        total = total + F.exp(p - top)
    return top, F.log(total)


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return cut(counted_values(df.where(finite(F.col(col))).select(F.col(col).cast("double").alias("v")), "v"), "values")


def weighted_quantiles(counts: DataFrame, probs: list[float]) -> list[float]:
    placed = prefix_sums(counts, ["v"], ["n"], by="v")
    at = [F.min(F.when(F.col("n_before") + F.col("n") > F.lit(p) * F.col("n_total"), F.col("v"))).alias(f"q{i}") for i, p in enumerate(probs)]
    return [float(x) for x in placed.agg(*at).first()]


def fit_robust(counts: DataFrame, components: int, rounds: int = 100, tol: float = 1e-3) -> Mixture:
    """Drop the least likely twentieth under one Gaussian, fit the rest, judge by BIC on everything."""
    v, n = F.col("v"), F.col("n")
    one = counts.agg(F.sum(n).alias("n"), (F.sum(n * v) / F.sum(n)).alias("m"), (F.sum(n * v * v) / F.sum(n)).alias("q")).first()
    total, mean = one["n"], one["m"]
    # likelihood under one Gaussian falls with the distance from the mean: keep the nearest 95 %
    far = prefix_sums(counts.withColumn("d", F.abs(v - F.lit(mean))).groupBy("d").agg(F.sum("n").alias("n")), ["d"], ["n"], by="d")
    place = 0.95 * (total - 1)
    lo, hi = math.floor(place), math.ceil(place)
    edges = far.agg(*[F.max(F.when((F.col("n_before") <= k) & (F.col("n_before") + F.col("n") > k), F.col("d"))).alias(f"e{i}")
                      for i, k in enumerate((lo, hi))]).first()
    limit = edges[0] + (edges[1] - edges[0]) * (place - lo)
    kept = counts.where(F.abs(v - F.lit(mean)) <= F.lit(limit))
    seeds = weighted_quantiles(kept, [(k + 0.5) / components for k in range(components)])
    spread = kept.agg((F.sum(n * v * v) / F.sum(n) - (F.sum(n * v) / F.sum(n)) ** 2).alias("s")).first()["s"]
    w, m = [1.0 / components] * components, seeds
    s = [math.sqrt(max(spread, VARIANCE_FLOOR)) / components] * components
    last = -math.inf
    for _ in range(rounds):
        parts = _log_parts(v, w, m, s)
        top, log_total = _log_sum(parts)
        aggs = [F.sum(n * (top + log_total)), F.sum(n)]
        for p in parts:
            r = n * F.exp(p - top - log_total)
            aggs += [F.sum(r), F.sum(r * v), F.sum(r * v * v)]
        x = [float(a) for a in kept.agg(*[a.alias(f"a{i}") for i, a in enumerate(aggs)]).first()]
        for k in range(components):
            g, gx, gxx = x[2 + 3 * k:5 + 3 * k]
            g = max(g, 1e-10)
            w[k], m[k] = g / x[1], gx / g
            s[k] = math.sqrt(max(gxx / g - (gx / g) ** 2, 0.0) + VARIANCE_FLOOR)
        if abs(x[0] / x[1] - last) < tol:
            break
        last = x[0] / x[1]
    top, log_total = _log_sum(_log_parts(v, w, m, s))
    likelihood = float(counts.agg(F.sum(n * (top + log_total))).first()[0])
    order = np.argsort(m)
    bic = -2 * likelihood + (3 * components - 1) * math.log(total)
    return Mixture(*(tuple(float(t[k]) for k in order) for t in (w, m, s)), bic, int(total))


def fit_best(counts: DataFrame) -> Mixture:
    """Two components; three and four are tried as well when one of the two is small."""
    two = fit_robust(counts, 2)
    if min(two.weights) >= 0.1 or two.n < 40:
        return two
    return min([two, *[fit_robust(counts, k) for k in (3, 4) if two.n >= 10 * k]], key=lambda g: g.bic)


def _good_component(g: Mixture) -> int:
    if g.size == 2 and min(g.weights) > 0.3:
        return 1
    return int(np.argmax(g.weights))


def _bad_component(g: Mixture) -> int:
    large = [k for k in range(g.size) if g.weights[k] >= 0.1]
    if g.size == 2 and len(large) == 2 and min(g.weights) > 0.3:
        return 0
    return max(large or range(g.size), key=lambda k: g.weights[k])


def crossing(m1: float, s1: float, w1: float, m2: float, s2: float, w2: float) -> float | None:
    """Where two weighted Gaussian densities meet between their means."""
    a = 0.5 / s2 ** 2 - 0.5 / s1 ** 2
    b = m1 / s1 ** 2 - m2 / s2 ** 2
    c = m2 ** 2 / (2 * s2 ** 2) - m1 ** 2 / (2 * s1 ** 2) + math.log(w1 * s2 / (w2 * s1))
    lo, hi = min(m1, m2), max(m1, m2)
    if abs(a) < 1e-15:
        roots = [] if b == 0 else [-c / b]
    else:
        disc = b * b - 4 * a * c
        roots = [] if disc < 0 else [(-b + t * math.sqrt(disc)) / (2 * a) for t in (1, -1)]
    inside = [r for r in roots if lo <= r <= hi]
    return inside[0] if len(inside) == 1 else None


def separate(bad: DataFrame, good: DataFrame, col: str, fallback: bool = True, fn_cost: float = 2.0) -> dict:
    """Threshold between two score distributions, and how it was found."""
    clipped = []
    for name, df in (("bad", bad), ("good", good)):
        rows = df.where(finite(F.col(col))).select(col)
        if rows.limit(20).count() < 20:
            raise ValueError(f"fewer than 20 {name} scores")
        clipped.append(value_counts(clip_quantiles(rows, col, 0.01, 0.99, "c").select("c"), "c"))
    try:
        gb, gg = (fit_best(c) for c in clipped)
        i, k = _bad_component(gb), _good_component(gg)
        x = crossing(gb.means[i], gb.stds[i], gb.weights[i], gg.means[k], gg.stds[k], gg.weights[k])
        method = "intersection" if x is not None else "midpoint"
        if x is None:
            x = (gb.means[i] + gg.means[k]) / 2
        return {"threshold": x, "method": method, "bad": gb, "good": gg, "bad_component": i, "good_component": k}
    except (ArithmeticError, ValueError):
        if not fallback:
            raise
        both = bad.select(col, F.lit(0).alias("y")).unionByName(good.select(col, F.lit(1).alias("y")))
        t = youden(both, col, "y", fn_cost).first()
        return {"threshold": t["threshold"], "method": "roc", "bad": None, "good": None, "bad_component": None, "good_component": None}
