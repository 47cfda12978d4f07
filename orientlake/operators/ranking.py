"""Ranked candidates per particle, held as one array per row: no shuffle, no group to overflow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from orientlake.functions import rotations as R
from orientlake.functions.optics import normal_cdf


def top_candidates(scores: str, k: int) -> Column:
    """Array of (score, cand), best first, lowest candidate first on ties."""
    pairs = F.transform(F.col(scores), lambda s, i: F.struct((-s.cast("double")).alias("s"), i.alias("cand")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda p: F.struct((-p["s"]).alias("score"), p["cand"].alias("cand")))


def top_rows(df: DataFrame, scores: str, k: int) -> DataFrame:
    """One row per particle and rank 1..k."""
    return df.select(*[c for c in df.columns if c != scores], F.posexplode(top_candidates(scores, k)).alias("rank", "_t")).select(
        "*", F.col("_t.cand").alias("cand"), F.col("_t.score").alias("score")).drop("_t").withColumn("rank", F.col("rank") + 1)


def rank_suffix(k: int) -> str:
    """Column suffix of the k-th pose: none for the best, then _top2, _top3, ..."""
    return "" if k == 1 else f"_top{k}"


def spread_ranks(df: DataFrame, scores: str, k: int) -> DataFrame:
    """Best k candidates as suffixed columns of the row itself."""
    best = df.withColumn("_t", top_candidates(scores, k))
    cols = {}
    for r in range(1, k + 1):
        item = F.get("_t", F.lit(r - 1))
        cols[f"cand{rank_suffix(r)}"], cols[f"score{rank_suffix(r)}"] = item["cand"], item["score"]
    return best.withColumns(cols).drop("_t", scores)


def _total(a: Column) -> Column:
    return F.reduce(a, F.lit(0.0), lambda t, x: t + x)


def symmetry_sum(scores: str, equivalents: list[list[int]]) -> Column:
    """Scores with those of each candidate's equivalents added up; the list is a constant of the grid."""
    table = F.lit([[int(j) for j in row] for row in equivalents]).cast("array<array<int>>")
    return F.transform(table, lambda row: _total(F.transform(row, lambda j: F.get(F.col(scores), j).cast("double"))))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A value read inside an array function would otherwise be computed again
    for every element of the array.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def softmax(logits: Column) -> Column:
    return let(F.transform(logits, lambda v: v.cast("double")), lambda a:
               let(F.array_max(a), lambda top:
                   let(F.transform(a, lambda v: F.exp(v - top)), lambda e:
                       let(_total(e), lambda z: F.transform(e, lambda v: v / z)))))


def top_sum(probabilities: str, k: int = 10) -> Column:
    """Confidence: the sum of the k largest probabilities."""
    return _total(F.slice(F.sort_array(F.col(probabilities), asc=False), 1, k))


def winner_statistics(df: DataFrame, scores: str) -> DataFrame:
    """Best score, its place, and its standing among all candidates as a normal probability (sample spread + 1e-6)."""
    d = df.withColumns({"_d": F.transform(F.col(scores), lambda s: s.cast("double")), "_n": F.size(scores).cast("double")})
    d = d.withColumn("mean", _total(F.col("_d")) / F.col("_n"))
    d = d.withColumn("std", F.sqrt(_total(F.transform("_d", lambda v: (v - F.col("mean")) * (v - F.col("mean")))) / (F.col("_n") - 1)))
    d = d.withColumns({"best": F.array_max("_d"), "cand": (F.array_position("_d", F.array_max("_d")) - 1).cast("int")})
    return d.withColumn("confidence", normal_cdf((F.col("best") - F.col("mean")) / (F.col("std") + F.lit(1e-6)))).drop("_d", "_n")


def substep(df: DataFrame, scores: str, n: int, step: float, tags: tuple[str, str, str] = ("rot", "tilt", "psi")) -> DataFrame:
    """Parabolic offset of the winning point of an n x n x n grid along each axis, within half a step.

    Zero at the border of the grid and where the scores are not concave.
    """
    d = df.withColumn("_w", (F.array_position(scores, F.array_max(scores)) - 1).cast("int"))
    at = lambda i: F.get(F.col(scores), i.cast("int")).cast("double")
    cols = {}
    for axis, tag in enumerate(tags):
        stride = n ** (2 - axis)
        place = F.pmod(F.floor(F.col("_w") / stride), F.lit(n))
        c0, plus, minus = at(F.col("_w")), at(F.col("_w") + stride), at(F.col("_w") - stride)
        bend = 2.0 * minus - 4.0 * c0 + 2.0 * plus
        offset = F.greatest(F.lit(-step / 2), F.least(F.lit(step / 2), (minus - plus) / bend * step))
        inside = (place > 0) & (place < n - 1) & (bend < -1e-8)
        cols[f"d{tag}"] = F.when(inside, offset).otherwise(F.lit(0.0))
    return d.withColumns({**cols, "cand": F.col("_w")}).drop("_w")


def drop_near_duplicates(df: DataFrame, key: str, tolerance: float = 0.1,
                         angles: tuple[str, str, str] = ("rot", "tilt", "psi")) -> DataFrame:
    """Rows without an earlier row (smaller ``key``) within ``tolerance`` degrees.

    Exact repeats go first. The rest are binned by six matrix entries in cells
    eight tolerances wide; an earlier row stands in a neighbouring cell only
    where it lies within reach of it.
    """
    import math
    reach = math.radians(tolerance) * (1 + 1e-9)
    first = df.groupBy(*angles).agg(F.min(key).alias(key))
    m = R.with_matrix(first, *angles, "m")
    dims = ["m00", "m10", "m20", "m02", "m12", "m22"]
    cell = lambda c: F.floor(c / F.lit(8 * reach))
    late = m.select(key, *R.entries("m"), *[cell(F.col(d)).alias(f"c{i}") for i, d in enumerate(dims)])
    early = m.select(F.col(key).alias("_k"), *[F.col(c).alias(f"e{c[1:]}") for c in R.entries("m")])
    for i, d in enumerate(dims):
        e = F.col(f"e{d[1:]}")
        early = early.withColumn(f"c{i}", F.explode(F.array_distinct(F.array(cell(e - reach), cell(e + reach)))))
    near = (F.col("_k") < F.col(key)) & (R.trace_between(R.matrix_of("m"), R.matrix_of("e")) >= F.lit(1 + 2 * math.cos(math.radians(tolerance))))
    same = near
    for i in range(len(dims)):
        same = same & (late[f"c{i}"] == early[f"c{i}"])
    kept = late.join(early, same, "left_anti").select(key)
    return df.join(kept, key, "left_semi")
