"""How far two or more pose assignments lie apart."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, functions as F

from orientlake.functions import rotations as R
from orientlake.operators.ordered import grouped_quantiles
from orientlake.session import cut


def pose_errors(matched: DataFrame, symmetry: str, suffix: str = "_2", frame: tuple[float, ...] | None = None) -> DataFrame:
    """Angle ``err`` (degrees) and shift length ``shift_err`` between two poses in one row."""
    m = R.with_matrix(matched, "rot", "tilt", "psi", "_a")
    m = R.with_matrix(m, f"rot{suffix}", f"tilt{suffix}", f"psi{suffix}", "_b")
    if frame is not None:
        m = m.withColumns(dict(zip(R.entries("_b"), R.constant_times(frame, R.matrix_of("_b")))))
    out = R.with_sym_error(m, "_a", "_b", symmetry, "err").drop(*R.entries("_a"), *R.entries("_b"))
    if {"dx", "dy", f"dx{suffix}", f"dy{suffix}"}.issubset(out.columns):
        x, y = F.col("dx") - F.col(f"dx{suffix}"), F.col("dy") - F.col(f"dy{suffix}")
        out = out.withColumn("shift_err", F.sqrt(x * x + y * y))
    return out


def comparison_report(errors: DataFrame) -> DataFrame:
    """One row: mean, spread, median, interquartile range of angle and shift errors, shares below 5 and 10 degrees."""
    def share(limit):
        return F.avg(F.when(F.col("err") < limit, F.lit(1.0)).otherwise(F.lit(0.0))) * 100

    report = errors.agg(
        F.count(F.lit(1)).alias("n"), F.avg("err").alias("mean"), F.stddev_pop("err").alias("std"),
        share(5.0).alias("pct5"), share(10.0).alias("pct10"),
        F.avg("shift_err").alias("shift_mean"), F.stddev_pop("shift_err").alias("shift_std"))
    for col, tag in (("err", ""), ("shift_err", "shift_")):
        q = grouped_quantiles(errors.select(col), col, {"q1": .25, "q2": .5, "q3": .75})
        report = report.withColumns({f"{tag}median": q.select("q2").scalar(), f"{tag}iqr": q.select(F.col("q3") - F.col("q1")).scalar()})
    return report


def pairwise_errors(wide: DataFrame, n: int, symmetry: str) -> DataFrame:
    """Largest and mean error over all pairs of the ``n`` poses in a row (rot_0, tilt_0, psi_0, rot_1, ...)."""
    out = wide
    for i in range(n):
        out = R.with_matrix(out, f"rot_{i}", f"tilt_{i}", f"psi_{i}", f"_m{i}_")
    errors = []
    for i, j in combinations(range(n), 2):
        out = R.with_sym_error(out, f"_m{i}_", f"_m{j}_", symmetry, f"_e{i}_{j}")
        errors.append(F.col(f"_e{i}_{j}"))
    total = errors[0]
    for e in errors[1:]:
        total = total + e
    largest = errors[0] if len(errors) == 1 else F.greatest(*errors)
    return out.withColumns({"max_err": largest, "mean_err": total / len(errors)}).drop(
        *[f"_e{i}_{j}" for i, j in combinations(range(n), 2)])


def displacement_report(moved: DataFrame, group: str) -> DataFrame:
    """Median angle and shift by which poses moved, per ``group``."""
    moved = cut(moved.select(group, "err", "shift_err"), "moved")
    a = grouped_quantiles(moved.select(group, "err"), "err", {"median_angle": .5}, [group])
    s = grouped_quantiles(moved.select(group, "shift_err"), "shift_err", {"median_shift": .5}, [group])
    return a.join(s, group)
