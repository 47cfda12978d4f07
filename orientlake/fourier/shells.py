"""Shell sums, resolution curves and voxel-wise gains as plain aggregates over voxel rows.

A voxel row is (group columns, z, y, x, ...) with the origin at side / 2 on
every centred axis. All sums are keyed by shell, so they combine inside each
task before anything is shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from orientlake.functions import optics as O
from orientlake.operators.ordered import HASH_RANGE


def radius(side: int, half_x: bool = False) -> Column:
    """Distance from the origin; with ``half_x`` the x axis runs from 0."""
    c = F.lit(side // 2)
    z, y = F.col("z") - c, F.col("y") - c
    x = F.col("x") if half_x else F.col("x") - c
    return F.sqrt((z * z + y * y + x * x).cast("double"))


def shell_of(r: Column, side: int) -> Column:
    """Shell 1 .. side/2 - 1 with edges half-way between, the last one closed; NULL outside."""
    last = side // 2 - 1
    s = F.floor(r + 0.5)
    s = F.when(r == last + 0.5, F.lit(last)).otherwise(s)
    return F.when((s >= 1) & (s <= last), s.cast("bigint"))


def shell_correlation(df: DataFrame, side: int, group: list[str]) -> DataFrame:
    """Correlation of two complex maps (re1, im1, re2, im2) per shell."""
    rows = df.withColumn("shell", shell_of(radius(side), side)).where("shell is not null")
    sums = rows.groupBy(*group, "shell").agg(
        F.sum(F.expr("re1 * re2 + im1 * im2")).alias("c"), F.sum(F.expr("re1 * re1 + im1 * im1")).alias("a"),
        F.sum(F.expr("re2 * re2 + im2 * im2")).alias("b"))
    return sums.select(*group, "shell", (F.col("c") / F.sqrt(F.greatest(F.col("a") * F.col("b"), F.lit(1e-9)))).alias("fsc"))


def shell_amplitude(df: DataFrame, side: int, group: list[str], re: str = "re1", im: str = "im1") -> DataFrame:
    rows = df.withColumn("shell", shell_of(radius(side), side)).where("shell is not null")
    return rows.groupBy(*group, "shell").agg(F.avg(F.sqrt(F.col(re) * F.col(re) + F.col(im) * F.col(im))).alias("amplitude"))


def with_shell_average(df: DataFrame, side: int, group: list[str], value: str, name: str) -> DataFrame:
    """Every half-plane voxel with the mean of its shell floor(r)."""
    rows = df.withColumn("shell", F.floor(radius(side, half_x=True)))
    means = rows.groupBy(*group, "shell").agg(F.avg(value).alias(name))
    return rows.join(means, [*group, "shell"])


def first_crossing(curves: DataFrame, curve: str, level: float, cutoff: float = 15.0, persistence: int = 3, eps: float = 1e-3) -> DataFrame:
    """Resolution where each curve (shell, fsc, res) first falls through ``level``, linearly interpolated.

    A crossing at a resolution worse than ``cutoff`` counts only if the curve
    stays below for ``persistence`` shells. A curve has at most side/2 rows.
    """
    w = Window.partitionBy(curve).orderBy("shell")
    ahead = w.rowsBetween(0, persistence - 1)
    c = curves.withColumns({
        "_f0": F.lag("fsc").over(w), "_r0": F.lag("res").over(w),
        "_top": F.max("fsc").over(ahead), "_left": F.count(F.lit(1)).over(ahead)})
    falls = (F.col("fsc") < level - eps) & (F.col("_f0") >= level - eps)
    stays = (F.col("_left") == persistence) & (F.col("_top") < level - eps)
    drop = F.col("_f0") - F.col("fsc")
    res = F.when(drop > 1e-10, F.col("_r0") + (F.col("_f0") - F.lit(level)) / drop * (F.col("res") - F.col("_r0"))).otherwise(F.col("res"))
    hit = falls & ((F.col("res") <= cutoff) | stays)
    return c.withColumn("_res", F.when(hit, res)).groupBy(curve).agg(
        F.min_by("_res", F.when(hit, F.col("shell"))).alias("resolution"), F.min(F.when(hit, F.col("shell"))).alias("at_shell"))


def first_below(curves: DataFrame, curve: str, level: float) -> DataFrame:
    """First shell under ``level``, else the last one."""
    return curves.groupBy(curve).agg(
        F.coalesce(F.min(F.when(F.col("fsc") < level, F.col("shell"))), F.max("shell")).alias("at_shell"))


def corrected_fsc(masked: Column, random: Column, shell: Column, start: Column) -> Column:
    """Masked curve freed of the bias of the mask from shell ``start`` on, within [-0.1, 1]."""
    free = (masked - random) / (F.lit(1.0) - random + F.lit(1e-6))
    return F.greatest(F.lit(-0.1), F.least(F.lit(1.0), F.when(shell >= start, free).otherwise(masked)))


def guinier_points(curves: DataFrame, lo_res: float, hi_res: float) -> DataFrame:
    """(s^2, ln amplitude) of the shells inside a resolution band, ends included."""
    return curves.where((F.col("s") >= 1.0 / lo_res) & (F.col("s") <= 1.0 / hi_res) & (F.col("amplitude") > 0)).withColumns(
        {"s2": F.col("s") * F.col("s"), "ln_amplitude": F.ln("amplitude")})


def guinier_bfactor(curves: DataFrame, curve: str, px: float, lo_res: float = 10.0) -> DataFrame:
    """B factor from the weighted Guinier line of each curve (shell, s, fsc, amplitude); 0 with under three shells."""
    lo, hi = 1.0 / lo_res, 1.0 / (2 * px)
    band = (F.col("s") >= lo) & (F.col("s") <= hi)
    stops = curves.groupBy(curve).agg(F.min(F.when(band & (F.col("fsc") < 1e-4), F.col("shell"))).alias("_stop"),
                                      F.min(F.when(band & (F.col("fsc") < 1e-4), F.col("s"))).alias("_cut"))
    f = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("fsc")))
    y = F.ln(F.col("amplitude") * F.sqrt(F.lit(2.0) * f / (F.lit(1.0) + f + F.lit(1e-9))))
    used = curves.join(stops, curve).withColumns({
        "_y": F.when(band & (F.col("_stop").isNull() | (F.col("shell") < F.col("_stop"))) & (f > 0) & (F.col("amplitude") > 0), y),
        "_x": F.col("s") * F.col("s")})
    fit = used.groupBy(curve).agg(
        F.count("_y").alias("n_shells"), F.regr_slope("_y", "_x").alias("_slope"), F.regr_intercept("_y", "_x").alias("_icpt"),
        F.regr_r2("_y", "_x").alias("_r2"), F.first(F.lit(1.0) / F.col("_cut")).alias("cutoff"))
    ok = F.col("n_shells") >= 3
    return fit.select(curve, "n_shells", F.when(ok, 4.0 * F.col("_slope")).otherwise(F.lit(0.0)).alias("bfactor"),
                      F.when(ok, F.col("_slope")).otherwise(F.lit(0.0)).alias("slope"),
                      F.when(ok, F.col("_icpt")).otherwise(F.lit(0.0)).alias("intercept"),
                      F.when(ok, F.col("_r2")).otherwise(F.lit(0.0)).alias("r2"), "cutoff")


def interpolate_curve(rows: DataFrame, curves: DataFrame, group: list[str], pos: str, value: str, name: str, last: int) -> DataFrame:
    """Curve value at a real shell position ``pos``, linear between shells 1 .. ``last`` and level outside."""
    clamped = F.least(F.greatest(F.col(pos), F.lit(1.0)), F.lit(float(last)))
    at = rows.withColumns({"_lo": F.floor(clamped), "_t": clamped - F.floor(clamped)}).withColumn("_hi", F.least(F.col("_lo") + 1, F.lit(last)))
    lo = curves.select(*group, F.col("shell").alias("_lo"), F.col(value).alias("_v0"))
    hi = curves.select(*group, F.col("shell").alias("_hi"), F.col(value).alias("_v1"))
    return at.join(lo, [*group, "_lo"]).join(hi, [*group, "_hi"]).withColumn(
        name, F.col("_v0") + (F.col("_v1") - F.col("_v0")) * F.col("_t")).drop("_lo", "_hi", "_t", "_v0", "_v1")


def otsu(df: DataFrame, group: list[str], value: str, bins: int = 256) -> DataFrame:
    """Per group: the bin centre that splits its histogram best, first on ties."""
    ranges = df.groupBy(*group).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    hist = df.join(ranges, group).groupBy(*group, "lo", "hi", place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    hist = hist.withColumn("c", F.col("lo") + (F.col("bin") + 0.5) * width)
    # at most ``bins`` rows per group
    w = Window.partitionBy(*group).orderBy("bin")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("n").over(whole)
    h = hist.withColumns({"w0": F.sum("n").over(upto) / total, "m0": F.sum(F.col("n") * F.col("c")).over(upto) / total,
                          "mt": F.sum(F.col("n") * F.col("c")).over(whole) / total})
    w1 = F.lit(1.0) - F.col("w0")
    gap = F.col("m0") / F.col("w0") - (F.col("mt") - F.col("m0")) / w1
    h = h.withColumn("var", F.when((F.col("w0") >= 1e-10) & (w1 >= 1e-10), F.round(F.col("w0") * w1 * gap * gap, 12)))
    return h.groupBy(*group).agg(F.coalesce(F.max_by("c", F.when(F.col("var").isNotNull(), F.struct("var", -F.col("bin")))), F.min("lo")).alias("threshold"))


def subtract_background(df: DataFrame, group: list[str], value: str, mask: str, name: str) -> DataFrame:
    """(value - mean of the soft border) * mask; without a border the mean outside the mask, else 0."""
    m = F.col(mask)
    means = df.groupBy(*group).agg(F.avg(F.when((m > 0) & (m < 1), F.col(value))).alias("_b"), F.avg(F.when(m == 0, F.col(value))).alias("_o"))
    level = means.select(*group, F.coalesce("_b", "_o", F.lit(0.0)).alias("_bg"))
    return df.join(level, group).withColumn(name, (F.col(value) - F.col("_bg")) * m).drop("_bg")


def voxel_phase(side: int, salt: int = 0) -> Column:
    """Reproducible uniform phase of a voxel from its place, by integer arithmetic."""
    index = (F.col("z").cast("bigint") * side + F.col("y")) * side + F.col("x") + F.lit(1 + salt * side ** 3)
    return (index * F.lit(2654435761) % F.lit(HASH_RANGE)).cast("double") / F.lit(float(HASH_RANGE)) * F.lit(2 * math.pi)


def randomize_phases(df: DataFrame, side: int, start: Column, re: str, im: str, salt: int = 0) -> DataFrame:
    """Same amplitudes, pseudo-random phases from radius ``start`` on."""
    amp = F.sqrt(F.col(re) * F.col(re) + F.col(im) * F.col(im))
    far = radius(side) >= start
    phase = voxel_phase(side, salt)
    return df.withColumns({re: F.when(far, amp * F.cos(phase)).otherwise(F.col(re)), im: F.when(far, amp * F.sin(phase)).otherwise(F.col(im))})


def fourier_resize(df: DataFrame, group: list[str], values: list[str], old: int, new: int) -> DataFrame:
    """Centred crop or zero padding of Fourier voxels; values are not rescaled."""
    shift = new // 2 - old // 2
    moved = df.withColumns({a: F.col(a) + shift for a in "zyx"})
    if new <= old:
        return moved.where(" and ".join(f"{a} >= 0 and {a} < {new}" for a in "zyx"))
    axis = F.sequence(F.lit(0), F.lit(new - 1))
    frame = df.select(*group).distinct()
    for a in "zyx":
        frame = frame.withColumn(a, F.explode(axis))
    return frame.join(moved, [*group, "z", "y", "x"], "left").fillna(0.0, values)


def merge_accumulators(parts: DataFrame) -> DataFrame:
    """Sum of partial accumulators per half and voxel; halves are never mixed."""
    return parts.groupBy("half", "z", "y", "x").agg(*[F.sum(c).alias(c) for c in ("re", "im", "w", "ctfsq")])


def normalize_voxels(acc: DataFrame, side: int, group: list[str], eps: float = -1000.0, floor: float = 1e-6, use_ctf: bool = True) -> DataFrame:
    """Fourier density of accumulators; voxels with weight up to ``floor`` are left out.

    With CTF the divisor is ctf^2, kept above the shell mean over |eps| for a
    negative eps, or plus eps times the weight for a positive one.
    """
    if not use_ctf:
        divisor, rows = F.col("w"), acc
    elif eps < 0:
        rows = with_shell_average(acc, side, group, "ctfsq", "_mean").drop("shell")
        divisor = F.greatest(F.col("ctfsq"), F.col("_mean") / F.lit(abs(eps)))
    else:
        rows, divisor = acc, F.col("ctfsq") + F.lit(eps) * F.col("w")
    if use_ctf:
        divisor = F.when(F.abs(divisor) < floor, F.lit(floor)).otherwise(divisor)
    out = rows.where(F.col("w") > floor).withColumn("_d", divisor)
    return out.withColumns({"re": F.col("re") / F.col("_d"), "im": F.col("im") / F.col("_d")}).drop("_d", "_mean")


def sharpening_gain(rows: DataFrame, weights: DataFrame, group: list[str], side: int, px: float, bfactor: Column,
                    cutoff: Column | None, name: str = "gain") -> DataFrame:
    """Per voxel: figure-of-merit weight times exp(-B s^2 / 4), zero past the cut-off frequency."""
    at = rows.withColumn("_pos", radius(side))
    w = interpolate_curve(at, weights, group, "_pos", "weight", "_w", side // 2 - 1)
    s = F.col("_pos") / F.lit(side * px)
    gain = F.col("_w") * F.exp(-bfactor * s * s / 4.0)
    if cutoff is not None:
        gain = F.when(s > cutoff, F.lit(0.0)).otherwise(gain)
    return w.withColumn(name, gain).drop("_pos", "_w")


def fom_curve(curves: DataFrame, fsc: str = "fsc") -> DataFrame:
    return curves.withColumn("weight", O.fom_weight(F.col(fsc)))
