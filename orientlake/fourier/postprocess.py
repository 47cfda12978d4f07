"""From half maps to resolution and a sharpened map, and from accumulators to density."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from orientlake.fourier import shells as V
from orientlake.fourier.transform import transform3
from orientlake.functions import optics as O
from orientlake.session import cut


def pair_maps(spectra: DataFrame, group: list[str]) -> DataFrame:
    """Spectra of maps 1 and 2 side by side as re1, im1, re2, im2."""
    at = lambda m, c: F.max(F.when(F.col("map") == m, F.col(c))).alias(f"{c}{m}")
    return spectra.groupBy(*group, "z", "y", "x").agg(*[at(m, c) for m in (1, 2) for c in ("re", "im")])


def curve_axes(df: DataFrame, side: int, px: float) -> DataFrame:
    s = F.col("shell") / F.lit(side * px)
    return df.withColumns({"s": s, "res": F.lit(1.0) / s})


def gold_standard(maps: DataFrame, group: list[str], side: int, px: float) -> DataFrame:
    """Unmasked, masked, phase-randomised and corrected curves of half maps.

    ``maps`` has (group, map 1 or 2, z, y, x, v, mask). Phases are randomised
    from the first shell whose unmasked correlation is under 0.8.
    """
    key = [*group, "map"]
    spectra = cut(transform3(maps, key, side, "forward", "v", None), "spectra")
    plain = cut(V.shell_correlation(pair_maps(spectra, group), side, group), "plain")
    start = cut(plain.groupBy(*group).agg(F.coalesce(F.min(F.when(F.col("fsc") < 0.8, F.col("shell"))), F.max("shell")).alias("start")), "start")

    def masked_curve(values: DataFrame, name: str) -> DataFrame:
        m = V.subtract_background(values, key, "v", "mask", "masked")
        f = transform3(m, key, side, "forward", "masked", None)
        return V.shell_correlation(pair_maps(f, group), side, group).withColumnRenamed("fsc", name)

    masked = masked_curve(maps, "masked")
    far = spectra.join(start, group)
    amp, phase = F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")), F.when(
        F.col("map") == 1, V.voxel_phase(side, 0)).otherwise(V.voxel_phase(side, 1))
    beyond = V.radius(side) >= F.col("start") - 0.5
    random = far.withColumns({"re": F.when(beyond, amp * F.cos(phase)).otherwise(F.col("re")), "im": F.when(beyond, amp * F.sin(phase)).otherwise(F.col("im"))})
    back = transform3(random, key, side, "inverse").select(*key, "z", "y", "x", F.col("re").alias("v"))
    shuffled = masked_curve(back.join(maps.select(*key, "z", "y", "x", "mask"), [*key, "z", "y", "x"]), "randomized")
    curves = plain.withColumnRenamed("fsc", "unmasked").join(masked, [*group, "shell"]).join(shuffled, [*group, "shell"]).join(start, group)
    fixed = curves.withColumn("fsc", V.corrected_fsc(F.col("masked"), F.col("randomized"), F.col("shell"), F.col("start")))
    return curve_axes(fixed, side, px)


def resolutions(curves: DataFrame, group: str) -> DataFrame:
    a = V.first_crossing(curves, group, 0.143).select(group, F.col("resolution").alias("res_0143"))
    b = V.first_crossing(curves, group, 0.5).select(group, F.col("resolution").alias("res_05"))
    return a.join(b, group)


def postprocess(maps: DataFrame, group: str, side: int, px: float, guinier_lo: float = 10.0, adhoc_bfactor: float | None = None,
                lowpass: float | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sharpened voxels, curves, one summary row per group) of half maps."""
    curves = cut(gold_standard(maps, [group], side, px), "curves")
    mean = cut(maps.groupBy(group, "z", "y", "x").agg(F.avg("v").alias("v")), "mean")
    spectrum = cut(transform3(mean, [group], side, "forward", "v", None), "meanspectrum")
    amplitude = V.shell_amplitude(spectrum, side, [group], "re", "im")
    fit = V.guinier_bfactor(curves.join(amplitude, [group, "shell"]), group, px, guinier_lo)
    if adhoc_bfactor is not None:
        fit = fit.withColumn("bfactor", F.lit(float(adhoc_bfactor)))
    # without a cut-off in the Guinier band the first shell of the whole curve under 1e-4 ends the map
    first = curves.groupBy(group).agg(F.min_by("res", F.when(F.col("fsc") < 1e-4, F.col("shell"))).alias("_any"))
    summary = cut(fit.join(first, group).join(resolutions(curves, group), group).withColumn(
        "lowpass", F.lit(float(lowpass)) if lowpass is not None else F.coalesce("cutoff", "_any")).drop("_any"), "summary")
    posed = spectrum.join(summary.select(group, "bfactor", "lowpass"), group)
    limit = F.lit(1.0) / F.col("lowpass")
    gained = V.sharpening_gain(posed, V.fom_curve(curves).select(group, "shell", "weight"), [group], side, px, F.col("bfactor"),
                               F.coalesce(limit, F.lit(float("inf"))))
    sharp = gained.withColumns({c: F.col(c) * F.col("gain") for c in ("re", "im")})
    out = transform3(sharp, [group], side, "inverse").select(group, "z", "y", "x", F.col("re").alias("v"))
    return out, curves, summary


def reconstruct(acc: DataFrame, side: int, eps: float = -1000.0, use_ctf: bool = True, radius: float = -1.0, edge: float = 3.0) -> DataFrame:
    """Density (half, z, y, x, v) of accumulators: divide, transform back, undo the gridding kernel, mask softly.

    The accumulators and the map before its mask are read twice and therefore
    written first, so that the images behind them are inserted once.
    """
    f = V.normalize_voxels(cut(acc, "accumulators"), side, ["half"], eps, use_ctf=use_ctf)
    real = transform3(f, ["half"], side, "half_inverse", recentre=True)
    z, y, x = (F.col(a) for a in "zyx")
    flat = cut(real.select("half", "z", "y", "x", (F.col("re") / O.gridding_gain(z, y, x, side)).alias("raw"),
                           O.soft_sphere(z, y, x, side, radius, edge).alias("mask")), "density")
    border = flat.groupBy("half").agg(F.coalesce(F.avg(F.when((F.col("mask") > 0) & (F.col("mask") < 1), F.col("raw"))), F.lit(0.0)).alias("_bg"))
    return flat.join(border, "half").select("half", "z", "y", "x", ((F.col("raw") - F.col("_bg")) * F.col("mask")).alias("v"))
