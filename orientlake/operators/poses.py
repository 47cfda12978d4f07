"""Row-wise operators on poses: copies, folds, candidates and cones."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from orientlake.functions import grids as G, rotations as R
from orientlake.functions.symmetry import group_matrices, operator_array

IDENTITY = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)


def apply_frame(df: DataFrame, frame: tuple[float, ...], source: str, target: str) -> DataFrame:
    """Matrix ``source`` turned from the left by one constant frame; an identity frame only renames."""
    m = R.matrix_of(source)
    if any(abs(a - b) > 1e-8 for a, b in zip(frame, IDENTITY)):
        m = R.constant_times(frame, m)
    return df.withColumns(dict(zip(R.entries(target), m)))


def expand_by_symmetry(df: DataFrame, source: str, target: str, symmetry: str) -> DataFrame:
    """One row per operator S with matrix transposed(S) R, all other columns copied.

    A slice of the transform at R equals one at the symmetry copies, so that
    inserting all rows fills in the whole group.
    """
    rows = df.withColumn("_s", F.explode(operator_array(symmetry)))
    cells = {}
    for i in range(3):
        for j in range(3):
            cells[f"{target}{i}{j}"] = sum(
                (F.col(f"_s.s{k}{i}") * F.col(f"{source}{k}{j}") for k in range(1, 3)),
                F.col(f"_s.s0{i}") * F.col(f"{source}0{j}"))
    return rows.withColumns({**cells, "op": F.col("_s.op")}).drop("_s")


def reduce_by_symmetry(df: DataFrame, source: str, target: str, symmetry: str) -> DataFrame:
    """The symmetry copy S R that turns least (largest trace), first operator on ties."""
    copies = []
    for i, s in enumerate(group_matrices(symmetry)):
        m = R.constant_times(s, R.matrix_of(source))
        copies.append(F.struct(F.round(-R.trace(m), 9).alias("t"), F.lit(i).alias("op"),
                               *[c.alias(n) for c, n in zip(m, R.entries("m"))]))
    best = df.withColumn("_b", copies[0] if len(copies) == 1 else F.least(*copies))
    return best.withColumns({t: F.col(f"_b.{m}") for t, m in zip(R.entries(target), R.entries("m"))}).drop("_b")


def fold_to_asymmetric_unit(df: DataFrame, symmetry: str, side: str = "right",
                            angles: tuple[str, str, str] = ("rot", "tilt", "psi")) -> DataFrame:
    """Angles of the symmetry copy whose normalised (rot, tilt, psi) comes first.

    ``side`` says whether operators act on the particle (right) or on the
    frame (left). Angles are compared rounded, a full turn counting as zero.
    """
    if side not in ("left", "right"):
        raise ValueError("side must be left or right")
    with_m = R.with_matrix(df, *angles, "_m")
    copies = []
    for i, s in enumerate(group_matrices(symmetry)):
        m = R.matrix_of("_m")
        turned = R.times_constant(m, s) if side == "right" else R.constant_times(s, m)
        rot, tilt, psi = R.normal_euler(*R.euler_of(turned))
        copies.append(F.struct(F.pmod(F.round(rot, 6), F.lit(360.0)).alias("a"), F.round(tilt, 6).alias("b"),
                               F.pmod(F.round(psi, 6), F.lit(360.0)).alias("c"), F.lit(i).alias("op"),
                               rot.alias("rot"), tilt.alias("tilt"), psi.alias("psi")))
    best = with_m.withColumn("_b", copies[0] if len(copies) == 1 else F.least(*copies))
    return best.withColumns({a: F.col(f"_b.{n}") for a, n in zip(angles, ("rot", "tilt", "psi"))}).drop(
        "_b", *R.entries("_m"))


def local_candidates(df: DataFrame, distance: float, step: float, prefix: str | None = None) -> DataFrame:
    """Each row with every local grid offset, and the angles with the offset added.

    With ``prefix`` the constant matrix of each offset comes along. Offsets and
    matrices are one constant array, so no row computes them.
    """
    rows = df.withColumn("_c", F.explode(G.local_grid_array(distance, step, prefix)))
    cells = [f"_c.{n}" for n in (R.entries(prefix) if prefix else ())]
    return rows.select(*df.columns, "_c.cand", "_c.drot", "_c.dtilt", "_c.dpsi", *cells).withColumns({
        f"{a}_c": F.col(a) + F.col(f"d{a}") for a in ("rot", "tilt", "psi")})


def with_cone(df: DataFrame, order: int, angles: tuple[str, str, str] = ("rot", "tilt", "psi"), name: str = "cone") -> DataFrame:
    """View-direction bin of the nearest grid rotation."""
    index = G.nearest_grid_index(order)(*angles)
    return df.withColumn("_i", index).withColumn(name, F.expr(f"_i div {G.psi_count(order)}")).drop("_i")


def angular_histogram(df: DataFrame, symmetry: str, fold: int, bin_degs: float) -> DataFrame:
    """Counts of views folded into the asymmetric unit, by rot in [-180, 180) and tilt."""
    v = df.select(*[c.alias(n) for c, n in zip(R.view_of_angles(F.col("rot"), F.col("tilt")), ("vx", "vy", "vz"))])
    b = v.withColumn("b", R.canonical_view([F.col(c) for c in ("vx", "vy", "vz")], symmetry, fold))
    rot = F.round(F.degrees(F.atan2(F.col("b.y"), F.col("b.x"))), 6)
    tilt = F.round(F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("b.z"))))), 6)
    return b.groupBy(F.floor((rot + 180.0) / bin_degs).alias("rot_bin"), F.floor(tilt / bin_degs).alias("tilt_bin")).agg(
        F.count(F.lit(1)).alias("n"))


def replicate(df: DataFrame, copies: int) -> DataFrame:
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
