"""Mean rotations and the agreement of several pose assignments."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from orientlake.functions import rotations as R
from orientlake.functions.symmetry import group_matrices
from orientlake.operators.compare import pairwise_errors
from orientlake.operators.match import shared_places
from orientlake.session import cut

NINE = T.StructType([T.StructField(c, T.DoubleType()) for c in R.entries("m")])


def nearest_rotations(m: np.ndarray) -> np.ndarray:
    """Rotation nearest to each [N, 3, 3] matrix: polar factor with determinant +1."""
    u, _, vt = np.linalg.svd(m)
    d = np.ones((len(m), 3))
    d[:, 2] = np.where(np.linalg.det(u @ vt) < 0, -1.0, 1.0)
    return (u * d[:, None, :]) @ vt


@F.pandas_udf(NINE)
def project_to_rotation(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series, e: pd.Series, f: pd.Series,
                        g: pd.Series, h: pd.Series, i: pd.Series) -> pd.DataFrame:
    m = np.stack([s.to_numpy(dtype=float) for s in (a, b, c, d, e, f, g, h, i)], axis=1).reshape(-1, 3, 3)
    return pd.DataFrame(nearest_rotations(m).reshape(-1, 9), columns=R.entries("m"))


def _projected(df: DataFrame, sums: str, target: str) -> DataFrame:
    out = df.withColumn("_q", project_to_rotation(*[F.col(c) for c in R.entries(sums)]))
    return out.withColumns({t: F.col(f"_q.{m}") for t, m in zip(R.entries(target), R.entries("m"))}).drop("_q")


def mean_rotation(df: DataFrame, group: list[str], source: str = "r", weight: str | None = None, gathered: bool = False) -> DataFrame:
    """Weighted chordal mean rotation ``mean00`` .. ``mean22`` per group, with the mean angle to it (radians).

    Nine plain sums do the work, so a group of any size costs one partial row
    per task; only those sums meet the projection. With ``gathered`` the rows
    of a group stay beside its sums until the angles are known, so there is
    one shuffle and none if the rows are dealt by ``group``: for groups that
    are many and small only, as those of a particle.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    rows = df.withColumn("_w", w)
    matrix = F.struct(*[F.col(c).alias(m) for c, m in zip(R.entries(source), R.entries("m"))])
    kept = [F.collect_list(matrix).alias("_rows")] if gathered else []
    sums = rows.groupBy(*group).agg(F.sum("_w").alias("_sw"), *[
        F.sum(F.col("_w") * F.col(c)).alias(s) for c, s in zip(R.entries(source), R.entries("_s"))], *kept)
    sums = sums.withColumns({s: F.col(s) / (F.col("_sw") + 1e-12) for s in R.entries("_s")})
    if gathered:
        for g in group:
            sums = sums.where(F.col(g).isNotNull())
        means = _projected(sums, "_s", "mean")
        angles = F.filter(F.transform("_rows", lambda r: F.radians(R.pose_error(R.matrix_of("mean"), [r[m] for m in R.entries("m")]))), lambda a: a.isNotNull())
        mean_angle = F.when(F.size("_a") > 0, F.reduce("_a", F.lit(0.0), lambda t, a: t + a) / F.size("_a"))
        return means.withColumn("_a", angles).select(*group, *R.entries("mean"), mean_angle.alias("dispersion"), F.size("_rows").cast("bigint").alias("n"))
    means = _projected(sums, "_s", "mean").select(*group, *R.entries("mean"))
    angle = F.radians(R.pose_error(R.matrix_of("mean"), R.matrix_of(source)))
    spread = rows.join(means, group).groupBy(*group).agg(F.avg(angle).alias("dispersion"), F.count(F.lit(1)).alias("n"))
    return means.join(spread, group)


def average_poses(wide: DataFrame, n: int, weights: tuple[float, ...] | None = None) -> DataFrame:
    """Mean of the ``n`` matrices ``_m<i>_`` of a row as ``avg00`` .. ``avg22``."""
    w = weights or tuple(1.0 / n for _ in range(n))
    if len(w) != n or abs(sum(w) - 1.0) > 1e-8:
        raise ValueError("one weight per table, adding up to 1")
    cells = {}
    for k, c in enumerate(R.entries("_s")):
        cells[c] = sum((F.col(R.entries(f"_m{i}_")[k]) * w[i] for i in range(1, n)), F.col(R.entries("_m0_")[k]) * w[0])
    return _projected(wide.withColumns(cells), "_s", "avg").drop(*R.entries("_s"))


# An error this near to a limit (degrees) is worked out again, since the last bit of sine and cosine may decide.
NEAR = 1e-6
POLAR_ROUNDS = 12


def _plain(fn, a: np.ndarray) -> np.ndarray:
    """``fn`` of the C library, number by number: the JVM and NumPy have sines of their own, with other last bits."""
    return np.array([fn(v) for v in a.tolist()], dtype=float)


def plain_matrix(rot: np.ndarray, tilt: np.ndarray, psi: np.ndarray) -> list[np.ndarray]:
    """Entries of Rz(rot) Ry(tilt) Rz(psi), in the order of ``rotations.with_matrix``."""
    (ca, sa), (cb, sb), (cg, sg) = ((_plain(math.cos, r), _plain(math.sin, r)) for r in (_plain(math.radians, a) for a in (rot, tilt, psi)))
    return [ca * cb * cg - sa * sg, -(ca * cb * sg) - sa * cg, ca * sb,
            sa * cb * cg + ca * sg, -(sa * cb * sg) + ca * cg, sa * sb,
            -(sb * cg), sb * sg, cb]


def plain_error(a: list[np.ndarray], b: list[np.ndarray], symmetry: str) -> np.ndarray:
    """Smallest angle in degrees between ``a`` and S b, as ``rotations.with_sym_error`` has it."""
    p = [b[3 * j] * a[3 * i] + b[3 * j + 1] * a[3 * i + 1] + b[3 * j + 2] * a[3 * i + 2] for j in range(3) for i in range(3)]
    t = R.largest_of_traces(p, symmetry)
    return _plain(math.degrees, _plain(math.acos, np.clip((t - 1.0) / 2.0, -1.0, 1.0)))


def plain_polar(m: list[np.ndarray]) -> list[np.ndarray]:
    """Nearest rotations by Newton's iteration for the polar factor; for means of rotations that lie near each other."""
    for _ in range(POLAR_ROUNDS):
        cof = []
        for i in range(3):
            for j in range(3):
                (r0, r1), (c0, c1) = [k for k in range(3) if k != i], [k for k in range(3) if k != j]
                minor = m[3 * r0 + c0] * m[3 * r1 + c1] - m[3 * r0 + c1] * m[3 * r1 + c0]
                cof.append(minor if (i + j) % 2 == 0 else -minor)
        det = m[0] * cof[0] + m[1] * cof[1] + m[2] * cof[2]
        m = [0.5 * (x + c / det) for x, c in zip(m, cof)]
    return m


def settled(n: int, symmetry: str, limit: float, mean: bool, weights: tuple[float, ...] | None = None):
    """Column function of an error and the angles of ``n`` poses: the error, worked out again where it is near ``limit``.

    The error is the largest between two poses, or with ``mean`` the largest
    between the mean pose and one of them.
    """
    @F.pandas_udf(T.DoubleType())
    def judge(error: pd.Series, *angles: pd.Series) -> pd.Series:
        out = error.to_numpy(dtype=float, na_value=np.nan, copy=True)
        near = np.abs(out - limit) < NEAR
        if near.any():
            a = [s.to_numpy(dtype=float)[near] for s in angles]
            poses = [plain_matrix(*a[3 * i:3 * i + 3]) for i in range(n)]
            if mean:
                if weights is None:
                    middle = plain_polar([sum(cells[1:], cells[0]) / n for cells in zip(*poses)])
                else:
                    middle = plain_polar([sum(w * c for w, c in zip(weights, cells)) for cells in zip(*poses)])
                errors = [plain_error(middle, pose, symmetry) for pose in poses]
            else:
                errors = [plain_error(x, y, symmetry) for x, y in combinations(poses, 2)]
            out[near] = np.max(errors, axis=0)
        return pd.Series(out)
    return judge


MODES = ("drop", "average", "combined")


def consensus(tables: list[DataFrame], row_id: str, symmetry: str, mode: str = "combined", threshold: float = 5.0,
              tolerance: float = 0.5, weights: tuple[float, ...] | None = None) -> DataFrame:
    """Agreement of several tables on the particles they all have.

    drop: rows whose largest pairwise error is below the threshold, first
    table's pose. average: the mean pose of all. combined: the mean pose where
    every table lies within the threshold of it. Errors that all but meet the
    threshold are judged with the C library's functions.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if len(tables) < 2:
        raise ValueError("consensus needs at least two tables")
    n = len(tables)
    wide = pairwise_errors(shared_places(tables, row_id, tolerance, ("rot", "tilt", "psi")), n, symmetry)
    angles = [F.col(f"{c}_{i}") for i in range(n) for c in ("rot", "tilt", "psi")]
    base = [F.col("id_0").alias(row_id), "max_err", "mean_err"]
    if mode == "drop":
        judged = wide.withColumn("max_err", settled(n, symmetry, threshold, False)("max_err", *angles))
        return judged.where(F.col("max_err") < threshold).select(*base, F.col("rot_0").alias("rot"), F.col("tilt_0").alias("tilt"), F.col("psi_0").alias("psi"))
    avg = average_poses(wide, n, weights)
    for i in range(n):
        avg = R.with_sym_error(avg, "avg", f"_m{i}_", symmetry, f"_r{i}")
    avg = avg.withColumn("max_residual", F.greatest(*[F.col(f"_r{i}") for i in range(n)]))
    if mode == "combined":
        avg = avg.withColumn("max_residual", settled(n, symmetry, threshold, True, weights)("max_residual", *angles)).where(F.col("max_residual") < threshold)
    rot, tilt, psi = R.euler_of(R.matrix_of("avg"))
    return avg.select(*base, "max_residual", rot.alias("rot"), tilt.alias("tilt"), psi.alias("psi"))


def align_frames(pairs: DataFrame, a: str, b: str, symmetry: str, rounds: int = 5) -> tuple[tuple[float, ...], float]:
    """Constant rotation that brings poses ``b`` onto ``a``, and the mean error left (degrees).

    Each round picks the best symmetry copy per row and adds up nine sums; the
    3 x 3 projection of those nine numbers is all the driver does.
    """
    data = cut(pairs.select(*R.entries(a), *R.entries(b)), "frames")
    ops = group_matrices(symmetry)
    frame = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)
    for _ in range(rounds):
        turned = data.withColumns(dict(zip(R.entries("_t"), R.constant_times(frame, R.matrix_of(b)))))
        turned = turned.withColumns(dict(zip(R.entries("_p"), R.multiply_transposed(R.matrix_of("_t"), R.matrix_of(a)))))
        p = R.matrix_of("_p")
        scored = []
        for k, s in enumerate(ops):
            t = sum((F.lit(s[3 * i + j]) * p[3 * j + i] for i in range(3) for j in range(3) if (i, j) != (0, 0)), F.lit(s[0]) * p[0])
            back = tuple(s[3 * j + i] for i in range(3) for j in range(3))
            scored.append(F.struct(t.alias("t"), F.lit(-k).alias("k"), *[c.alias(e) for c, e in zip(
                R.constant_times(back, R.matrix_of(a)), R.entries("m"))]))
        best = turned.withColumn("_b", scored[0] if len(scored) == 1 else F.greatest(*scored))
        target = [F.col(f"_b.{e}") for e in R.entries("m")]
        sums = best.agg(*[F.sum(c).alias(e) for c, e in zip(R.multiply_transposed(target, R.matrix_of(b)), R.entries("s"))]).first()
        frame = tuple(float(v) for v in nearest_rotations(np.array(sums, dtype=float).reshape(1, 3, 3)).ravel())
    final = data.withColumns(dict(zip(R.entries("_t"), R.constant_times(frame, R.matrix_of(b)))))
    return frame, R.with_sym_error(final, a, "_t", symmetry, "err").agg(F.avg("err")).first()[0]
