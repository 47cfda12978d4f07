"""The library's functions under names usable in SQL text."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from orientlake.functions.grids import local_offsets
from orientlake.functions.symmetry import group_matrices


@udtf(returnType="cand int, drot double, dtilt double, dpsi double")
class LocalGrid:
    """local_grid(distance, step): offsets of a local angle grid, row-major."""

    def eval(self, distance: float, step: float):
        o = local_offsets(float(distance), float(step))
        n = len(o)
        for c in range(n ** 3):
            yield c, o[c // (n * n)], o[c // n % n], o[c % n]


@udtf(returnType="op int, " + ", ".join(f"s{i}{j} double" for i in range(3) for j in range(3)))
class SymmetryOps:
    """symmetry_ops(group): operators of a point group."""

    def eval(self, name: str):
        for i, m in enumerate(group_matrices(name)):
            yield (i, *m)


def register(spark: SparkSession) -> None:
    """rot_matrix, rot_error as plain SQL functions; project_rotation for averages; local_grid and symmetry_ops as tables."""
    from orientlake.operators.consensus import project_to_rotation
    spark.udtf.register("local_grid", LocalGrid)
    spark.udtf.register("symmetry_ops", SymmetryOps)
    # mean rotation in SQL: project_rotation(sum(w * r00), ..., sum(w * r22))
    spark.udf.register("project_rotation", project_to_rotation)
    spark.sql("""create or replace temporary function rot_matrix(rot double, tilt double, psi double) returns array<double> return array(
        cos(radians(rot)) * cos(radians(tilt)) * cos(radians(psi)) - sin(radians(rot)) * sin(radians(psi)),
        -cos(radians(rot)) * cos(radians(tilt)) * sin(radians(psi)) - sin(radians(rot)) * cos(radians(psi)),
        cos(radians(rot)) * sin(radians(tilt)),
        sin(radians(rot)) * cos(radians(tilt)) * cos(radians(psi)) + cos(radians(rot)) * sin(radians(psi)),
        -sin(radians(rot)) * cos(radians(tilt)) * sin(radians(psi)) + cos(radians(rot)) * cos(radians(psi)),
        sin(radians(rot)) * sin(radians(tilt)),
        -sin(radians(tilt)) * cos(radians(psi)), sin(radians(tilt)) * sin(radians(psi)), cos(radians(tilt)))""")
    trace = " + ".join(f"a[{i}] * b[{i}]" for i in range(9))
    spark.sql(f"""create or replace temporary function rot_error(a array<double>, b array<double>) returns double return
        degrees(acos(greatest(-1D, least(1D, ({trace} - 1D) / 2D))))""")
