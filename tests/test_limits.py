"""Errors that meet a limit to the last bit."""

import duckdb
import pytest
from pyspark.sql import functions as F

from orientlake.operators import consensus as C
from orientlake.plans.scores import AVG_SQL, polar_sql
from orientlake.plans.sqltext import angle_sql, matrix_sql, sym_trace_sql

# Three poses on one axis: the largest error is 3 degrees, or the residual of the mean 1.5, but for the last bit.
POSES = {
    695: ((325.4, 0.0, 217.55), (325.4, 0.0, 216.05), (323.4, 0.0, 216.55)),
    3485: ((273.63, 0.0, 18.65), (270.13, 0.0, 20.65), (271.63, 0.0, 17.65)),
    3898: ((276.97, 0.0, 216.82), (280.47, 0.0, 216.32), (277.97, 0.0, 216.82)),
    7419: ((32.88, 0.0, 130.71), (34.980000000000004, 0.0, 130.71), (34.88, 0.0, 131.71)),
    11135: ((27.4, 0.0, 77.15), (28.099999999999998, 0.0, 76.15), (25.4, 0.0, 76.15)),
    13674: ((331.82, 0.0, 288.66), (335.32, 0.0, 286.66), (333.82, 0.0, 289.66)),
    15289: ((135.17, 0.0, 69.01), (131.67, 0.0, 71.51), (137.17, 0.0, 69.01)),
    20109: ((309.43, 0.0, 282.81), (312.93, 0.0, 280.81), (311.43, 0.0, 283.81)),
    20754: ((57.93, 0.0, 85.86), (57.93, 0.0, 87.36), (59.93, 0.0, 86.86)),
    24665: ((39.56, 0.0, 64.85), (38.160000000000004, 0.0, 63.849999999999994), (37.56, 0.0, 63.849999999999994)),
    28689: ((171.6, 0.0, 275.01), (175.1, 0.0, 273.01), (173.6, 0.0, 276.01)),
    29334: ((122.54, 0.0, 78.06), (122.54, 0.0, 79.56), (124.54, 0.0, 79.06)),
}


def _by_sql(mode):
    con = duckdb.connect()
    con.execute("create table t(pid bigint, k int, rot double, tilt double, psi double)")
    con.executemany("insert into t values (?, ?, ?, ?, ?)", [(p, k, *a) for p, poses in POSES.items() for k, a in enumerate(poses)])
    mats = ", ".join(f"x{i} as (select pid, " + ", ".join(f"{e} as m{i}{c // 3}{c % 3}" for c, e in enumerate(matrix_sql("rot", "tilt", "psi"))) + f" from t where k = {i})" for i in range(3))
    errors = ", ".join(angle_sql(sym_trace_sql("D2", f"m{i}", f"m{j}")) for i, j in ((0, 1), (0, 2), (1, 2)))
    sql = f"with recursive {mats}, wide as (select *, greatest({errors}) as max_err, 0.0 as mean_err from x0 join x1 using (pid) join x2 using (pid))"
    if mode == "drop":
        return {r[0] for r in con.execute(f"{sql} select pid from wide where max_err < 3").fetchall()}
    left = ", ".join(angle_sql(sym_trace_sql("D2", "p", f"m{i}")) for i in range(3))
    return {r[0] for r in con.execute(f"""{sql}, {AVG_SQL}, {polar_sql('sums', 'a', 'pid')}
select pid from (select polar.pid, greatest({left}) as r from polar join wide using (pid) where k = 12) q where r < 1.5""").fetchall()}


@pytest.mark.parametrize("mode, limit", [("drop", 3.0), ("combined", 1.5)])
def test_errors_at_the_limit_are_judged_as_by_sql(spark, mode, limit):
    tables = [spark.createDataFrame([(p, "m", 10.0 * p, 0.0, *poses[k]) for p, poses in POSES.items()],
                                    "pid bigint, micrograph string, x double, y double, rot double, tilt double, psi double") for k in range(3)]
    kept = {r["pid"] for r in C.consensus(tables, "pid", "D2", mode, limit).select("pid").collect()}
    assert kept == _by_sql(mode)


def test_weighted_means_at_the_limit(spark):
    rows = {k: [(1, "m", 0.0, 0.0, 0.0, 0.0, 1.5 * k), (2, "m", 10.0, 0.0, 0.0, 0.0, 10.0 * k)] for k in range(3)}
    tables = [spark.createDataFrame(rows[k], "pid bigint, micrograph string, x double, y double, rot double, tilt double, psi double") for k in range(3)]
    for weights in (None, (0.25, 0.5, 0.25)):
        kept = C.consensus(tables, "pid", "C1", "combined", 1.6, weights=weights).select("pid", F.round("max_residual", 6).alias("r")).collect()
        assert [tuple(r) for r in kept] == [(1, 1.5)]
        assert {r["pid"] for r in C.consensus(tables, "pid", "C1", "combined", 1.5 + 5e-7, weights=weights).collect()} == {1}
        assert C.consensus(tables, "pid", "C1", "combined", 1.5 - 5e-7, weights=weights).count() == 0
