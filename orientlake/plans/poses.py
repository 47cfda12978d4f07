"""Queries over rotations, views, grids and optics."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from orientlake.functions import grids as G, optics as O, rotations as R
from orientlake.functions.symmetry import group_matrices, operator_array
from orientlake.operators import poses
from orientlake.plans import fixtures as fx
from orientlake.plans.registry import query
from orientlake.plans.sqltext import (SQL_MATRIX, matrix_sql, ops_sql, sym_trace_sql, trace_sql, grid_sql, angle_sql,
                                      euler_back_sql, ctf_sql)

ENTRIES = R.entries("r")


def rounded(cols, digits=6):
    return [F.round(c if not isinstance(c, str) else F.col(c), digits).alias(c if isinstance(c, str) else n)
            for n, c in (cols.items() if isinstance(cols, dict) else zip(cols, cols))]


def pose_table(spark, sf, prefix="r"):
    return R.with_matrix(fx.particles(spark, sf).select("pid", "rot", "tilt", "psi"), "rot", "tilt", "psi", prefix)


def pair_table(spark, sf):
    """Both pose assignments of each shared particle as matrices a and b."""
    a = R.with_matrix(fx.particles(spark, sf).select("pid", "rot", "tilt", "psi"), "rot", "tilt", "psi", "a")
    b = R.with_matrix(fx.particles_b(spark, sf).select("pid", "rot", "tilt", "psi"), "rot", "tilt", "psi", "b")
    return a.select("pid", *R.entries("a")).join(b.select("pid", *R.entries("b")), "pid")


MATS = fx.sql_with("particles", "particles_b", SQL_MATRIX("ma", "particles", "a"), SQL_MATRIX("mb", "particles_b", "b"),
                   body="")
PAIRS = MATS.rstrip() + ",\npr as (select ma.pid, " + ", ".join(R.entries("a") + R.entries("b")) + \
    " from ma join mb on ma.pid = mb.pid)\n"


@query("euler_to_matrix", fx.sql_with("particles", SQL_MATRIX("m", "particles", "r"),
                                      body="select pid, " + ", ".join(f"round({c}, 6) + 0.0 as {c}" for c in ENTRIES) + " from m"))
def euler_to_matrix(spark, sf):
    return pose_table(spark, sf).select("pid", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ENTRIES])


@query("matrix_to_euler", fx.sql_with("particles", body=f"""
select pid, {", ".join(f"round({e}, 6) + 0.0 as {c}" for e, c in zip(matrix_sql("rot", "tilt", "psi"), ENTRIES))} from particles"""))
def matrix_to_euler(spark, sf):
    """Angles -> matrix -> angles -> matrix; the matrices must agree."""
    rot, tilt, psi = R.euler_of(R.matrix_of("q"))
    back = pose_table(spark, sf, "q").select("pid", rot.alias("rot"), tilt.alias("tilt"), psi.alias("psi"))
    return R.with_matrix(back, "rot", "tilt", "psi", "r").select(
        "pid", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ENTRIES])


@query("rot_magnitude", fx.sql_with("particles", SQL_MATRIX("m", "particles", "r"), body=f"""
select pid, round({angle_sql("r00 + r11 + r22")}, 4) as degs from m"""))
def rot_magnitude(spark, sf):
    return pose_table(spark, sf).select("pid", F.round(R.magnitude(R.matrix_of("r")), 4).alias("degs"))


@query("pose_error", PAIRS + f"select pid, round({angle_sql(trace_sql('a', 'b'))}, 4) as degs from pr")
def pose_error(spark, sf):
    return pair_table(spark, sf).select(
        "pid", F.round(R.pose_error(R.matrix_of("a"), R.matrix_of("b")), 4).alias("degs"))


@query("pose_error_sym", PAIRS + f"""
select pid, round({angle_sql(sym_trace_sql('D2', 'a', 'b'))}, 4) as d2, round({angle_sql(sym_trace_sql('C4', 'a', 'b'))}, 4) as c4,
 round({angle_sql(sym_trace_sql('O', 'a', 'b'))}, 4) as o from pr""")
def pose_error_sym(spark, sf):
    df = pair_table(spark, sf)
    for name in ("D2", "C4", "O"):
        df = R.with_sym_error(df, "a", "b", name, name.lower())
    return df.select("pid", *[F.round(c, 4).alias(c) for c in ("d2", "c4", "o")])


@query("quat_distance", PAIRS + f"select pid, round((3.0 - ({trace_sql('a', 'b')})) / 4.0, 6) + 0.0 as gap from pr")
def quat_distance(spark, sf):
    return pair_table(spark, sf).select(
        "pid", (F.round(R.quaternion_gap(R.matrix_of("a"), R.matrix_of("b")), 6) + F.lit(0.0)).alias("gap"))


FRAME = (12.5, 33.0, -71.25)


@query("apply_frame", fx.sql_with("particles", SQL_MATRIX("m", "particles", "r"), f"""f as (select {", ".join(
    f"{e} as f{k // 3}{k % 3}" for k, e in enumerate(matrix_sql(*[f"cast({v} as double)" for v in FRAME])))})""", body=f"""
select pid, {", ".join(f"round(f{i}0 * r0{j} + f{i}1 * r1{j} + f{i}2 * r2{j}, 6) + 0.0 as t{i}{j}" for i in range(3) for j in range(3))}
from m, f"""))
def apply_frame(spark, sf):
    frame = tuple(float(v) for v in G.zyz_matrices(*FRAME).ravel())
    return poses.apply_frame(pose_table(spark, sf), frame, "r", "t").select(
        "pid", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in R.entries("t")])


@query("symmetry_group", fx.sql_with("particles", SQL_MATRIX("m", "particles", "r"), f"ops as ({ops_sql(['D2', 'C4', 'T', 'O', 'I'])})", body=f"""
, g as (select sym, op, s00 + s11 + s22 as t, s00 * (s11 * s22 - s12 * s21) - s01 * (s10 * s22 - s12 * s20) + s02 * (s10 * s21 - s11 * s20) as det from ops),
small as (select m.pid, o.sym, min({angle_sql("+".join(f"s{i}{j}*r{j}{i}" for i in range(3) for j in range(3)))}) as degs
 from m cross join ops o group by m.pid, o.sym)
select s.sym, cast(max(n) as bigint) as n_ops, round(max(st), 6) + 0.0 as trace_sum, round(avg(degs), 4) as mean_least, count(*) as n_poses
from small s join (select sym, count(*) as n, sum(t) as st from g group by sym) k on k.sym = s.sym group by s.sym"""))
def symmetry_group(spark, sf):
    """For every group: its size, the sum of its traces, and the mean smallest turn of S R over its operators S."""
    df = pose_table(spark, sf)
    parts = []
    for name in ("D2", "C4", "T", "O", "I"):
        ops = group_matrices(name)
        identity = dict(zip(R.entries("i"), [F.lit(float(v)) for v in (1, 0, 0, 0, 1, 0, 0, 0, 1)]))
        degs = R.with_sym_error(df.withColumns(identity), "i", "r", name, "degs")
        parts.append(degs.agg(
            F.lit(name).alias("sym"), F.lit(len(ops)).cast("bigint").alias("n_ops"),
            (F.round(F.lit(sum(m[0] + m[4] + m[8] for m in ops)), 6) + F.lit(0.0)).alias("trace_sum"),
            F.round(F.avg("degs"), 4).alias("mean_least"), F.count(F.lit(1)).alias("n_poses")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("nearest_rotation", fx.sql_with("particles", SQL_MATRIX("m", "particles", "r"), f"grid as ({grid_sql(0)})", body=f"""
, t as (select m.pid, g.idx, round({trace_sql("r", "g")}, 9) as tr from m cross join grid g)
select pid, cast(idx as bigint) as idx from (select pid, idx, row_number() over (partition by pid order by tr desc, idx) as k from t) z where k = 1"""))
def nearest_rotation(spark, sf):
    return fx.particles(spark, sf).select("pid", G.nearest_grid_index(0)("rot", "tilt", "psi").alias("idx"))


@query("cone_id", fx.sql_with("particles", SQL_MATRIX("m", "particles", "r"), f"grid as ({grid_sql(0)})", body=f"""
, t as (select m.pid, g.idx, round({trace_sql("r", "g")}, 9) as tr from m cross join grid g)
select cast(idx // 6 as bigint) as cone, count(*) as n from (select pid, idx, row_number() over (partition by pid order by tr desc, idx) as k from t) z
where k = 1 group by 1"""))
def cone_id(spark, sf):
    return poses.with_cone(fx.particles(spark, sf).select("pid", "rot", "tilt", "psi"), 0).groupBy("cone").agg(
        F.count(F.lit(1)).alias("n"))


VIEW = "sin(radians(tilt)) * cos(radians(rot)) as vx, sin(radians(tilt)) * sin(radians(rot)) as vy, cos(radians(tilt)) as vz"


@query("view_vector", fx.sql_with("particles", f"v as (select pid, {VIEW} from particles)", body="""
select pid, round(vx, 6) + 0.0 as vx, round(vy, 6) + 0.0 as vy, round(vz, 6) + 0.0 as vz,
 round(vx, 6) + 0.0 as bx, round(vy, 6) + 0.0 as by_, round(vz, 6) + 0.0 as bz from v"""))
def view_vector(spark, sf):
    """Angles -> view -> angles -> view; both views must agree."""
    v = fx.particles(spark, sf).select("pid", *[c.alias(n) for c, n in zip(
        R.view_of_angles(F.col("rot"), F.col("tilt")), ("vx", "vy", "vz"))])
    rot, tilt = R.angles_of_view([F.col(c) for c in ("vx", "vy", "vz")])
    back = v.withColumns({"r": rot, "t": tilt})
    return back.select("pid", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("vx", "vy", "vz")], *[
        (F.round(c, 6) + F.lit(0.0)).alias(n) for c, n in zip(R.view_of_angles(F.col("r"), F.col("t")), ("bx", "by_", "bz"))])


TARGET = (math.sin(math.radians(60)) * math.cos(math.radians(40)), math.sin(math.radians(60)) * math.sin(math.radians(40)),
          math.cos(math.radians(60)))


def _copies_sql(sym, target):
    dots = []
    for s in group_matrices(sym):
        c = [sum(s[3 * i + k] * target[k] for k in range(3)) for i in range(3)]
        dots.append(f"vx * cast({c[0]!r} as double) + vy * cast({c[1]!r} as double) + vz * cast({c[2]!r} as double)")
    return "greatest(" + ", ".join(dots) + ")"


@query("view_distance", fx.sql_with("particles", f"v as (select pid, {VIEW} from particles)", body=f"""
select pid, round(degrees(acos(greatest(-1.0, least(1.0, {_copies_sql('D2', TARGET)})))), 4) as degs from v"""))
def view_distance(spark, sf):
    return fx.particles(spark, sf).select("pid", F.round(R.view_distance(
        R.view_of_angles(F.col("rot"), F.col("tilt")), TARGET, "D2"), 4).alias("degs"))


def _asu_sql(sym, fold):
    sector = f"(2 * pi() / {fold})"
    rows = []
    for i, s in enumerate(group_matrices(sym)):
        x, y, z = (" + ".join(f"cast({s[3 * a + k]!r} as double) * {v}" for k, v in enumerate(("vx", "vy", "vz"))) for a in range(3))
        rows.append(f"select pid, {i} as i, {x} as x, {y} as y, {z} as z from v")
    return f"""cp as ({' union all '.join(rows)}),
ph as (select *, atan2(y, x) as phi from cp),
ce as (select *, (phi + {sector} / 2) - {sector} * floor((phi + {sector} / 2) / {sector}) - {sector} / 2 as c from ph),
asu as (select pid, x, y, z from (select *, row_number() over (partition by pid order by round(-z, 9), round(abs(c), 9), round(abs(phi), 9), i) as k from ce) q where k = 1)"""


@query("asu_view", fx.sql_with("particles", f"v as (select pid, {VIEW} from particles)", _asu_sql("D2", 2), body="""
select pid, round(x, 6) + 0.0 as x, round(y, 6) + 0.0 as y, round(z, 6) + 0.0 as z from asu"""))
def asu_view(spark, sf):
    v = fx.particles(spark, sf).select("pid", *[c.alias(n) for c, n in zip(
        R.view_of_angles(F.col("rot"), F.col("tilt")), ("vx", "vy", "vz"))])
    best = v.withColumn("b", R.canonical_view([F.col(c) for c in ("vx", "vy", "vz")], "D2", 2))
    return best.select("pid", *[(F.round(f"b.{c}", 6) + F.lit(0.0)).alias(c) for c in "xyz"])


@query("angular_distribution", fx.sql_with("particles", f"v as (select pid, {VIEW} from particles)", _asu_sql("D2", 2), body="""
, an as (select round(degrees(atan2(y, x)), 6) as r, round(degrees(acos(greatest(-1.0, least(1.0, z)))), 6) as t from asu)
select cast(floor((r + 180) / 5) as bigint) as rot_bin, cast(floor(t / 5) as bigint) as tilt_bin, count(*) as n from an group by 1, 2"""))
def angular_distribution(spark, sf):
    return poses.angular_histogram(fx.particles(spark, sf), "D2", 2, 5.0)


@query("asu_fold", fx.sql_with("particles", SQL_MATRIX("m", "particles", "r"), f"ops as ({ops_sql(['D2'])})", body=f"""
, c as (select pid, op, {", ".join(f"r{i}0*s0{j}+r{i}1*s1{j}+r{i}2*s2{j} as c{i}{j}" for i in range(3) for j in range(3))} from m cross join ops),
e as materialized (select c.*, {euler_back_sql("c")} from c),
b as (select pid, arg_min(struct_pack({", ".join(f"f{i}{j} := c{i}{j}" for i in range(3) for j in range(3))}),
  row(round(rot - 360 * floor(rot / 360), 6) % 360, round(tilt, 6), round(psi - 360 * floor(psi / 360), 6) % 360, op)) as m from e group by pid)
select pid, {", ".join(f"round(m.f{i}{j}, 4) + 0.0 as f{i}{j}" for i in range(3) for j in range(3))} from b"""))
def asu_fold(spark, sf):
    folded = poses.fold_to_asymmetric_unit(fx.particles(spark, sf).select("pid", "rot", "tilt", "psi"), "D2", side="right")
    return R.with_matrix(folded, "rot", "tilt", "psi", "f").select(
        "pid", *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in R.entries("f")])


@query("pose_reduce_sym", fx.sql_with("particles", SQL_MATRIX("m", "particles", "r"), f"ops as ({ops_sql(['D2'])})", body=f"""
, c as (select pid, op, {", ".join(f"s{i}0*r0{j}+s{i}1*r1{j}+s{i}2*r2{j} as c{i}{j}" for i in range(3) for j in range(3))} from m cross join ops),
b as (select *, row_number() over (partition by pid order by round(-(c00 + c11 + c22), 9), op) as k from c)
select pid, {", ".join(f"round(c{i}{j}, 6) + 0.0 as f{i}{j}" for i in range(3) for j in range(3))} from b where k = 1"""))
def pose_reduce_sym(spark, sf):
    return poses.reduce_by_symmetry(pose_table(spark, sf), "r", "f", "D2").select(
        "pid", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in R.entries("f")])


@query("so3_grid", fx.sql_with("particles", f"grid as ({grid_sql(2)})", body="""
select idx // 24 as cone, cast(count(*) as bigint) as n, round(max(g02), 6) + 0.0 as vx, round(max(g12), 6) + 0.0 as vy, round(max(g22), 6) + 0.0 as vz,
 round(sum(g00), 4) + 0.0 as s00, round(sum(g11), 4) + 0.0 as s11
from (select (pid * 7919) % 4608 as idx from particles) p join grid using (idx) group by 1"""))
def so3_grid(spark, sf):
    """Every particle is given one rotation of the order-2 grid by its number; sums per cone."""
    rot, tilt, psi = G.grid_angles(F.col("idx"), 2)
    g = fx.particles(spark, sf).selectExpr("(pid * 7919) % 4608 as idx").select(
        "idx", rot.alias("rot"), tilt.alias("tilt"), psi.alias("psi"))
    return R.with_matrix(g, "rot", "tilt", "psi", "g").groupBy(F.expr("idx div 24").alias("cone")).agg(
        F.count(F.lit(1)).alias("n"), *[(F.round(F.max(c), 6) + F.lit(0.0)).alias(n) for c, n in (("g02", "vx"), ("g12", "vy"), ("g22", "vz"))],
        (F.round(F.sum("g00"), 4) + F.lit(0.0)).alias("s00"), (F.round(F.sum("g11"), 4) + F.lit(0.0)).alias("s11"))


LOCAL_SQL = """loc as (select i * 25 + j * 5 + k as cand, -4.0 + 2 * i as drot, -4.0 + 2 * j as dtilt, -4.0 + 2 * k as dpsi
 from range(5) a(i), range(5) b(j), range(5) c(k))"""


@query("local_grid", fx.sql_with("particles", LOCAL_SQL, body="""
select l.cand, p.optics_group, count(*) as n, round(sum(rot + drot), 3) as rot_sum, round(sum(tilt + dtilt), 3) as tilt_sum,
 round(sum(psi + dpsi), 3) as psi_sum from particles p cross join loc l group by 1, 2"""))
def local_grid(spark, sf):
    """Angles of all 125 local candidates of each particle, summed per candidate and optics group."""
    c = poses.local_candidates(fx.particles(spark, sf).select("optics_group", "rot", "tilt", "psi"), 4.0, 2.0)
    return c.groupBy(F.col("cand").cast("bigint").alias("cand"), "optics_group").agg(
        F.count(F.lit(1)).alias("n"), *[F.round(F.sum(f"{a}_c"), 3).alias(f"{a}_sum") for a in ("rot", "tilt", "psi")])


@query("pose_candidates", fx.sql_with("particles", SQL_MATRIX("m", "particles", "r"), LOCAL_SQL, f"""
d as (select cand, {", ".join(f"{e} as d{k // 3}{k % 3}" for k, e in enumerate(matrix_sql("drot", "dtilt", "dpsi")))} from loc)""",
    SQL_MATRIX("mc", "(select pid, cand, rot + drot as rot, tilt + dtilt as tilt, psi + dpsi as psi from particles cross join loc) q", "c", "pid, cand"), body=f"""
, f as (select m.pid, d.cand, d00*r00 + d01*r10 + d02*r20 + d10*r01 + d11*r11 + d12*r21 + d20*r02 + d21*r12 + d22*r22 as tr from m cross join d)
select mc.cand, count(*) as n, round(avg(c00 + c11 + c22), 6) + 0.0 as coarse_trace, round(avg(f.tr), 6) + 0.0 as fine_trace
from mc join f on f.pid = mc.pid and f.cand = mc.cand group by 1"""))
def pose_candidates(spark, sf):
    """Both ways of composing a pose with a local candidate: adding angles, and turning by a matrix."""
    p = R.with_matrix(fx.particles(spark, sf).select("rot", "tilt", "psi"), "rot", "tilt", "psi", "r")
    coarse = R.with_matrix(poses.local_candidates(p, 4.0, 2.0, "d"), "rot_c", "tilt_c", "psi_c", "c")
    product = R.multiply(R.matrix_of("d"), R.matrix_of("r"))
    return coarse.groupBy(F.col("cand").cast("bigint").alias("cand")).agg(
        F.count(F.lit(1)).alias("n"), (F.round(F.avg(R.trace(R.matrix_of("c"))), 6) + F.lit(0.0)).alias("coarse_trace"),
        (F.round(F.avg(R.trace(product)), 6) + F.lit(0.0)).alias("fine_trace"))


def _ball_sql(distance, spacing):
    """The lattice of the ball grid by its definition: vectors in half cells, all even or all odd, inside the rim."""
    cell, rim = f"(radians(cast({spacing} as double)) / sqrt(cast(3 as double)))", f"sin(radians(cast({distance} as double)) / 2)"
    quaternion = [["1 - 2 * (y * y + z * z)", "2 * (x * y - w * z)", "2 * (x * z + w * y)"], ["2 * (x * y + w * z)", "1 - 2 * (x * x + z * z)", "2 * (y * z - w * x)"],
                  ["2 * (x * z - w * y)", "2 * (y * z + w * x)", "1 - 2 * (x * x + y * y)"]]
    return f"""lattice as (select i * {cell} / 2 as x, j * {cell} / 2 as y, k * {cell} / 2 as z from range(-40, 41) a(i), range(-40, 41) b(j), range(-40, 41) c(k)
 where abs(i) % 2 = abs(j) % 2 and abs(j) % 2 = abs(k) % 2),
unit as (select *, sqrt(1 - x * x - y * y - z * z) as w from lattice where x * x + y * y + z * z <= {rim} * {rim} * (1 + 1e-12)),
ball as (select 4 * pi() * pi() * (1 - cos(radians(cast({distance} as double)))) / w / (select sum(1 / w) from unit) as weight,
 {", ".join(f"{quaternion[i][j]} as b{i}{j}" for i in range(3) for j in range(3))} from unit)"""


@query("ball_grid", fx.sql_with("particles", SQL_MATRIX("m", "particles", "r", "pid, optics_group"), _ball_sql(4.0, 2.0), body=f"""
select optics_group, count(*) as n, round(sum(weight), 6) as weight,
 {", ".join(f"round(avg(weight * (b{i}0*r0{i} + b{i}1*r1{i} + b{i}2*r2{i})) * 1000, 6) + 0.0 as t{i}" for i in range(3))}
from m cross join ball group by 1"""))
def ball_grid(spark, sf):
    """Haar-weighted mean of the ball-grid neighbours of every pose, per optics group."""
    p = R.with_matrix(fx.particles(spark, sf).select("optics_group", "rot", "tilt", "psi"), "rot", "tilt", "psi", "r")
    c = p.withColumn("b", F.explode(G.ball_grid_array(4.0, 2.0)))
    turned = [sum((F.col(f"b.m{i}{k}") * F.col(f"r{k}{i}") for k in range(1, 3)), F.col(f"b.m{i}0") * F.col(f"r0{i}")) for i in range(3)]
    return c.groupBy("optics_group").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("b.weight"), 6).alias("weight"),
        *[(F.round(F.avg(F.col("b.weight") * t) * 1000, 6) + F.lit(0.0)).alias(f"t{i}") for i, t in enumerate(turned)])


@query("symmetry_expand", fx.sql_with("particles", SQL_MATRIX("m", "particles", "r", "pid, dx, dy, fom"), f"ops as ({ops_sql(['D2'])})", body=f"""
select pid, cast(op as bigint) as op, dx, dy, fom, {", ".join(
    "round(" + " + ".join(f"s{k}{i} * r{k}{j}" for k in range(3)) + f", 6) + 0.0 as e{i}{j}" for i in range(3) for j in range(3))}
from m cross join ops"""))
def symmetry_expand(spark, sf):
    p = R.with_matrix(fx.particles(spark, sf).select("pid", "dx", "dy", "fom", "rot", "tilt", "psi"), "rot", "tilt", "psi", "r")
    return poses.expand_by_symmetry(p, "r", "e", "D2").select(
        "pid", F.col("op").cast("bigint").alias("op"), "dx", "dy", "fom",
        *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in R.entries("e")])


@query("replicate_rows", fx.sql_with("particles", body="select pid, cast(copy as bigint) as copy from particles, range(1, 5) r(copy)"))
def replicate_rows(spark, sf):
    return poses.replicate(fx.particles(spark, sf).select("pid"), 4).select("pid", F.col("copy").cast("bigint").alias("copy"))


# --- optics ---------------------------------------------------------------------------------

LAMBDA = "(1e10 * 6.62607015e-34 * 299792458.0) / sqrt((1.602176634e-19 * {v}) * (2 * 9.1093837015e-31 * 299792458.0 ** 2 + 1.602176634e-19 * {v}))"


@query("wavelength", fx.sql_with("particles", "optics", body=f"""
select pid, round({LAMBDA.format(v="(kv * 1000.0)")}, 9) as lambda_300, round({LAMBDA.format(v="(1000.0 * (200 + defocus_ang))")}, 9) as lambda_var
from particles join optics using (optics_group)"""))
def wavelength(spark, sf):
    return fx.particles(spark, sf).join(fx.optics(spark, sf), "optics_group").select(
        "pid", F.round(O.wavelength(F.col("kv") * 1000.0), 9).alias("lambda_300"),
        F.round(O.wavelength((F.col("defocus_ang") + 200) * 1000.0), 9).alias("lambda_var"))


@query("ctf_value", fx.sql_with("particles", "optics", body=f"""
, f as (select pid, defocus_u, defocus_v, defocus_ang, kv, cs, w, ((pid % 8) - 4) / 8.0 / px as fy, (pid % 5) / 8.0 / px as fx
 from particles join optics using (optics_group))
select pid, round({ctf_sql(LAMBDA)}, 6) + 0.0 as ctf, round(({ctf_sql(LAMBDA)}) * exp(-10.0 * (fx * fx + fy * fy)), 6) + 0.0 as damped from f"""))
def ctf_value(spark, sf):
    f = fx.particles(spark, sf).join(fx.optics(spark, sf), "optics_group").selectExpr(
        "pid", "defocus_u", "defocus_v", "defocus_ang", "kv", "cs", "w",
        "((pid % 8) - 4) / cast(8 as double) / px as fy", "(pid % 5) / cast(8 as double) / px as fx")
    args = [F.col(c) for c in ("fy", "fx", "defocus_u", "defocus_v", "defocus_ang", "kv", "cs", "w")]
    return f.select("pid", (F.round(O.ctf_value(*args), 6) + F.lit(0.0)).alias("ctf"),
                    (F.round(O.ctf_value(*args, bfactor=40.0), 6) + F.lit(0.0)).alias("damped"))


@query("logistic_predict", fx.sql_with("particles", body="""
select pid, round(1 / (1 + exp(-greatest(-60.0, least(60.0, 1.7 * score - 0.4)))), 6) as p from particles"""))
def logistic_predict(spark, sf):
    return fx.particles(spark, sf).select("pid", F.round(O.logistic(F.lit(1.7) * F.col("score") - 0.4), 6).alias("p"))


@query("combine_score", fx.sql_with("particles", body="""
select pid, round(case when pid % 7 = 0 then 0.5 * fom else fom * (score + 4) / 16 end, 6) as combined,
 round(fom * (score + 4) / 16, 6) as prior_weighted from particles"""))
def combine_score(spark, sf):
    s = fx.particles(spark, sf).selectExpr(
        "pid", "fom", "case when pid % 7 = 0 then double('NaN') else (score + 4) / 16 end as w", "(score + 4) / 16 as m")
    return s.select("pid", F.round(O.combined_score(F.col("fom"), F.col("w")), 6).alias("combined"),
                    F.round(F.col("fom") * F.col("m"), 6).alias("prior_weighted"))


@query("fom_weight", """select event_id, round(sqrt(2 * f / (1 + f)), 6) as weight
from (select event_id, greatest(0.0, least(1.0, value / 40 - 0.1)) as f from events) e""")
def fom_weight(spark, sf):
    return fx.events(spark, sf).select(
        "event_id", F.round(O.fom_weight(F.col("value") / F.lit(40.0) - 0.1), 6).alias("weight"))
