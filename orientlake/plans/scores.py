"""Queries that compare poses and judge, normalise and threshold scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from orientlake.functions import rotations as R
from orientlake.operators import calibrate, compare, consensus as C, directional, filters, mixture, poses, stats as S
from orientlake.operators.match import shared_places
from orientlake.operators.ordered import grouped_quantiles, small_parts
from orientlake.operators.sets import in_order_of
from orientlake.plans import fixtures as fx
from orientlake.plans.joins import B0_SQL, BASE, CONSENSUS_SQL, JIT_SQL, three
from orientlake.plans.poses import pair_table
from orientlake.plans.registry import query
from orientlake.plans.sqltext import SQL_MATRIX, angle_sql, grid_sql, matrix_sql, sym_trace_sql, trace_sql
from orientlake.session import source_fingerprint, table_once


@query("compare_poses", fx.sql_with("pe", body="""
select count(*) as n, round(avg(err), 6) as mean, round(stddev_pop(err), 6) as std, round(avg(case when err < 5 then cast(1 as double) else cast(0 as double) end) * 100, 4) as pct5,
 round(avg(case when err < 10 then cast(1 as double) else cast(0 as double) end) * 100, 4) as pct10, round(avg(shift_err), 6) as shift_mean, round(stddev_pop(shift_err), 6) + 0.0 as shift_std,
 round(median(err), 6) as median, round(quantile_cont(err, 0.75) - quantile_cont(err, 0.25), 6) as iqr,
 round(median(shift_err), 6) as shift_median, round(quantile_cont(shift_err, 0.75) - quantile_cont(shift_err, 0.25), 6) + 0.0 as shift_iqr from pe"""))
def compare_poses(spark, sf):
    r = compare.comparison_report(fx.pairs(spark, sf))
    return r.select("n", *[(F.round(c, 4 if c.startswith("pct") else 6) + F.lit(0.0)).alias(c) for c in r.columns if c != "n"])


@query("good_by_angle", fx.sql_with("pe", body="select pid, score, round(err, 4) as err from pe where err < 2.45"))
def good_by_angle(spark, sf):
    """Current angles against the kept original ones of an updated table."""
    from orientlake.operators.match import upsert
    new = fx.particles_b(spark, sf).select("pid", "rot", "tilt", "psi", "score")
    table = upsert(fx.particles(spark, sf).select("pid", "rot", "tilt", "psi", "score"), new, "pid",
                   ["rot", "tilt", "psi", "score"], ["rot", "tilt", "psi"], only_new=True)
    return compare.pose_errors(table, "D2", "_ori").where("err < 2.45").select("pid", "score", F.round("err", 4).alias("err"))


ANGLES = ", ".join(f"m{i}.{c} as {c}_{i}" for i in range(3) for c in ("rot", "tilt", "psi"))
MATS3 = ",\n".join(f"x{i} as (select pid, " + ", ".join(f"{e} as m{i}{k // 3}{k % 3}" for k, e in enumerate(matrix_sql("rot", "tilt", "psi")))
                   + f" from {t})" for i, t in enumerate(("particles", "jit", "particles_c")))
_E = {(i, j): angle_sql(sym_trace_sql("D2", f"m{i}", f"m{j}")) for i, j in ((0, 1), (0, 2), (1, 2))}
WIDE_SQL = f"""wide as (select id_0 as pid, greatest({', '.join(_E.values())}) as max_err, ({' + '.join(_E.values())}) / 3 as mean_err,
 {', '.join(f'm{i}{a}{b}' for i in range(3) for a in range(3) for b in range(3))}
 from matched join x0 on x0.pid = id_0 join x1 on x1.pid = id_1 join x2 on x2.pid = id_2)"""
THREE = ("particles", "particles_b", "particles_c", B0_SQL, JIT_SQL, CONSENSUS_SQL, MATS3, WIDE_SQL)


def polar_sql(source: str, prefix: str, keep: str) -> str:
    """Nearest rotation by Newton's iteration for the polar factor, as a recursive table ``polar``."""
    c = [f"{prefix}{i}{j}" for i in range(3) for j in range(3)]
    n = [f"p{i}{j}" for i in range(3) for j in range(3)]

    def cof(i, j):
        a, b = [k for k in range(3) if k != i], [k for k in range(3) if k != j]
        s = "" if (i + j) % 2 == 0 else "-"
        return f"{s}(p{a[0]}{b[0]} * p{a[1]}{b[1]} - p{a[0]}{b[1]} * p{a[1]}{b[0]})"

    det = " + ".join(f"p0{j} * ({cof(0, j)})" for j in range(3))
    step = ", ".join(f"0.5 * (p{i}{j} + ({cof(i, j)}) / ({det}))" for i in range(3) for j in range(3))
    return f"""polar({keep}, k, {', '.join(n)}) as (select {keep}, 0, {', '.join(c)} from {source}
 union all select {keep}, k + 1, {step} from polar where k < 12)"""


AVG_SQL = "sums as (select pid, max_err, mean_err, " + ", ".join(
    f"(m0{i}{j} + m1{i}{j} + m2{i}{j}) / 3.0 as a{i}{j}" for i in range(3) for j in range(3)) + " from wide)"


@query("consensus_pair_error", fx.sql_with(*THREE, body="select pid, round(max_err, 4) as max_err, round(mean_err, 4) as mean_err from wide"))
def consensus_pair_error(spark, sf):
    wide = compare.pairwise_errors(shared_places(three(spark, sf), "pid", 0.5, ("rot", "tilt", "psi")), 3, "D2")
    return wide.select(F.col("id_0").alias("pid"), F.round("max_err", 4).alias("max_err"), F.round("mean_err", 4).alias("mean_err"))


@query("consensus_drop", fx.sql_with(*THREE, body="select w.pid, p.rot, p.tilt, p.psi from wide w join particles p on p.pid = w.pid where max_err < 3"))
def consensus_drop(spark, sf):
    return C.consensus(three(spark, sf), "pid", "D2", "drop", 3.0).select("pid", "rot", "tilt", "psi")


@query("consensus_order", fx.sql_with(*THREE, body="select pid, row_number() over (order by pid desc) as place from wide where max_err < 3"))
def consensus_order(spark, sf):
    """The consensus in the order of the first table, here by descending number."""
    first = fx.particles(spark, sf).select("pid", (-F.col("pid")).alias("file_order"))
    return in_order_of(C.consensus(three(spark, sf), "pid", "D2", "drop", 3.0).select("pid"), first, "pid").select("pid", "place")


@query("consensus_average", fx.sql_with(*THREE, AVG_SQL, polar_sql("sums", "a", "pid"), recursive=True, body="""
select pid, """ + ", ".join(f"round(p{i}{j}, 4) + 0.0 as q{i}{j}" for i in range(3) for j in range(3)) + " from polar where k = 12"))
def consensus_average(spark, sf):
    avg = C.consensus(three(spark, sf), "pid", "D2", "average")
    return R.with_matrix(avg, "rot", "tilt", "psi", "q").select("pid", *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in R.entries("q")])


@query("consensus_combined", fx.sql_with(*THREE, AVG_SQL, polar_sql("sums", "a", "pid"), recursive=True, body=f"""
, res as (select polar.pid, greatest({', '.join(angle_sql(sym_trace_sql('D2', 'p', f'm{i}')) for i in range(3))}) as max_residual
 from polar join wide on wide.pid = polar.pid where k = 12)
select pid, round(max_residual, 4) as max_residual from res where max_residual < 1.5"""))
def consensus_combined(spark, sf):
    return C.consensus(three(spark, sf), "pid", "D2", "combined", 1.5).select("pid", F.round("max_residual", 4).alias("max_residual"))


@query("match_report", fx.sql_with("particles", "particles_b", "particles_c", B0_SQL, JIT_SQL, CONSENSUS_SQL, body="""
select cast(f as bigint) as file, n as n_original, m as n_matched, round(m / n, 6) as fraction from
 (select 0 as f, count(*) as n from particles union all select 1, count(*) from jit union all select 2, count(*) from particles_c) q,
 (select count(*) as m from matched) k"""))
def match_report(spark, sf):
    tables = three(spark, sf)
    matched = shared_places(tables, "pid").agg(F.count(F.lit(1)).alias("n_matched"))
    out = None
    for i, t in enumerate(tables):
        row = t.agg(F.lit(i).cast("bigint").alias("file"), F.count(F.lit(1)).alias("n_original"))
        out = row if out is None else out.unionByName(row)
    return out.withColumn("n_matched", matched.scalar()).withColumn("fraction", F.round(F.col("n_matched") / F.col("n_original"), 6))


LONG_SQL = """lng as (select pid, 0.5 as w, rot, tilt, psi from particles union all select pid, 0.3, rot, tilt, psi from particles_b
 union all select pid, 0.2, rot, tilt, psi from particles_c)"""
MEAN_SQL = ("mats as (select pid, w, " + ", ".join(f"{e} as r{k // 3}{k % 3}" for k, e in enumerate(matrix_sql("rot", "tilt", "psi"))) + " from lng)",
            "sums as (select pid, " + ", ".join(f"sum(w * r{i}{j}) / (sum(w) + 1e-12) as a{i}{j}" for i in range(3) for j in range(3)) + " from mats group by pid)")


@query("mean_rotation", fx.sql_with("particles", "particles_b", "particles_c", LONG_SQL, *MEAN_SQL, polar_sql("sums", "a", "pid"), recursive=True, body=f"""
, final as (select * from polar where k = 12),
d as (select f.pid, count(*) as n, avg(radians({angle_sql(trace_sql('p', 'r'))})) as disp from final f join mats m on m.pid = f.pid group by f.pid)
select f.pid, d.n, round(d.disp, 4) as dispersion, {", ".join(f"round(p{i}{j}, 6) + 0.0 as mean{i}{j}" for i in range(3) for j in range(3))} from final f join d on d.pid = f.pid"""))
def mean_rotation(spark, sf):
    rows = None
    for table, w in ((fx.particles, 0.5), (fx.particles_b, 0.3), (fx.particles_c, 0.2)):
        part = table(spark, sf).select("pid", F.lit(w).alias("w"), "rot", "tilt", "psi")
        rows = part if rows is None else rows.unionByName(part)
    dealt = rows.repartition(small_parts(rows), "pid")  # a particle stands once in each table; angles are moved, not matrices
    m = C.mean_rotation(R.with_matrix(dealt, "rot", "tilt", "psi", "r"), ["pid"], "r", "w", gathered=True)
    return m.select("pid", "n", F.round("dispersion", 4).alias("dispersion"), *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in R.entries("mean")])


@query("align_frames")
def align_frames(spark, sf):
    """The second assignment is turned by a constant frame; the fit must find the way back."""
    pairs = poses.apply_frame(pair_table(spark, sf), (0.0, -1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0), "b", "t")
    frame, left = C.align_frames(pairs, "a", "t", "C1")
    return pairs.agg(F.count(F.lit(1)).alias("n")).select("n", F.round(F.lit(left), 4).alias("mean_error"), *[
        (F.round(F.lit(v), 4) + F.lit(0.0)).alias(c) for v, c in zip(frame, R.entries("f"))])


@query("displacement", fx.sql_with("particles", "particles_b", "particles_c", SQL_MATRIX("m0", "particles", "a", "pid, dx as dx0, dy as dy0"),
    "cand as (select pid, 0 as k, rot, tilt, psi, dx, dy from particles_b union all select pid, 1, rot, tilt, psi, dx + 0.1, dy from particles_c)",
    SQL_MATRIX("m1", "cand", "b", "pid, k, dx, dy"), body=f"""
select cast(k as bigint) as k, round(median({angle_sql(trace_sql('a', 'b'))}), 4) as median_angle,
 round(median(sqrt((dx - dx0) * (dx - dx0) + (dy - dy0) * (dy - dy0))), 4) as median_shift from m1 join m0 on m0.pid = m1.pid group by 1"""))
def displacement(spark, sf):
    cols = ["pid", "rot", "tilt", "psi", "dx", "dy"]
    cand = fx.particles_b(spark, sf).select(F.lit(0).cast("bigint").alias("k"), *cols).unionByName(
        fx.particles_c(spark, sf).select(F.lit(1).cast("bigint").alias("k"), *cols).withColumn("dx", F.col("dx") + 0.1))
    before = fx.particles(spark, sf).select("pid", *[F.col(c).alias(c + "_2") for c in cols[1:]])
    moved = compare.pose_errors(cand.join(before, "pid"), "C1")
    return compare.displacement_report(moved, "k").select("k", F.round("median_angle", 4).alias("median_angle"), F.round("median_shift", 4).alias("median_shift"))


# --- summaries ------------------------------------------------------------------------------

DESCRIBED = ["rot", "tilt", "score", "fom", "defocus_u"]


@query("describe_columns", fx.sql_with("particles", body=" union all ".join(
    f"select '{c}' as \"column\", count({c}) as n, round(avg({c}), 6) as mean, round(min({c}), 6) as min, round(max({c}), 6) as max, round(stddev_pop({c}), 6) as std, round(median({c}), 6) as median from particles"
    for c in DESCRIBED)))
def describe_columns(spark, sf):
    d = S.describe(fx.particles(spark, sf), DESCRIBED)
    return d.select("column", "n", *[F.round(c, 6).alias(c) for c in ("mean", "min", "max", "std", "median")])


@query("histogram", """with q as (select quantile_cont(value, 0.01) as lo, quantile_cont(value, 0.99) as hi from events),
c as (select least(greatest(value, lo), hi) as v from events, q), r as (select min(v) as lo, max(v) as hi from c)
select cast(least(floor((v - lo) / ((hi - lo) / 40)), 39) as bigint) as bin, count(*) as n, round(count(*) * 100.0 / (select count(*) from c), 6) as pct from c, r group by 1""")
def histogram(spark, sf):
    c = filters.clip_quantiles(fx.events(spark, sf).select("value"), "value", 0.01, 0.99, "v").select("v")
    return S.histogram(c, "v", 40).select("bin", "n", F.round("pct", 6).alias("pct"))


@query("score_hist_good_bad", fx.sql_with("pe", body="""
, s as (select case when err < 2.45 then 'good' else 'bad' end as class, score as v from pe), r as (select min(v) as lo, max(v) as hi from s),
b as (select class, cast(least(floor((v - lo) / ((hi - lo) / 30)), 29) as bigint) as bin, count(*) as n from s, r group by 1, 2)
select class, bin, n, round(n * 100.0 / sum(n) over (partition by class), 6) as pct from b"""))
def score_hist_good_bad(spark, sf):
    rows = fx.pairs(spark, sf).select(F.when(F.col("err") < 2.45, "good").otherwise("bad").alias("class"), "score")
    return S.histogram(rows, "score", 30, group=["class"]).select("class", "bin", "n", F.round("pct", 6).alias("pct"))


@query("benchmark_rollup", fx.sql_with("pe", body="""
, h as (select optics_group as run, half, count(*) as n, avg(err) as mean_deg, median(err) as median_deg, avg(shift_err) as shift_mean from pe group by 1, 2)
select run, cast(sum(n) as bigint) as n, round(avg(mean_deg), 6) as mean_deg, round(avg(median_deg), 6) as median_deg, round(avg(shift_mean), 6) as shift_mean from h group by 1"""))
def benchmark_rollup(spark, sf):
    p = fx.pairs(spark, sf)
    key = ["optics_group", "half"]
    logs = p.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.avg("err").alias("mean_deg"), F.avg("shift_err").alias("shift_mean")).join(
        grouped_quantiles(p.select(*key, "err"), "err", {"median_deg": .5}, key), key)
    return logs.groupBy(F.col("optics_group").alias("run")).agg(F.sum("n").alias("n"), *[
        F.round(F.avg(c), 6).alias(c) for c in ("mean_deg", "median_deg", "shift_mean")])


@query("robust_limits", fx.sql_with("metrics", body="""
, m as (select run, loss - 5 as v from metrics where loss is not null), k as (select run, v from m where v > 0 or run not in (select run from m where v <= 0)),
q as (select run, quantile_cont(v, 0.05) as lo, quantile_cont(v, 0.95) as hi from k group by run)
select run, round(case when hi > lo then lo - (hi - lo) * 0.1 end, 6) as y_min, round(case when hi > lo then hi + (hi - lo) * 0.1 end, 6) as y_max from q"""))
def robust_limits(spark, sf):
    m = fx.train_metrics(spark, sf).select("run", (F.col("loss") - 5).alias("v"))
    return S.robust_limits(m, "v", ["run"]).select("run", F.round("y_min", 6).alias("y_min"), F.round("y_max", 6).alias("y_max"))


@query("epoch_metrics", fx.sql_with("metrics", body="""
select epoch, count(loss) as n, round(avg(loss), 6) as mean_loss, round(median(loss), 6) as median_loss from metrics where loss is not null group by epoch"""))
def epoch_metrics(spark, sf):
    m = fx.train_metrics(spark, sf).where("loss is not null")
    return m.groupBy("epoch").agg(F.count("loss").alias("n"), F.round(F.avg("loss"), 6).alias("mean_loss")).join(
        grouped_quantiles(m.select("epoch", "loss"), "loss", {"median_loss": .5}, ["epoch"]), "epoch").withColumn("median_loss", F.round("median_loss", 6))


# --- how well a score tells right from wrong -------------------------------------------------

PROB = "(score + 4) / 9"


def scored(spark, sf):
    return fx.pairs(spark, sf).withColumn("p", F.expr(PROB))


QBIN_SQL = """q as (select least({bins}, greatest(2, count(*) // 200)) as q from pe), ed as (select distinct quantile_cont({col}, i / (select cast(q as double) from q)) as e
 from pe, range(0, {bins} + 1) r(i) where i <= (select q from q) group by i),
binned as (select *, greatest((select count(*) from ed where e < pe.{col}), 1) as bin from pe)"""


def _edges_sql(col, bins):
    """Distinct quantile edges by position, without a correlated look-up."""
    return f"""cnt as (select least({bins}, greatest(2, count(*) // 200)) as q from pe),
ranked as (select {col} as v, row_number() over (order by {col}) - 1 as k, count(*) over () as n from pe),
pos as (select i, (i / cast(q as double)) * (n - 1) as h from cnt, range(0, {bins + 1}) r(i), (select count(*) as n from pe) t where i <= q),
ed as (select distinct lo.v + (hi.v - lo.v) * (h - floor(h)) as e from pos join ranked lo on lo.k = floor(h) join ranked hi on hi.k = ceil(h)),
binned as (select pe.*, greatest(count(e), 1) as bin from pe left join ed on e < pe.{col} group by all)"""


@query("quantile_bins", fx.sql_with("pe", _edges_sql("score", 15), body="""
select bin, count(*) as n, round(avg(score), 6) as score_mean, round(avg(cast(correct as double)), 6) as acc, round(avg(err), 6) as err_mean,
 round(median(err), 4) as err_median from binned group by bin"""))
def quantile_bins(spark, sf):
    b = S.quantile_bins(scored(spark, sf), "score", "correct", "err")
    return b.select("bin", "n", F.round("score_mean", 6).alias("score_mean"), F.round("acc", 6).alias("acc"), F.round("err_mean", 6).alias("err_mean"), F.round("err_median", 4).alias("err_median"))


@query("reliability", fx.sql_with("pe", _edges_sql("fom", 10), body="""
select bin, round(avg(fom), 6) as p_mean, round(avg(cast(correct as double)), 6) as y_mean from binned group by bin"""))
def reliability(spark, sf):
    return S.reliability(scored(spark, sf), "fom", "correct").select("bin", F.round("p_mean", 6).alias("p_mean"), F.round("y_mean", 6).alias("y_mean"))


@query("spearman", fx.sql_with("pe", body="""
, e as (select score, round(err, 4) as err from pe), r as (select rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0 as rx, rank() over (order by err) + (count(*) over (partition by err) - 1) / 2.0 as ry from e)
select round(corr(rx, ry), 6) as spearman, count(*) as n from r"""))
def spearman(spark, sf):
    rows = fx.pairs(spark, sf).select("score", F.round("err", 4).alias("err"))
    return S.spearman(rows, "score", "err").select(F.round("spearman", 6).alias("spearman"), "n")


@query("pearson", fx.sql_with("pe", body="select round(corr(score, err), 6) as pearson, count(*) as n from pe"))
def pearson(spark, sf):
    return S.pearson(fx.pairs(spark, sf), "score", "err").select(F.round("pearson", 6).alias("pearson"), "n")


@query("roc_auc", fx.sql_with("pe", body="""
, r as (select correct, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0 as rk from pe)
select round((sum(rk) filter (where correct = 1) - sum(correct) * (sum(correct) + 1) / 2.0) / (sum(correct) * (count(*) - sum(correct))), 6) as roc_auc from r"""))
def roc_auc(spark, sf):
    return S.roc_auc(fx.pairs(spark, sf), "score", "correct").select(F.round("roc_auc", 6).alias("roc_auc"))


@query("pr_auc", fx.sql_with("pe", body="""
, c as (select score, count(*) as n, sum(correct) as pos from pe group by score),
w as (select pos, sum(pos) over (order by score desc) as tp, sum(n) over (order by score desc) as k, sum(pos) over () as p from c)
select round(sum(cast(pos as double) / p * tp / k), 6) as pr_auc from w"""))
def pr_auc(spark, sf):
    return S.pr_auc(fx.pairs(spark, sf), "score", "correct").select(F.round("pr_auc", 6).alias("pr_auc"))


@query("youden_threshold", fx.sql_with("pe", body="""
, c as (select score, count(*) as n, sum(correct) as pos from pe group by score),
w as (select score, sum(pos) over (order by score desc) as tp, sum(n - pos) over (order by score desc) as fp, sum(pos) over () as p, sum(n - pos) over () as q from c),
j as (select score, round(cast(tp as double) / p - cast(fp as double) / q / 2.0, 12) as j from w)
select score as threshold, round(j, 6) as quality from j order by j desc, score desc limit 1"""))
def youden_threshold(spark, sf):
    return S.youden(fx.pairs(spark, sf), "score", "correct").select("threshold", F.round("quality", 6).alias("quality"))


@query("brier", fx.sql_with("pe", body=f"select round(avg(({PROB} - correct) * ({PROB} - correct)), 6) as brier from pe"))
def brier(spark, sf):
    return S.brier(scored(spark, sf), "p", "correct").select(F.round("brier", 6).alias("brier"))


@query("logloss", fx.sql_with("pe", body=f"""
select round(avg(-ln(case when correct = 1 then least(greatest({PROB}, 1e-6), 1 - 1e-6) else 1 - least(greatest({PROB}, 1e-6), 1 - 1e-6) end)), 6) as logloss from pe"""))
def logloss(spark, sf):
    return S.log_loss(scored(spark, sf), "p", "correct").select(F.round("logloss", 6).alias("logloss"))


@query("ece", fx.sql_with("pe", body="""
, b as (select least(floor(fom * 15), 14) as b, count(*) as n, avg(fom) as p, avg(cast(correct as double)) as y from pe group by 1)
select round(sum(n * abs(y - p)) / sum(n), 6) as ece from b"""))
def ece(spark, sf):
    return S.calibration_error(fx.pairs(spark, sf), "fom", "correct").select(F.round("ece", 6).alias("ece"))


@query("background_quantile", fx.sql_with("pe", body="""
, c as (select count(*) filter (where err < 2.45) as g, count(*) as n from pe),
h as (select g, n, (1 - cast(g as double) / n) * (n - 1) as h from c), r as (select score, row_number() over (order by score) - 1 as k from pe)
select round(lo.score + (hi.score - lo.score) * (h - floor(h)), 6) as edge, g as n_good, n as n_all from h
 join r lo on lo.k = floor(h) join r hi on hi.k = ceil(h)"""))
def background_quantile(spark, sf):
    p = fx.pairs(spark, sf)
    n = p.agg(F.count(F.when(F.col("err") < 2.45, 1)).alias("good"), F.count(F.lit(1)).alias("all")).first()
    q = grouped_quantiles(p.select("score"), "score", {"edge": 1 - n["good"] / n["all"]})
    return q.select(F.round("edge", 6).alias("edge"), F.lit(n["good"]).cast("bigint").alias("n_good"), F.lit(n["all"]).cast("bigint").alias("n_all"))


@query("logistic_calibration")
def logistic_calibration(spark, sf):
    p = calibrate.stratified_split(fx.pairs(spark, sf).select("pid", "score", "correct"), "pid", "correct")
    a, b = calibrate.logistic_fit(p.where("not is_test"), "score", "correct")
    return p.groupBy("is_test").agg(F.count(F.lit(1)).alias("n"), F.round(F.lit(a), 6).alias("a"), F.round(F.lit(b), 6).alias("b"),
                                    F.round(F.avg("correct"), 6).alias("rate"))


@query("calibration_report")
def calibration_report(spark, sf):
    return calibrate.report(fx.pairs(spark, sf), {"score": 0.005, "fom": 0.0}, "correct", "err", "pid")


# --- per cone --------------------------------------------------------------------------------

def coned(spark, sf):
    """Predicted and true cone of each shared particle, order 0."""
    def build():
        a = poses.with_cone(fx.particles(spark, sf).select("pid", "rot", "tilt", "psi"), 0).select("pid", F.col("cone").alias("true_cone"))
        b = poses.with_cone(fx.particles_b(spark, sf).select("pid", "score", "rot", "tilt", "psi"), 0).select("pid", "score", "cone")
        return b.join(a, "pid")
    return table_once(spark, ("coned", sf, source_fingerprint(spark, f"{sf}/lineitem.parquet")), "coned", build)


CONED_SQL = ("particles", "particles_b", f"grid as ({grid_sql(0)})", SQL_MATRIX("ma", "particles", "a"), SQL_MATRIX("mb", "particles_b", "b", "pid, score"), f"""
ta as materialized (select pid, min({{'t': -round({trace_sql('a', 'g')}, 9), 'i': g.idx}}).i // 6 as cone from ma cross join grid g group by pid)""", f"""
tb as materialized (select pid, score, min({{'t': -round({trace_sql('b', 'g')}, 9), 'i': g.idx}}).i // 6 as cone from mb cross join grid g group by pid, score)""", """
rows as (select tb.pid, tb.cone, tb.score, ta.cone = tb.cone as good from tb join ta on ta.pid = tb.pid),
rule as (select cone, count(*) as n_all, count(*) filter (where good) as n_good, quantile_cont(score, 0.95) as edge from rows group by cone),
chosen as (select r.cone, r.score from rows r join rule u on u.cone = r.cone where case when n_good >= 10 and r.cone % 2 = 0 then good when n_all >= 10 then score >= edge else true end),
med as (select cone, median(score) as m from chosen group by cone),
mad as (select c.cone, m, greatest(median(abs(c.score - m)), 1e-8) as d from chosen c join med on med.cone = c.cone group by 1, 2),
st as (select k as cone, coalesce(m, (select median(m) from mad)) as median, coalesce(d, (select median(d) from mad)) as mad from range(12) r(k) left join mad on mad.cone = k)""")


def fitted(spark, sf):
    """Even cones are fitted on rows in the right cone, odd ones on their top scores."""
    rows = coned(spark, sf).withColumn("true_cone", F.when(F.col("cone") % 2 == 0, F.col("true_cone")).otherwise(F.lit(-1)))
    return directional.fit(rows, 12, true_cone="true_cone")


@query("directional_fit", fx.sql_with(*CONED_SQL, body="select cone, round(median, 6) + 0.0 as median, round(mad, 8) as mad from st"))
def directional_fit(spark, sf):
    return fitted(spark, sf).select("cone", (F.round("median", 6) + F.lit(0.0)).alias("median"), F.round("mad", 8).alias("mad"))


@query("directional_zscore", fx.sql_with(*CONED_SQL, body="""
select tb.pid, tb.cone, round((tb.score - st.median) / st.mad, 4) + 0.0 as z from tb join st on st.cone = tb.cone"""))
def directional_zscore(spark, sf):
    return directional.zscores(coned(spark, sf), fitted(spark, sf)).select("pid", "cone", (F.round("z", 4) + F.lit(0.0)).alias("z"))


# --- mixtures --------------------------------------------------------------------------------

@query("gmm_fit")
def gmm_fit(spark, sf):
    """Mixture of the event values, components in order of their means."""
    g = mixture.fit_best(mixture.value_counts(fx.events(spark, sf), "value"))
    parts = F.inline(F.array(*[F.struct(F.lit(k).alias("component"), F.round(F.lit(g.weights[k]), 6).alias("weight"), F.round(F.lit(g.means[k]), 6).alias("mean"),
                                        F.round(F.lit(g.stds[k]), 6).alias("std")) for k in range(g.size)]))
    return fx.events(spark, sf).agg(F.count("value").alias("n")).select("n", parts)


@query("gmm_threshold")
def gmm_threshold(spark, sf):
    p = fx.pairs(spark, sf)
    good = p.where("err < 2.45").select((F.col("score") + 3).alias("score"))
    bad = p.where("err >= 2.45").select("score")
    t = mixture.separate(bad, good, "score")
    return p.agg(F.count(F.lit(1)).alias("n"), F.count(F.when((F.col("err") < 2.45) & (F.col("score") + 3 > t["threshold"]), 1)).alias("good_kept"),
                 F.count(F.when((F.col("err") >= 2.45) & (F.col("score") > t["threshold"]), 1)).alias("bad_kept")).withColumns({
                     "threshold": F.round(F.lit(t["threshold"]), 6), "method": F.lit(t["method"])})
