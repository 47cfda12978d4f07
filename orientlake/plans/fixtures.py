"""Particle, optics and voxel tables derived from the star-schema parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from orientlake.operators.compare import pose_errors
from orientlake.operators.match import match_by_name
from orientlake.operators.ordered import PARTS_PER_SPLIT, number_rows
from orientlake.plans.sqltext import angle_sql, matrix_sql, sym_trace_sql
from orientlake.session import shuffle_width, source_fingerprint, table_once

ROW_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
             "l_quantity", "l_discount", "l_tax", "l_shipdate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = ("particles", sf_dir, source_fingerprint(spark, f"{sf_dir}/lineitem.parquet"))
    return table_once(spark, key, "particles", lambda: _particles(spark, sf_dir))


def _particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(*ROW_ORDER)
    k = number_rows(rows, ROW_ORDER, "pid", ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax"], scanned=True)
    return k.selectExpr(
        "pid",
        "concat(lpad(cast(1 + (pid - 1) % 500 as string), 6, '0'), '@Extract/job012/stack_',"
        " cast((pid - 1) div 500 as string), '.mrcs') as image_name",
        "concat('MotionCorr/job002/mic_', lpad(cast((pid - 1) % 200 as string), 4, '0'), '.mrc') as micrograph",
        "1 + l_orderkey % 5 as optics_group",
        "1 + pid % 2 as half",
        "cast((pid * 7919) % 409600 as double) / 100 as x",
        "cast((pid * 104729) % 409600 as double) / 100 as y",
        "cast((l_partkey * 7919) % 36000 as double) / 100 as rot",
        "cast((l_suppkey * 104729 + l_partkey) % 18000 as double) / 100 as tilt",
        "cast((pid * 1299709) % 36000 as double) / 100 as psi",
        "cast((l_partkey % 101) - 50 as double) / 10 as dx",
        "cast((l_suppkey % 101) - 50 as double) / 10 as dy",
        "10000 + l_quantity * 300 as defocus_u",
        "9800 + l_quantity * 300 as defocus_v",
        "cast(l_partkey % 180 as double) as defocus_ang",
        "l_discount * 10 as fom",
        "(l_tax * 100 - 4) + l_discount * 10 as score",
    )


def particles_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second pose assignment: nine rows in ten, other paths, jittered values."""
    return particles(spark, sf_dir).where("pid % 10 <> 0").selectExpr(
        "pid",
        "concat(substr(image_name, 1, 7), 'Other/path/', substr(image_name, 23)) as image_name",
        "concat('/abs/mics/', substr(micrograph, 19)) as micrograph",
        "optics_group", "half",
        "x + cast((pid % 9) - 4 as double) / 2 as x",
        "y + cast((pid % 7) - 3 as double) / 2 as y",
        "rot + cast((pid % 13) - 6 as double) * cast(0.7 as double) as rot",
        "tilt",
        "psi + cast((pid % 11) - 5 as double) * cast(0.5 as double) as psi",
        "dx + cast(0.25 as double) as dx", "dy - cast(0.5 as double) as dy", "fom", "score",
    )


def particles_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third assignment on the same places as the first: six rows in seven."""
    return particles(spark, sf_dir).where("pid % 7 <> 0").selectExpr(
        "pid", "image_name", "micrograph", "optics_group", "half", "x", "y",
        "rot + cast((pid % 5) - 2 as double) as rot", "tilt",
        "psi - cast((pid % 3) - 1 as double) as psi", "dx", "dy", "fom", "score",
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both pose assignments of each shared particle compared: angle under D2 and shift length."""
    key = ("pairs", sf_dir, source_fingerprint(spark, f"{sf_dir}/lineitem.parquet"))
    return table_once(spark, key, "pairs", lambda: _pairs(spark, sf_dir))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = particles(spark, sf_dir), particles_b(spark, sf_dir)
    keep = ["image_name", "rot", "tilt", "psi", "dx", "dy"]
    parts = max(shuffle_width(spark), PARTS_PER_SPLIT * a.rdd.getNumPartitions())
    errors = pose_errors(match_by_name(a.select("pid", "optics_group", "half", *keep), b.select("score", "fom", *keep), parts=parts), "D2")
    return errors.selectExpr("pid", "optics_group", "half", "err", "shift_err", "score_2 as score", "fom_2 as fom",
                             "cast(err <= 3 as int) as correct")


def optics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").selectExpr(
        "cast(r_regionkey + 1 as bigint) as optics_group",
        "cast(1.0 as double) + cast(0.05 as double) * r_regionkey as px", "8 as box",
        "cast(300 as double) as kv", "cast(2.7 as double) as cs", "cast(0.1 as double) as w",
    )


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each 64-float embedding read as one 8 x 8 picture."""
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id", "label", "8 as side", "embedding as pixels")


def planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each picture as plane z of an 8 x 8 x 8 volume; incomplete volumes are left out."""
    p = table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id div 8 as vol_id", "cast(vec_id % 8 as int) as z", "embedding as plane")
    full = p.groupBy("vol_id").count().where("count = 8").select("vol_id")
    return p.join(full, "vol_id", "left_semi")


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        planes(spark, sf_dir).select("vol_id", "z", F.posexplode("plane").alias("i", "value"))
        .selectExpr("vol_id", "z", "cast(i div 8 as int) as y", "cast(i % 8 as int) as x",
                    "cast(value as double) as v")
    )


def train_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as training curves: one run per user."""
    return table(spark, sf_dir, "events").selectExpr(
        "user_id as run", "event_id as step", "event_id div 1000 as epoch",
        "case when event_type = 'error' then null else value end as loss")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


# --- the same tables for the checking engine ------------------------------------------------

def _pairs_sql() -> str:
    m = ", ".join(f"{e} as {{0}}{k // 3}{k % 3}" for k, e in enumerate(matrix_sql("rot", "tilt", "psi")))
    return f"""select a.pid, a.optics_group, a.half, {angle_sql(sym_trace_sql('D2', 'a', 'b'))} as err,
 sqrt((a.dx - b.dx) * (a.dx - b.dx) + (a.dy - b.dy) * (a.dy - b.dy)) as shift_err, b.score, b.fom,
 cast({angle_sql(sym_trace_sql('D2', 'a', 'b'))} <= 3 as int) as correct
from (select pid, optics_group, half, dx, dy, {m.format('a')} from particles) a
 join (select pid, dx, dy, score, fom, {m.format('b')} from particles_b) b on a.pid = b.pid"""


_SQL = {
    "particles": """particles as (
select pid,
 concat(lpad(cast(1 + (pid-1) % 500 as string),6,'0'),'@Extract/job012/stack_', cast((pid-1 - (pid-1) % 500)/500 as int), '.mrcs') as image_name,
 concat('MotionCorr/job002/mic_', lpad(cast((pid-1) % 200 as string),4,'0'), '.mrc') as micrograph,
 1 + l_orderkey % 5 as optics_group,
 1 + pid % 2 as half,
 cast((pid * 7919) % 409600 as double)/100 as x,
 cast((pid * 104729) % 409600 as double)/100 as y,
 cast((l_partkey * 7919) % 36000 as double)/100 as rot,
 cast((l_suppkey * 104729 + l_partkey) % 18000 as double)/100 as tilt,
 cast((pid * 1299709) % 36000 as double)/100 as psi,
 cast((l_partkey % 101) - 50 as double)/10 as dx,
 cast((l_suppkey % 101) - 50 as double)/10 as dy,
 10000 + l_quantity*300 as defocus_u, 9800 + l_quantity*300 as defocus_v, cast(l_partkey % 180 as double) as defocus_ang,
 l_discount*10 as fom, (l_tax*100 - 4) + l_discount*10 as score
from (select cast(row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate) as bigint) as pid, * from lineitem) k)""",
    "particles_b": """particles_b as (
select pid, concat(substr(image_name,1,7),'Other/path/', substr(image_name,23)) as image_name,
 concat('/abs/mics/', substr(micrograph,19)) as micrograph, optics_group, half,
 x + cast((pid % 9) - 4 as double)/2 as x, y + cast((pid % 7) - 3 as double)/2 as y,
 rot + cast((pid % 13) - 6 as double)*cast(0.7 as double) as rot, tilt, psi + cast((pid % 11) - 5 as double)*cast(0.5 as double) as psi,
 dx + 0.25 as dx, dy - 0.5 as dy, fom, score
from particles where pid % 10 <> 0)""",
    "particles_c": """particles_c as (
select pid, image_name, micrograph, optics_group, half, x, y, rot + cast((pid % 5) - 2 as double) as rot, tilt,
 psi - cast((pid % 3) - 1 as double) as psi, dx, dy, fom, score from particles where pid % 7 <> 0)""",
    "optics": """optics as (
select cast(r_regionkey+1 as bigint) as optics_group, cast(1.0 as double) + cast(0.05 as double)*r_regionkey as px, 8 as box,
 cast(300 as double) as kv, cast(2.7 as double) as cs, cast(0.1 as double) as w from region)""",
    "voxels": """planes as (
select vec_id // 8 as vol_id, cast(vec_id % 8 as int) as z, embedding as plane from embeddings
 where vec_id // 8 in (select vec_id // 8 from embeddings group by 1 having count(*) = 8)),
voxels as (
select vol_id, z, cast((i-1) // 8 as int) as y, cast((i-1) % 8 as int) as x, cast(plane[i] as double) as v
from (select vol_id, z, plane, unnest(range(1, 65)) as i from planes) u)""",
    "metrics": """metrics as (
select user_id as run, event_id as step, event_id // 1000 as epoch,
 case when event_type = 'error' then null else value end as loss from events)""",
}
_SQL["pe"] = "pe as (" + _pairs_sql() + ")"
_NEEDS = {"pe": ["particles", "particles_b"], "particles_b": ["particles"], "particles_c": ["particles"]}


def sql_with(*names: str, body: str, recursive: bool = False) -> str:
    """``body`` behind the common table expressions it reads; parts starting
    with a bare name are derived tables, anything longer is taken as written."""
    ordered: list[str] = []
    for name in names:
        for need in [*_NEEDS.get(name, []), name]:
            text = _SQL.get(need, need)
            if text not in ordered:
                ordered.append(text)
    return ("with recursive " if recursive else "with ") + ",\n".join(ordered) + "\n" + body
