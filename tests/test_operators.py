"""Table operators on small adversarial tables against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orientlake.frames import ColumnRoles, MissingColumns, nan_to_null, require_columns
from orientlake.functions import grids as G, rotations as R
from orientlake.operators import filters, match as M, ordered as O, ranking as K, sets as S, stats
from orientlake.operators.ordered import seeded_order
from orientlake.sources import mrc, star


def points(spark, n, seed, spread=60.0, crowd=0.33, mics=3):
    """A third of all rows lies in one crowded corner, some exactly on top of each other."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        if rng.random() < crowd:
            rows.append((i, "a/mic_0.mrc", 10 + rng.randrange(8) / 4, 10 + rng.randrange(8) / 4))
        else:
            rows.append((i, f"b/mic_{rng.randrange(mics)}.mrc", rng.randrange(int(spread * 4)) / 4, rng.randrange(int(spread * 4)) / 4))
    return rows, spark.createDataFrame(rows, "id bigint, micrograph string, x double, y double")


def near(a, b, margin):
    return a[1].split("/")[-1] == b[1].split("/")[-1] and abs(a[2] - b[2]) <= margin and abs(a[3] - b[3]) <= margin


@pytest.mark.parametrize("margin", [0.5, 1.0, 3.0, 7.25])
def test_near_any_equals_brute_force(spark, margin):
    left, a = points(spark, 150, 1)
    right, b = points(spark, 120, 2, crowd=0.1)
    want = {p[0] for p in left if any(near(p, q, margin) for q in right)}
    got = {r["id"] for r in M.near_any(a, b, margin).collect()}
    rest = {r["id"] for r in M.near_any(a, b, margin, keep=False).collect()}
    assert got == want and rest == {p[0] for p in left} - want


def test_nearest_sorts_no_pairs_and_searches_equal_places_once(spark):
    """Many rows on a few places: the plan holds no sorted aggregate, and each row gets the hit of its place."""
    a = spark.range(2000).selectExpr("id", "'m' micrograph", "cast(id % 20 as double) x", "0.0D y")
    b = spark.range(500).selectExpr("id", "'m' micrograph", "cast(id % 25 as double) + 0.25 x", "0.0D y")
    hits = M.nearest_in_box(a, b, "id", "id", 3.0)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
    assert {(r["id"], r["id_2"], r["distance"]) for r in hits.collect()} == {(i, i % 20, 0.25) for i in range(2000)}


def test_complement_goes_by_row_and_not_by_place(spark, monkeypatch):
    """A good and a bad row on one place: the bad one stays in the complement, one without confidence does not."""
    from orientlake.plans import fixtures as fx, joins
    rows = spark.createDataFrame([(1, "m", 1.0, 1.0, 0.5, 0.1), (2, "m", 1.0, 1.0, 0.1, 0.2), (3, "m", 2.0, 2.0, None, 0.3)],
                                 "pid bigint, micrograph string, x double, y double, fom double, score double")
    monkeypatch.setattr(fx, "particles", lambda spark, sf: rows)
    assert {r["pid"] for r in joins.complement(spark, "").collect()} == {2}


@pytest.mark.parametrize("crowded", [4096, 3])
@pytest.mark.parametrize("metric", ["euclid", "box"])
def test_nearest_equals_brute_force(spark, monkeypatch, crowded, metric):
    monkeypatch.setattr(M, "CROWDED_CELL", crowded)
    left, a = points(spark, 120, 3)
    right, b = points(spark, 150, 4)
    def dist(p, q):
        dx, dy = abs(p[2] - q[2]), abs(p[3] - q[3])
        return max(dx, dy) if metric == "box" else (dx * dx + dy * dy) ** .5
    want = {}
    for p in left:
        hits = sorted((dist(p, q), q[0]) for q in right if near(p, q, 5.0))
        if hits:
            want[p[0]] = hits[0]
    got = {r["id"]: (r["distance"], r["id_2"]) for r in M.nearest_in_box(a, b, "id", "id", 5.0, metric).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k][0] - want[k][0]) < 1e-12 and got[k][1] == want[k][1] for k in want)


def test_number_rows_with_hot_row(spark):
    rows = [(7, "x")] * 9000 + [(i % 50, "y") for i in range(3000)]
    out = O.number_rows(spark.createDataFrame(rows, "k int, s string"), ["k", "s"], "n").orderBy("n").collect()
    assert [r["n"] for r in out] == list(range(1, len(rows) + 1))
    assert [(r["k"], r["s"]) for r in out] == sorted(rows)


def test_quantiles_with_hot_group_and_value(spark):
    rng = np.random.default_rng(0)
    rows = [(0, float(v)) for v in rng.normal(size=700)] + [(0, 0.25)] * 900 + [(1, float(v)) for v in rng.integers(0, 9, 55)] + [(2, 3.0)]
    df = spark.createDataFrame(rows, "g int, v double")
    probs = {"a": 0.0, "b": 0.013, "c": 0.5, "d": 0.95, "e": 1.0}
    for r in O.grouped_quantiles(df, "v", probs, ["g"]).collect():
        mine = [v for g, v in rows if g == r["g"]]
        assert np.allclose([r[k] for k in probs], np.quantile(mine, list(probs.values())), atol=1e-12)


def test_average_ranks(spark):
    v = [3.0, 1.0, 3.0, 2.0, 3.0, 1.0, 8.0]
    got = {r["v"]: r["rank"] for r in O.average_ranks(spark.createDataFrame([(x,) for x in v], "v double"), "v").collect()}
    assert got == {1.0: 1.5, 2.0: 3.0, 3.0: 5.0, 8.0: 7.0}


def test_seeded_rank_is_a_permutation(spark):
    df = spark.range(1, 501).withColumnRenamed("id", "pid")
    got = sorted((r["k"], r["pid"]) for r in O.seeded_rank(df, "pid", "k").collect())
    want = sorted(range(1, 501), key=lambda p: (p * 2654435761 % 2**32, p))
    assert [p for _, p in got] == want and [k for k, _ in got] == list(range(1, 501))


def test_split_sizes(spark):
    out = S.split(spark.range(1, 24).withColumnRenamed("id", "pid"), "pid", 5).groupBy("chunk").count().orderBy("chunk").collect()
    assert [r["count"] for r in out] == [5, 5, 5, 4, 4]
    few = S.split(spark.range(1, 4).withColumnRenamed("id", "pid"), "pid", 5)
    assert sorted(r["chunk"] for r in few.collect()) == [1, 2, 3]


def test_regroup_with_one_large_group(spark):
    sizes = {(1, "a"): 3, (1, "b"): 40, (2, "a"): 2, (2, "c"): 2, (3, "a"): 5, (3, "d"): 1}
    rows, pid = [], 0
    for (o, m), n in sizes.items():
        for _ in range(n):
            pid += 1
            rows.append((pid, o, m))
    random.Random(1).shuffle(rows)
    got = S.regroup_stacks(spark.createDataFrame(rows, "pid bigint, optics_group bigint, micrograph string"), 7).collect()
    want, stack, fill = {}, 1, 0
    for key in sorted(sizes):
        if fill and fill + sizes[key] > 7:
            stack, fill = stack + 1, 0
        for p in sorted(r[0] for r in rows if (r[1], r[2]) == key):
            fill += 1
            want[p] = (stack, fill)
    assert {r["pid"]: (r["new_stack"], r["new_index"]) for r in got} == want


def test_strict_name_match_needs_equal_sets(spark):
    a = spark.createDataFrame([("1@s.mrcs",), ("2@s.mrcs",)], "image_name string")
    b = spark.createDataFrame([("000001@x/s.mrcs",)], "image_name string")
    assert M.match_by_name(a, b).count() == 1
    with pytest.raises(M.NoMatch):
        M.match_by_name(a, b, allow_partial=False)


def test_repeated_id_is_an_error(spark):
    a = spark.createDataFrame([("1@s.mrcs", 1)], "image_name string, v int")
    with pytest.raises(Exception, match="stands twice"):
        M.match_by_name(a, a.union(a)).collect()
    assert M.match_by_name(a.union(a), a).count() == 2


def test_repeated_place_is_an_error(spark):
    a = spark.createDataFrame([(1, "m", 1.0, 1.0), (2, "m", 1.1, 1.0)], "id bigint, micrograph string, x double, y double")
    with pytest.raises(Exception, match="twice"):
        M.shared_places([a, a.where("id = 1")], "id", 0.5).collect()


def test_merge_truth_by_row_order(spark):
    a = spark.createDataFrame([(i, float(i), 0.0, 0.0) for i in range(1, 30)], "row_no bigint, rot double, tilt double, psi double")
    b = a.withColumn("rot", F.col("rot") + 1)
    got = M.merge_truth(b, a, "image_name", "row_no").collect()
    assert len(got) == 29 and all(r["rot_gt"] == r["rot"] + 1 for r in got)


def test_upsert_refuses_repeated_ids(spark):
    base = spark.createDataFrame([(1, 1.0)], "id bigint, v double")
    with pytest.raises(ValueError):
        M.upsert(base, base.union(base), "id", ["v"])


def test_optics_conflict_is_an_error(spark):
    a = spark.createDataFrame([(1, 1.0)], "optics_group bigint, px double")
    with pytest.raises(Exception, match="two definitions"):
        S.join_optics([a, a.withColumn("px", F.lit(2.0))]).collect()
    with pytest.raises(ValueError):
        S.prune_optics(a, spark.createDataFrame([(2,)], "optics_group bigint"))


def test_nan_never_passes(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 3.0), (3, None), (4, 1.0)], "id int, z double")
    assert [r["id"] for r in filters.score_filter(df, "z", 1.0).collect()] == [2]
    assert nan_to_null(df).where("z is null").count() == 2
    assert filters.select_subset(df, "z", "gt", "0.5").count() == 2
    with pytest.raises(Exception, match="1 or 2"):
        filters.half_filter(spark.createDataFrame([(3,)], "half bigint"), 1).collect()


def test_bool_subset(spark):
    df = spark.createDataFrame([(1, True), (2, False)], "id int, ok boolean")
    assert [r["id"] for r in filters.select_subset(df, "ok", "eq", "True").collect()] == [1]


def test_roles_and_missing_columns(spark):
    df = spark.createDataFrame([("m", 1.0, 2.0)], "rlnMicrographName string, rlnCoordinateX double, rlnCoordinateY double")
    assert ColumnRoles.of(df).place() == ("rlnMicrographName", "rlnCoordinateX", "rlnCoordinateY")
    with pytest.raises(MissingColumns):
        ColumnRoles.of(df.drop("rlnCoordinateX")).place()
    with pytest.raises(MissingColumns):
        require_columns(df, ["a"], "table")


def test_near_duplicate_rotations(spark):
    rng = np.random.default_rng(5)
    base = np.stack([rng.uniform(0, 360, 60), rng.uniform(0, 180, 60), rng.uniform(0, 360, 60)], axis=1)
    angles = np.concatenate([base, base + rng.uniform(-.06, .06, base.shape), base[:5], [[10, 0, 20], [15, 0, 15.02], [40, 0.01, 350]]])
    rows = [(i, *map(float, a)) for i, a in enumerate(angles)]
    m = G.zyz_matrices(*angles.T).reshape(-1, 9)
    close = m @ m.T >= 1 + 2 * np.cos(np.radians(0.1)) - 1e-12
    want = {i for i in range(len(rows)) if not close[i, :i].any()}
    got = {r["id"] for r in K.drop_near_duplicates(spark.createDataFrame(rows, "id bigint, rot double, tilt double, psi double"), "id").collect()}
    assert got == want


def test_symmetry_error_of_a_copy_is_zero(spark):
    from orientlake.functions.symmetry import group_matrices
    for name in ("C3", "D2", "T"):
        s = group_matrices(name)[-1]
        df = R.with_matrix(spark.createDataFrame([(33.0, 71.0, 12.0)], "rot double, tilt double, psi double"), "rot", "tilt", "psi", "a")
        df = df.withColumns(dict(zip(R.entries("b"), R.constant_times(s, R.matrix_of("a")))))
        assert R.with_sym_error(df, "a", "b", name).first()["err"] < 1e-5


def test_rank_measures_of_one_class(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 1)], "s double, y int")
    assert stats.roc_auc(df, "s", "y").first()[0] is None and stats.pr_auc(df, "s", "y").first()[0] is None
    assert stats.log_loss(df.withColumn("s", F.lit(.5)), "s", "y").first()[0] is None
    assert stats.spearman(df, "s", "y").first()["spearman"] is None


def test_star_with_quotes_and_long_files(spark, tmp_path):
    text = ["# made by hand", "", "data_optics", "", "loop_", "_group #1", "_px #2", "1 1.5", "", "data_general", "_version 3", "_note 'two words'", "",
            "data_particles", "loop_", "_name #1", "_group #2", "_score"]
    text += [f"'im {i}' 1 {i / 2}" if i % 3 else f"im{i} 1 nan" for i in range(500)]
    (tmp_path / "a.star").write_text("\n".join(text) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    try:
        p, o = star.read_star(spark, str(tmp_path / "a.star"))
        rows = p.orderBy("file_order").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r["name"] for r in rows] == [f"im {i}" if i % 3 else f"im{i}" for i in range(500)]
    assert [r["score"] for r in rows] == [i / 2 if i % 3 else None for i in range(500)]
    assert p.schema["score"].dataType.typeName() == "double" and o.first().asDict() == {"group": 1, "px": 1.5}


def test_stack_ranges_and_types(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(mrc, "RANGE_BYTES", 3 * 4 * 6 * 2)
    data = np.arange(10 * 4 * 6, dtype="<i2").reshape(10, 4, 6)
    head = bytearray(mrc.make_header(6, 4, 10, 2.0))
    head[12:16] = (1).to_bytes(4, "little")
    head[92:96] = (16).to_bytes(4, "little")
    (tmp_path / "s.mrcs").write_bytes(bytes(head) + b"x" * 16 + data.tobytes())
    rows = mrc.scan_images(spark, str(tmp_path / "*.mrcs")).orderBy("index").collect()
    assert [r["index"] for r in rows] == list(range(1, 11)) and (rows[0]["ny"], rows[0]["nx"]) == (4, 6)
    assert np.array_equal(np.array([r["pixels"] for r in rows]).reshape(10, 4, 6), data)
    with pytest.raises(Exception, match="voxel size"):
        mrc.scan_volumes(spark, str(tmp_path / "*.mrcs"), 3.0).collect()


def test_stream_survives_a_restart(spark, tmp_path):
    from orientlake.streaming import ingest as I
    src, sink, state = (str(tmp_path / n) for n in ("src", "sink", "state"))
    df = spark.range(100).withColumn("v", F.col("id") * 1.0)
    for part in (df.where("id < 50"), df.where("id >= 50")):
        part.coalesce(2).write.mode("append").parquet(src)
        I.run_to_end(I.start(I.file_stream(spark, src, df.schema, 1), I.numbered_sink(sink), state))
    got = I.read_sink(spark, sink, df.schema)
    assert got.count() == 100 and got.select("id").distinct().count() == 100


def test_rewrite_stacks(spark, tmp_path):
    rng = np.random.default_rng(9)
    data = {(s, i): rng.standard_normal(16).astype("f4") for s in ("a", "b") for i in range(1, 6)}
    rows = [(s, i, 4, 4, [float(v) for v in p]) for (s, i), p in data.items()]
    images = spark.createDataFrame(rows, "stack string, index bigint, nx int, ny int, pixels array<float>")
    plan = spark.createDataFrame([(s, i, 1 + (i > 3), (i if i <= 3 else i - 3) + (3 if i <= 3 else 2) * (s == "b")) for s, i in data],
                                 "stack string, index bigint, new_stack bigint, new_index bigint")
    written = mrc.rewrite_stacks(images, plan, str(tmp_path), 1.5).collect()
    assert sorted(r["n"] for r in written) == [4, 6]
    back = {(r["path"].rsplit("_", 1)[1], r["index"]): r["pixels"] for r in mrc.scan_images(spark, str(tmp_path / "*.mrcs")).collect()}
    for r in plan.collect():
        assert np.array_equal(np.array(back[(f"{r['new_stack']:06d}.mrcs", r["new_index"])], dtype="f4"), data[(r["stack"], r["index"])])


def test_sql_functions(spark):
    from orientlake.functions.sqlfunctions import register
    register(spark)
    assert spark.sql("select count(*) from local_grid(4.0D, 2.0D)").first()[0] == 125
    assert spark.sql("select count(*) from symmetry_ops('O')").first()[0] == 24
    r = spark.sql("select rot_error(rot_matrix(10D, 20D, 30D), rot_matrix(10D, 20D, 42D)) as e").first()["e"]
    assert abs(r - 12) < 1e-6
    q = spark.sql("select project_rotation(sum(r[0]), sum(r[1]), sum(r[2]), sum(r[3]), sum(r[4]), sum(r[5]), sum(r[6]), sum(r[7]), sum(r[8])) as q "
                  "from (select rot_matrix(10D, 20D, cast(id as double)) as r from range(0, 11))").first()["q"]
    assert np.allclose(list(q), G.zyz_matrices(10.0, 20.0, 5.0).ravel(), atol=1e-9)


def test_scores_from_a_user_model(spark):
    from orientlake.extend import score_images
    import pyarrow as pa
    df = spark.createDataFrame([(i, [float(i)] * 4) for i in range(6)], "id bigint, pixels array<double>")

    def model(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([float("nan") if p[0] == 5 else p[0] for p in b.column(1).to_pylist()])], names=["id", "s"])
    assert {r["id"] for r in score_images(df, model, "id bigint, s double", "s", 2.0).collect()} == {3, 4}


def test_star_keeps_every_text(spark, tmp_path):
    texts = ["plain", "_under", "_under two", "#hash", "data_x", "loop_", "it's", "a 'b' c", 'say "hi" x', "", " lead", None, "<NA>", "nan x", "'", '"', "'x'", "_a #1"]
    df = spark.createDataFrame([(i, t, 0.5 if t else None) for i, t in enumerate(texts)], "pid bigint, name string, score double").select("name", "pid", "score")
    optics = spark.createDataFrame([(1, "my group", 300.0), (2, "_odd", None), (3, None, 1.5)], "optics_group bigint, label string, kv double")
    path = str(tmp_path / "s")
    star.write_star(df.repartition(3), optics, path)
    p, o = star.read_star(spark, path, ["pid"])
    assert {r["pid"]: (r["name"], r["score"]) for r in p.collect()} == {i: (t, 0.5 if t else None) for i, t in enumerate(texts)}
    assert {tuple(r) for r in o.collect()} == {tuple(r) for r in optics.collect()}
    for bad in ("two\nlines", "both ' and \" end"):
        with pytest.raises(Exception, match="fits no STAR line"):
            star.write_star(df.limit(1).withColumn("name", F.lit(bad)), None, str(tmp_path / f"bad{len(bad)}"))


def test_star_rows_with_leading_underscore_of_other_writers(spark, tmp_path):
    (tmp_path / "o.star").write_text("data_particles\nloop_\n_name #1\n_n #2\n_x 1\ny 2\n_z 3\n\ndata_general\n_version 3\n_note it's\n")
    p, _ = star.read_star(spark, str(tmp_path / "o.star"))
    assert [(r["name"], r["n"]) for r in p.orderBy("file_order").collect()] == [("_x", 1), ("y", 2), ("_z", 3)]


def test_metrics_with_other_column_order(spark, tmp_path):
    from orientlake.sources.metrics import read_metrics

    (tmp_path / "a.csv").write_text("step,epoch,loss\n1,2,0.5\n")
    (tmp_path / "b.csv").write_text("epoch,step,other\n4,3,x\n")
    got = {tuple(r) for r in read_metrics(spark, str(tmp_path)).select("step", "epoch", "loss").collect()}
    assert got == {(1, 2, 0.5), (3, 4, None)}


def test_seeded_order_of_large_keys(spark):
    keys = [0, 1, 5, 65535, 65536, 3_470_000_000, 4_000_000_000, 10 ** 13, 2 ** 62]
    got = spark.createDataFrame([(k,) for k in keys], "k bigint").select("k", seeded_order("k").alias("h")).collect()
    assert {r["k"]: r["h"] for r in got} == {k: k * 2654435761 % 2 ** 32 for k in keys}


def test_near_any_with_a_crowded_cell(spark):
    """A cell full of distinct places is sorted once; its corners still decide exactly."""
    rng = random.Random(21)
    right = [(i, "m", 20 + rng.random() * 10, 20 + rng.random() * 10) for i in range(20000)]
    left = [(i, "m", 10 + rng.random() * 30, 10 + rng.random() * 30) for i in range(3000)]
    a, b = (spark.createDataFrame(rows, "id int, micrograph string, x double, y double") for rows in (left, right))
    points = np.array([r[2:] for r in right])
    for margin in (10.0, 4.0):
        want = {r[0] for r in left if (np.abs(points - np.array(r[2:])).max(axis=1) <= margin).any()}
        assert {r["id"] for r in M.near_any(a, b, margin).collect()} == want
    assert M._deciding_points(b.selectExpr("micrograph as mic", "x as px", "y as py"), 10.0).count() < 400
