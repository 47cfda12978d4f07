"""Row numbers of tables that are read from files."""

from pyspark.sql import functions as F

from orientlake.operators import ordered as O
from orientlake.plans import fixtures as fx


def test_scanned_rows_are_numbered_in_order_with_a_hot_row(spark, tmp_path):
    rows = [(7, "hot", i % 2) for i in range(3000)] + [(i % 50, str(i % 3), i % 2) for i in range(1000)] + [(None, "n", 1), (3, None, 0)]
    spark.createDataFrame(rows, "k int, s string, extra int").repartition(5).write.parquet(f"{tmp_path}/t")
    table = spark.read.parquet(f"{tmp_path}/t").select("k", "s", "extra")
    got = O.number_rows(table, ["k", "s", "extra"], "n", ["s", "k"], scanned=True)
    assert got.columns == ["n", "s", "k"]
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "", r[2]))
    assert [(r["n"], r["k"], r["s"]) for r in got.orderBy("n").collect()] == [(i + 1, k, s) for i, (k, s, _) in enumerate(want)]
    assert O.number_rows(table.where("k > 1000"), ["k", "s", "extra"], "n", scanned=True).count() == 0


def test_scanned_rows_are_not_gathered_before_their_shuffle(spark, monkeypatch):
    plans = []
    cut = O.cut
    monkeypatch.setattr(O, "cut", lambda df, label: (plans.append(df._jdf.queryExecution().executedPlan().toString()), cut(df, label))[1])
    fx._particles(spark, "/root/testdata/sf0.001").agg(F.count(F.lit(1))).collect()
    assert "Aggregate" not in plans[0] and "l_shipdate" not in plans[0].splitlines()[1]


def test_pairs_are_dealt_into_more_parts_than_the_session_shuffles(spark, monkeypatch):
    asked = []
    match = fx.match_by_name
    monkeypatch.setattr(fx, "match_by_name", lambda a, b, **more: (asked.append(more.get("parts")), match(a, b, **more))[1])
    pairs = fx._pairs(spark, "/root/testdata/sf0.001")
    assert asked[0] >= fx.PARTS_PER_SPLIT > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert "hashpartitioning(particle_id" in pairs._jdf.queryExecution().executedPlan().toString()
