"""STAR files are read without moving or sorting their lines."""

from pyspark.sql import functions as F

from orientlake.sources import star


def test_lines_stay_where_they_are(spark, tmp_path):
    optics = spark.createDataFrame([(1, 1.5), (2, 2.5)], "optics_group bigint, px double")
    star.write_star(spark.range(100).select(F.col("id").alias("pid"), (F.col("id") % 2 + 1).alias("optics_group")), optics, str(tmp_path / "s"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = star.read_blocks(spark, str(tmp_path / "s"))
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
        assert rows.where("block = 'particles' and tokens is not null").count() == 100
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_optics_are_a_table_of_their_own(spark, tmp_path):
    optics = spark.createDataFrame([(1, 1.5), (2, 2.5)], "optics_group bigint, px double")
    star.write_star(spark.range(100).select(F.col("id").alias("pid"), (F.col("id") % 2 + 1).alias("optics_group")), optics, str(tmp_path / "s"))
    _, read = star.read_star(spark, str(tmp_path / "s"))
    assert "Aggregate" not in read._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in read.collect()} == {(1, 1.5), (2, 2.5)}


def test_any_blanks_and_numbers(spark, tmp_path):
    (tmp_path / "a.star").write_text("data_particles\nloop_\n_a #1\n_b #2\n_c #3\n_d #4\n1 2.5 x 1\n2\t-3  <NA>   1234567890123456789012\n  3 1e3\ty 2 \n4 nan z <NA>\n")
    p, _ = star.read_star(spark, str(tmp_path / "a.star"))
    assert p.drop("file", "file_order").dtypes == [("a", "bigint"), ("b", "double"), ("c", "string"), ("d", "string")]
    assert {tuple(r) for r in p.drop("file", "file_order").collect()} == {
        (1, 2.5, "x", "1"), (2, -3.0, None, "1234567890123456789012"), (3, 1000.0, "y", "2"), (4, None, "z", None)}


def test_times_are_quoted(spark, tmp_path):
    df = spark.sql("select 1 as pid, timestamp'2020-01-02 03:04:05' as t, date'2020-01-02' as d, 1.50 as m, true as b, cast(null as int) as n")
    star.write_star(df, None, str(tmp_path / "s"))
    p, _ = star.read_star(spark, str(tmp_path / "s"))
    assert tuple(p.drop("file", "file_order").first()) == (1, "2020-01-02 03:04:05", "2020-01-02", 1.5, "true", None)
