"""Named queues, running sums across restarts, and small file formats."""

import pytest
from pyspark.sql import functions as F

from orientlake.operators import match as M
from orientlake.session import batches_in, new_dir
from orientlake.sources import metrics, star
from orientlake.streaming import ingest as I


def test_a_failed_queue_leaves_the_others_running(spark):
    root, sink, state = new_dir(spark, "queues"), new_dir(spark, "sink"), new_dir(spark, "state")
    schema = "id bigint, value double"
    for name in ("a", "b", "c"):
        for i in range(3):
            spark.createDataFrame([(10 * i + k, float(k)) for k in range(4)], schema).coalesce(1).write.mode("append").parquet(f"{root}/{name}")

    def streams():
        return {name: I.file_stream(spark, f"{root}/{name}", spark.read.parquet(f"{root}/{name}").schema, 1) for name in ("a", "b", "c")}

    broken = {"b"}

    def handle(name):
        write = I.numbered_sink(f"{sink}/queue={name}")

        def run(batch, number):
            if name in broken and number == 1:
                raise ValueError("bad queue")
            write(batch, number)
        return run

    ended = I.finish_queues(I.start_queues(streams(), handle, state))
    assert ended["a"] is None and ended["c"] is None and "bad queue" in ended["b"]
    counts = {r["queue"]: r["count"] for r in spark.read.parquet(sink).groupBy("queue").count().collect()}
    assert counts == {"a": 12, "b": 4, "c": 12}
    broken.clear()  # started again it goes on where it failed
    assert I.finish_queues(I.start_queues({"b": streams()["b"]}, handle, state)) == {"b": None}
    assert spark.read.parquet(f"{sink}/queue=b").count() == 12 and batches_in(f"{sink}/queue=b") == [0, 1, 2]


def test_running_sums_survive_restarts_and_repeated_batches(spark):
    root = new_dir(spark, "running")
    handle = I.running_accumulators(root, compact=3)

    def batch(i):
        rows = [(1, 0, 0, k, float(i), 1.0, 1.0, 0.5) for k in range(3)] * 2
        return spark.createDataFrame(rows, "half bigint, z int, y int, x int, re double, im double, w double, ctfsq double")

    for i in range(8):
        for _ in range(1 + i % 2):  # every other batch is repeated
            handle(batch(i), i)
        assert len(batches_in(f"{root}/base")) <= 1 and len(batches_in(f"{root}/delta")) <= 3
    again = I.running_accumulators(root, compact=3)
    again(batch(7), 7)
    got = {r["x"]: (r["re"], r["w"]) for r in I.accumulator_state(spark, root).collect()}
    assert got == {k: (2.0 * sum(range(8)), 16.0) for k in range(3)}


def test_star_table_without_rows_reads_back(spark):
    path = new_dir(spark, "star")
    rows = spark.createDataFrame([], "pid bigint, optics_group bigint, name string")
    star.write_star(rows, spark.createDataFrame([(1, 1.5)], "optics_group bigint, px double"), path)
    text = "\n".join(r[0] for r in spark.read.text(path).collect())
    assert "data_particles" in text and "_name #3" in text
    particles, optics = star.read_star(spark, path, ["pid", "optics_group"])
    assert particles.count() == 0 and {"pid", "optics_group", "name"} <= set(particles.columns) and optics.count() == 0  # no group is in use


def test_nothing_left_over_is_an_error(spark):
    rows = [(i, "m", float(i), float(i)) for i in range(5)]
    df = spark.createDataFrame(rows, "id int, micrograph string, x double, y double")
    with pytest.raises(M.NoMatch):
        M.set_difference(df, df, "id")
    with pytest.raises(M.NoMatch):
        M.set_difference(df, df.withColumn("x", F.col("x") + 0.5), "id")
    assert {r["id"]: r["is_good"] for r in M.set_difference(df, df.where("id < 3"), "id").collect()} == {i: i < 3 for i in range(5)}


def test_logs_with_parts_missing_and_run_times(spark):
    root = new_dir(spark, "logs")
    texts = {"r1": "Found 12 matching particles.\n\nAnalyzing angular differences with C1 symmetry:\nMean: 1.50°\nStandard Deviation: 2°\nMedian: 0.75°\n\n"
                   "Percentages:\n< 5°: 90.5%\n< 10°: 99%\n\nShift errors (Å):\nMean: 0.25\nStandard Deviation: 1\nMedian: 0.125\n\nRun time: 90 s\n",
             "r2": "Run time: 2 h\nMean: 7\nnothing else\n", "r3": ""}
    for run, text in texts.items():
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{root}/{run}")
    got = {r["run"]: r for r in metrics.read_run_logs(spark, f"{root}/*/*.txt").collect()}
    names = ("n", "mean_deg", "median_deg", "pct5", "pct10", "shift_mean", "shift_median", "minutes")
    assert tuple(got["r1"][c] for c in names) == (12, 1.5, .75, 90.5, 99.0, .25, .125, 1.5)
    assert tuple(got["r2"][c] for c in names) == (None,) * 7 + (120.0,)
    assert "r3" not in got or all(got["r3"][c] is None for c in names)


def test_stacks_stay_whole_when_the_join_of_their_sizes_may_become_a_broadcast(spark):
    from orientlake.sources import mrc
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {n: spark.conf.get(n, None) for n in names}
    try:
        spark.conf.set(names[0], "-1")
        spark.conf.set(names[1], "10MB")
        folder = new_dir(spark, "whole")
        images = spark.range(0, 2000, 1, 4).selectExpr(
            "concat('s', id % 40, '.mrcs') as stack", "id div 40 as index", "2 as nx", "2 as ny", "array_repeat(cast(id as float), 4) as pixels")
        done = {r["path"].rsplit("/", 1)[1]: r["n"] for r in mrc.write_stacks(images, folder).collect()}
        assert done == {f"s{i}.mrcs": 50 for i in range(40)}
        rows = mrc.scan_images(spark, f"{folder}/*.mrcs").selectExpr("pixels[0] as v").collect()
        assert sorted(r["v"] for r in rows) == [float(i) for i in range(2000)]
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)
