"""Texts of the mix are moved once to meet their copies."""

import re

from orientlake.llm import mixing


def test_rows_without_a_repeated_key_are_moved_once(spark, monkeypatch):
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(200)] + [(None, "none")], "file bigint, value string")
    mixed = spark.createDataFrame([(i, i % 3) for i in range(200)] + [(None, 2)], "file bigint, copies int")
    plans, cut = [], mixing.cut
    monkeypatch.setattr(mixing, "cut", lambda df, label: (plans.append(df._jdf.queryExecution().executedPlan().toString()), cut(df, label))[1])
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        back = mixing.repeat_rows(rows, mixed, "file")
        plans.append(back._jdf.queryExecution().executedPlan().toString())
        assert sum(len(re.findall(r"hashpartitioning\(coalesce\(row#", plan)) for plan in plans) == 1
        assert sorted((r["file"] is None, r["file"] or 0) for r in back.collect()) == sorted(
            [(False, i) for i in range(200) for _ in range(i % 3)] + [(True, 0)] * 2)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_few_repeated_keys_move_only_their_rows(spark, monkeypatch):
    """Rows of a repeated key are found by a filter; all others meet their copies by one join."""
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(200)] + [(7, "more"), (None, "a"), (None, "b")], "file bigint, value string").repartition(3, "value")
    mixed = spark.createDataFrame([(i, 1) for i in range(200)] + [(7, 2), (None, 3), (500, 1)], "file int, copies int")
    laid, cut = [], mixing.cut
    monkeypatch.setattr(mixing, "cut", lambda df, label: (laid.append(df.select("key").collect()) if label == "repeated" else None, cut(df, label))[1])
    back = mixing.repeat_rows(rows, mixed, "file")
    assert sorted(map(str, (r["key"] for r in laid[0]))) == ["7", "7", "None", "None"]
    got = [(r["file"], r["value"]) for r in back.collect()]
    assert len(got) == 199 + 3 + 3 and sum(f == 7 for f, _ in got) == 3 and sum(f is None for f, _ in got) == 3
    assert all(got.count((i, f"text {i}")) == 1 for i in range(200) if i != 7)
