"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, operator by operator."""

import math

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from orientlake.llm import decontaminate, language, lattice_lm, mixing, ngram_join, surrogates, tokens, toxicity, url_filter, vector_forest
from orientlake.session import new_dir

LONG = " ".join(f"run{i} of many" for i in range(20000))
LOGS = [(1, "one two three four five six", "a"), (1, "one two three four five six", "a"), (2, None, None), (3, "", "b"), (4, " \t\n ", "b"),
        (5, LONG, "c"), (6, LONG + " end", "c"), (None, "one two three four five six", None), (7, "too short", "a"), (8, "too short", "a")]
# names that the operators use inside
CLASH = ["_key", "n", "rep", "component", "score", "size", "rate", "gram", "chunk", "rule", "row", "text2", "_bloom", "_gone", "_k", "_copies", "_n", "_i", "_t",
         "bloom", "gone", "special", "dropped", "times", "key", "copies", "rows", "hash", "tie", "place", "_text", "k", "c", "c0", "copy"]


def logs(spark, rows=LOGS):
    df = spark.createDataFrame(rows, "file bigint, value string, optics_group string")
    return df.withColumns({c: F.lit(f"{c}?") for c in CLASH})


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def pieces():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def test_similar_texts(spark):
    got = sorted(map(tuple, ngram_join.similar_texts(logs(spark)).collect()), key=str)
    want = [(1, 2, 1), (1, 2, 1), (2, 0, 2), (3, 0, 3), (4, 0, 4), (5, 59996, 5), (6, 59997, 5), (None, 2, None), (7, 1, 7), (8, 1, 7)]
    assert got == sorted(want, key=str)
    assert ngram_join.similar_texts(logs(spark, [])).collect() == []
    kept = ngram_join.one_per_group(logs(spark))
    assert kept.columns == logs(spark).columns
    assert sorted((r["file"] for r in kept.collect()), key=str) == sorted([1, 2, 3, 4, 5, None, 7], key=str)
    assert ngram_join.one_per_group(logs(spark, [])).collect() == []


def test_mix_sources(spark):
    sized = logs(spark).withColumn("n_particles", mixing.word_count("value")).withColumnRenamed("file", "micrograph")
    got = mixing.mix_sources(sized).collect()
    assert len(got) == len(LOGS) and all(0 <= r["copies"] <= 3 for r in got)
    assert {r["optics_group"] for r in got} == {"a", "b", "c", None}
    assert all(r["copies"] == 1 for r in got if r["n_particles"] == 0)
    assert mixing.mix_sources(sized.limit(0)).collect() == []
    assert len(mixing.mix_sources(sized.where("n_particles = 0")).collect()) == 3
    back = mixing.repeat_rows(logs(spark), mixing.mix_sources(sized).withColumnRenamed("micrograph", "file"), "file")
    assert back.columns == logs(spark).columns
    assert back.count() == sum(r["copies"] for r in got)


def test_rows_of_one_key_share_its_copies(spark):
    rows = [(None if i % 3 == 0 else i % 7 if i % 3 == 1 else 1000 + i, f"text {i % 11}", "s") for i in range(900)]  # a third of all rows have no key
    df = logs(spark, rows).repartition(5)
    mixed = mixing.mix_sources(df.withColumn("n_particles", mixing.word_count("value") + F.coalesce("file", F.lit(3)) % 5), "file", "optics_group", "n_particles")
    back = mixing.repeat_rows(df, mixed, "file")
    want = {r["file"]: r["n"] for r in mixed.groupBy("file").agg(F.sum("copies").alias("n")).collect()}
    got = {r["file"]: r["n"] for r in back.groupBy("file").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {k: n for k, n in want.items() if n} and back.columns == df.columns
    held = {k: sum(f == k for f, _, _ in rows) for k in want}
    per_row = back.groupBy("file", "value").agg(F.count(F.lit(1)).alias("n")).collect()
    for r in per_row:  # dealt evenly
        same = sum(f == r["file"] and v == r["value"] for f, v, _ in rows)
        assert same * (want[r["file"]] // held[r["file"]]) <= r["n"] <= same * -(-want[r["file"]] // held[r["file"]])
    again = mixing.repeat_rows(df.repartition(3, "value"), mixed, "file")
    assert sorted(map(str, again.collect())) == sorted(map(str, back.collect()))


def test_tokens(spark, tokenizer):
    folder = new_dir(spark, "test-tokens")
    tokens.write_tokens(logs(spark).withColumnRenamed("file", "pid"), folder, tokenizer)
    got = sorted(tokens.read_tokens(spark, folder).collect(), key=lambda r: r["start"])
    assert [r["pid"] for r in got] == [None, 1, 1, 2, 3, 4, 5, 6, 7, 8]
    assert [r["n_tokens"] for r in got if r["pid"] in (2, 3, 4)] == [1, 1, 1]
    assert [r["start"] for r in got] == [sum(x["n_tokens"] for x in got[:i]) for i in range(len(got))]
    empty = new_dir(spark, "test-tokens")
    assert tokens.write_tokens(logs(spark, []).withColumnRenamed("file", "pid"), empty, tokenizer).collect() == []
    assert tokens.read_tokens(spark, empty).collect() == []


def test_urls(spark):
    pages = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (2, "", "x"), (3, "no host", "x"), (None, "https://A.Example.NET/en/x?y", "x"), (4, "ftp://net", "x"),
                                   (5, "x://b.org/fr/" + "a/" * 5000, "x"), (6, "x://a.net/?q", "x")], "page_id bigint, url string, rule string").withColumn("key", F.lit(1))
    rules = [("block", "net/"), ("allow", "example.net/en/"), ("allow", "org/fr/")]
    got = {(r["page_id"], r["host"]): (r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, rules).collect()}
    assert got == {(1, ""): (None, "allow"), (2, ""): (None, "allow"), (3, ""): (None, "allow"), (None, "a.example.net"): ("example.net/en/", "allow"),
                   (4, "net"): (None, "allow"), (5, "b.org"): ("org/fr/", "allow"), (6, "a.net"): ("net/", "block")}
    assert url_filter.judge_urls(pages.limit(0), rules).collect() == []
    assert {r["verdict"] for r in url_filter.judge_urls(pages, []).collect()} == {"allow"}


def test_lattice(spark, pieces):
    got = lattice_lm.score_texts(logs(spark), pieces).collect()
    assert len(got) == len(LOGS) and all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert {r["n_tokens"] for r in got if r["file"] in (2, 3, 4)} == {1}
    assert len({r["score"] for r in got if r["file"] == 1}) == 1
    assert lattice_lm.score_texts(logs(spark, []), pieces).collect() == []


def test_toxicity(spark):
    marks = spark.createDataFrame([(1, 1), (1, 1), (5, 0), (None, 1), (7, None), (99, 1)], "doc_id bigint, toxic int").withColumn("text", F.lit("x"))
    docs = logs(spark).withColumnsRenamed({"file": "doc_id", "value": "text"})
    model = toxicity.fit_toxicity(docs, marks)
    got = toxicity.score_toxicity(docs, model).collect()
    assert len(got) == len(LOGS) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert toxicity.score_toxicity(docs.limit(0), model).collect() == []
    none = toxicity.fit_toxicity(docs, marks.limit(0))
    assert all(r["predicted"] == 0 for r in toxicity.score_toxicity(docs, none).collect())
    assert toxicity.without_toxic(docs, none).count() == len(LOGS)


def test_surrogates(spark):
    rows = [*LOGS, (9, "mail a.b@site.org twice: a.b@site.org, A.B@site.org", None), (10, "1.2.3.4", "x"), (10, "1.2.3.4", "x")]
    got = surrogates.replace_personal_data(logs(spark, rows)).collect()
    assert sorted(((r["file"], r["value"]) for r in got if not r["n_replaced"]), key=str) == sorted(((f, v) for f, v, _ in LOGS), key=str)
    assert {r["n_replaced"] for r in got if r["file"] == 9} == {3} and len({r["value"] for r in got if r["file"] == 10}) == 1
    assert surrogates.replace_personal_data(logs(spark, [])).collect() == []
    assert surrogates.replace_personal_data(logs(spark)).count() == len(LOGS)


def test_languages(spark):
    docs = logs(spark).withColumnsRenamed({"file": "doc_id", "value": "text"})
    model = language.fit_languages(docs, "text", "optics_group")
    got = language.identify_languages(docs, model).collect()
    assert len(got) == len(LOGS)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (2, 3, 4)} == {"und"}
    assert {r["lang_pred"] for r in got if r["doc_id"] in (1, 7)} == {"a"} and {r["lang_pred"] for r in got if r["doc_id"] == 5} == {"c"}
    assert language.identify_languages(docs.limit(0), model).collect() == []
    none = language.fit_languages(docs.limit(0), "text", "optics_group")
    assert {r["lang_pred"] for r in language.identify_languages(docs, none).collect()} == {"und"}


def test_passages(spark):
    known = spark.createDataFrame([(1, "one two three four five six"), (1, "one two three four five six"), (2, None), (3, ""), (None, "x"), (4, "too short")],
                                  "template bigint, value string").withColumn("file", F.lit(0))
    got = decontaminate.find_passages(logs(spark), known).collect()
    assert [(r["file"], r["template"]) for r in got] == [(1, 1)]
    assert decontaminate.find_passages(logs(spark), known.limit(0)).collect() == []
    assert decontaminate.find_passages(logs(spark, []), known).collect() == []
    rest = decontaminate.without_passages(logs(spark), known)
    assert rest.columns == logs(spark).columns and rest.count() == len(LOGS) - 2


def test_near_images(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.1], 1), (4, [1.0, 0.0], 2), (5, None, 1), (6, [0.0, 0.0], 1), (7, [nan, 1.0], 1),
            (8, [None, 1.0], 1), (9, [1.0, 0.0], None), (None, [1.0, 0.0], 1), (10, [], 1), (11, [1.0], 1), (12, [0.0, 1.0], 1)]
    images = spark.createDataFrame(rows, "pid bigint, pixels array<double>, optics_group int").withColumns({"rep": F.lit(1), "node": F.lit("x"), "vec": F.lit(0)})
    got = {(r["pid"], r["n_links"], r["component_id"], r["kept"]) for r in vector_forest.near_equal_images(images).collect()}
    alone = {(p, 0, p, True) for p in (4, 5, 6, 7, 8, 9, 10, 11, 12)}
    assert got == alone | {(1, 3, 1, True), (2, 3, 1, False), (3, 3, 1, False), (None, 0, None, None)}
    assert vector_forest.near_equal_images(images.limit(0)).collect() == []


def test_pipeline_stages(spark, tmp_path):
    docs = spark.createDataFrame([(k, v, "en", s, len(v) if v is not None else None) for k, v, s in LOGS], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "none of these words are in a log")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "decontaminate", "mix", "tokens"]
    for table in (docs, docs.limit(0)):
        now = table
        for name, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, str(tmp_path))
            rows = now.collect()
            if name != "tokens":
                assert now.columns == docs.columns
                now = spark.createDataFrame(rows, docs.schema)
        assert bool(rows) == (table is docs)
