"""Pages meet what is known of their hosts."""

from orientlake.llm import html_wrappers
from orientlake.llm.common import BATCH_BYTES, Scratch, map_rows


def test_few_hosts_are_sent_to_the_pages(spark):
    pages = spark.createDataFrame([(i, f"http://h{i % 3}.org/{i}", f"<body><nav>menu</nav><article><p>text {i}</p></article></body>") for i in range(60)],
                                  "page_id bigint, url string, html string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(100_000))
    try:
        found = html_wrappers.extract_articles(pages, Scratch(spark))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
        assert {(r["page_id"], r["text"]) for r in found.collect()} == {(i, f"text {i}") for i in range(60)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_long_texts_come_in_small_parts(spark):
    def sizes(batches):
        for batch in batches:
            yield {"rows": [len(batch["t"])], "size": [sum(map(len, batch["t"]))]}
    df = spark.range(40).coalesce(1).selectExpr("repeat('x', case when id = 39 then 9000000 else 500000 end) t")
    got = map_rows(df, sizes, "rows int, size long").collect()
    assert sum(r["rows"] for r in got) == 40 and len(got) > 4
    assert all(r["size"] <= 4 * BATCH_BYTES for r in got)


def test_a_worker_gives_back_what_its_task_freed(spark):
    def held(batches):
        kept = []
        for batch in batches:
            kept += [str(i) * 500 for i in range(60_000)]  # a text each in the heap of the C library
            yield {"mb": [0]}
        del kept

    def now(batches):
        for _ in batches:
            with open("/proc/self/smaps_rollup") as f:
                yield {"mb": [sum(int(line.split()[1]) for line in f if line.startswith("Private_Dirty")) // 1024]}
    one = spark.range(1).coalesce(1)
    before = map_rows(one, now, "mb long").first()["mb"]
    map_rows(one, held, "mb long").collect()
    assert map_rows(one, now, "mb long").first()["mb"] < before + 40
