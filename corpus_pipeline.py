"""The corpus pipeline: each stage takes what its predecessor kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame. All but the last return the columns of ``documents``.
``run`` writes every stage as Parquet in the shared folder and reads it again.
No SQL can express the fitted classifier or the tokenizer, so there is no
checking SQL; ``tests/llm`` compares stages with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orientlake.llm import decontaminate, mixing, ngram_join, toxicity
from orientlake.llm.queries import table, token_files
from orientlake.session import cut

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the toxicity model rejects go.

    Null and empty texts stay, rows that repeat are judged each, null ids are
    not learned from. No rows, or no toxic label: nothing goes.
    """
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "toxic")
    return toxicity.without_toxic(docs, model, "text")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays.

    Texts without words and rows without an id all stay; of rows that repeat
    an id one stays. No rows: none.
    """
    return ngram_join.one_per_group(docs, "doc_id", "text", n=5, percent=80)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage, in its own or in other numbers and names, go.

    Null and empty texts and rows without an id stay; all rows of an id go
    together. No rows, or no passages: nothing goes.
    """
    return decontaminate.without_passages(docs, table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the balanced mix of their sources says.

    A null source is a source of its own, a text without words comes once, and
    rows that repeat an id (null is one) share its copies. No rows: none.
    """
    sized = docs.select("doc_id", "source", mixing.word_count("text").alias("size"))
    mixed = mixing.mix_sources(sized, "doc_id", "source", "size", weights=(5, 2, 1), cap=3)
    return mixing.repeat_rows(docs, mixed, "doc_id")


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back.

    Null and empty texts are the end id alone, null ids come first, repeated
    rows are written each. No rows: no files and no rows.
    """
    return token_files(spark, docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontaminate", drop_benchmark_passages),
    ("mix", mix),
    ("tokens", write_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
