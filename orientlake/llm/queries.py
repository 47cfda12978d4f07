"""The numbered queries: thin steps from the given tables to the operators and back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from orientlake.llm import conversations, decontaminate, html_wrappers, language, lattice_lm, mixing, ngram_join, surrogates, token_alignment, tokens, toxicity, url_filter, vector_forest
from orientlake.llm.common import Scratch, fold_of
from orientlake.session import new_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count("text").alias("size"))
    mixed = mixing.mix_sources(docs, "doc_id", "source", "size", weights=(5, 2, 1), cap=3)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "rate", "copies")


@query
def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_texts(table(spark, sf_dir, "documents"), "doc_id", "text", n=5, percent=80)


RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


@query
def op3_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), RULES, "page_id", "url", otherwise="allow")


@query
def op4_lattice_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return lattice_lm.score_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), "doc_id", "text", folds=7, held_out=2)


@query
def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(spark, table(spark, sf_dir, "documents"))


def token_files(spark: SparkSession, docs: DataFrame) -> DataFrame:
    import public_tokenizers

    folder = new_dir(spark, "tokens")
    tokens.write_tokens(docs, folder, public_tokenizers.path("word_bpe_49k.json"), "doc_id", "text", end_id=2)
    return tokens.read_tokens(spark, folder, "doc_id")


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "toxic")
    return toxicity.score_toxicity(docs, model, "doc_id", "text")


@query
def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace_personal_data(table(spark, sf_dir, "documents"), "doc_id", "text")


@query
def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold_of("doc_id", 3) == 1
    model = language.fit_languages(docs.where(~held_out), "text", "lang")
    found = language.identify_languages(docs, model, "doc_id", "text")
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text")


@query
def op10_vector_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_forest.near_equal_images(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label", cosine=0.98)


@query
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    import sentencepiece

    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    aligned = token_alignment.align_texts(table(spark, sf_dir, "documents"), a, b, "doc_id", "text")
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    scratch = Scratch(spark)
    width = sentencepiece.SentencePieceProcessor(model_file=b).get_piece_size()
    scored = token_alignment.score_links(aligned.withColumn("groups_sha256", digest).drop("groups"), width, scratch)
    return scratch.finish(scored.select(F.col("doc_id").cast("bigint").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"), "alignment")


@query
def op12_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    found = html_wrappers.extract_articles(table(spark, sf_dir, "pages"), scratch, "page_id", "url", "html")
    return scratch.finish(found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars")), "articles")


def damaged_turns(turns: DataFrame) -> DataFrame:
    """Some turns dropped, emptied, cut, repeated or given to the user, by the checksum of their place."""
    place = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    text = F.coalesce("text", F.lit(" "))
    kind = F.col("_kind")
    return turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), (F.crc32(place.cast("binary")) % 20).alias("_kind")).where(
        kind != 0).select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
                          F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
                          F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))).alias("_copy")).drop("_copy")


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    scratch = Scratch(spark)
    report = conversations.repair_report(conversations.plan_repair(damaged_turns(turns), "conv_id", "turn", "role", "text", scratch), "conv_id")
    told = report.withColumnRenamed("conv_id", "_conv")
    sums = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    every = turns.select("conv_id").distinct().join(told, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    return scratch.finish(every.select("conv_id", *sums, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce(
        "digest", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256")), "repairs")


ORACLES["op3_url_cascade"] = r"""
with parts as (
  select page_id, coalesce(nullif(strpos(url, '://'), 0) + 3, null) as p, url from pages),
rest as (select page_id, case when p is null then '' else substr(url, p) end as r from parts),
split as (
  select page_id, regexp_extract(r, '^([^/?#]*)', 1) as h, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) as path from rest),
placed as (select page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, path from split),
rules(verdict, rule, rh, rp) as (values ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'),
  ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/'))
select page_id, host, path, arg_max(rule, length(rule)) as rule, coalesce(arg_max(verdict, length(rule)), 'allow') as verdict
from placed left join rules on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp)
group by page_id, host, path
"""

ORACLES["op2_ngram_jaccard"] = r"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s from words),
grams as (select doc_id, len(s) as n, unnest(s) as g from sets),
pairs as (
  select a.doc_id as a, b.doc_id as b, count(*) as shared, any_value(a.n) as na, any_value(b.n) as nb
  from grams a join grams b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from pairs where 100 * shared >= 80 * (na + nb - shared)),
edges as (select a, b from links union select b, a from links),
reach(node, other) as (select doc_id, doc_id from documents union select r.node, e.b from reach r join edges e on e.a = r.other)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, c.component_id
from sets s join (select node, min(other) as component_id from reach group by node) c on c.node = s.doc_id
"""
