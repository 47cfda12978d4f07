"""URL rules decided by cascades of Bloom filters, with DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from orientlake.llm.common import Scratch, keep_columns

#: A filter has at most so many 64-bit words (8 MB); more keys are split over filters by a hash.
MOST_WORDS = 1 << 20


def host_of(url: str) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    rest = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def key_columns(host: str, path: str, most_labels: int, most_folders: int) -> Column:
    """All rules that could fit: every parent of the host with every folder of the path, as deep as rules go."""
    labels = F.split(F.col(host), r"\.")
    hosts = F.transform(F.sequence(F.greatest(F.lit(1), F.size(labels) - most_labels + 1), F.size(labels)),
                        lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    parts = F.split(F.col(path), "/", most_folders + 1)
    folders = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")))
    keys = F.flatten(F.transform(hosts, lambda h: F.transform(folders, lambda p: F.concat(h, p))))
    fits = (F.col(host) != "") & F.col(path).startswith("/")
    return F.when(fits, F.array_distinct(keys)).otherwise(F.array().cast("array<string>"))


@dataclass(frozen=True)
class Level:
    """One filter: the words of its bits, and how to find a key's bits."""

    words: DataFrame
    bits: int
    hashes: int
    number: int

    def column(self) -> tuple[str, Column]:
        """The filter as a column of its own: a scalar subquery, the same array for every row."""
        return f"_filter{self.number}", self.words.scalar()

    def holds(self, key: Column) -> Column:
        filled = F.col(f"_filter{self.number}")
        found = F.lit(True)
        for i in range(self.hashes):
            at = F.pmod(F.xxhash64(key, F.lit(self.number * 16 + i)), F.lit(self.bits))
            word = F.element_at(filled, (F.floor(at / 64) + 1).cast("int"))
            found = found & (F.getbit(word, F.pmod(at, F.lit(64)).cast("int")) == 1)
        return found


def _level(keys: DataFrame, count: int, rate: float, number: int, scratch: Scratch) -> Level:
    """A filter over ``count`` keys that lets a foreign key through with probability ``rate``."""
    hashes = max(1, min(16, round(-math.log2(rate))))
    words = min(MOST_WORDS, max(1, math.ceil(count * hashes / math.log(2) / 64)))
    bits = words * 64
    at = keys.select(F.explode(F.array(*[F.pmod(F.xxhash64("key", F.lit(number * 16 + i)), F.lit(bits)) for i in range(hashes)])).alias("at"))
    set_words = at.groupBy(F.floor(F.col("at") / 64).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("at", F.lit(64)).cast("int"))).alias("bits"))
    # one row that holds the whole filter; its size was fixed above
    filled = set_words.agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m")).select(
        F.transform(F.sequence(F.lit(0), F.lit(words - 1)), lambda i: F.coalesce(F.try_element_at("m", i.cast("bigint")), F.lit(0).cast("bigint"))).alias("words"))
    return Level(scratch.cut(filled, "filter"), bits, hashes, number)


class Cascade:
    """Exact membership for every key of a universe, from Bloom filters alone.

    The first filter holds the listed keys. Keys of the universe that it lets
    through by mistake are in the second, listed keys that the second lets
    through are in the third, and so on until nobody is let through by
    mistake. A key belongs to the list if the first filter that does not know
    it has an even number (counted from one). ``listed`` and ``universe``
    have one column ``key``; null keys belong to nothing.
    """

    def __init__(self, universe: DataFrame, listed: DataFrame, scratch: Scratch, first: int = 0, rate: float = 0.0):
        self.levels: list[Level] = []
        inside = scratch.cut(universe.where("key is not null").distinct().join(listed.where("key is not null").distinct(), "key", "left_semi"), "inside")
        outside = scratch.cut(universe.where("key is not null").distinct().join(listed.where("key is not null"), "key", "left_anti"), "outside")
        n_in, n_out = inside.count(), outside.count()
        number = first
        while n_in:
            # the first filter is as tight as pays: about as many false positives as listed keys
            share = rate or (min(0.5, max(n_in / max(n_out, 1) / math.sqrt(2), 1e-4)) if number == first else 0.5)
            level = _level(inside, n_in, share, number, scratch)
            self.levels.append(level)
            wrong = scratch.cut(outside.withColumns(dict([level.column()])).where(level.holds(F.col("key"))).select("key"), "wrong")
            inside, outside, n_in, n_out = wrong, inside, wrong.count(), n_in
            number += 1

    def columns(self) -> dict[str, Column]:
        return dict(level.column() for level in self.levels)

    def contains(self, key: Column) -> Column:
        """True for listed keys of the universe; levels are asked in turn, and only as far as needed."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels) - 1, -1, -1):
            answer = F.when(self.levels[i].holds(key), answer).otherwise(F.lit(i % 2 == 1))
        return answer


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], key: str = "page_id", url: str = "url", otherwise: str = "allow") -> DataFrame:
    """Which rule decides about each address: ``key``, ``host``, ``path``, ``rule`` and ``verdict``.

    General: the particle records hold no addresses. ``rules`` are (verdict,
    host and path) with a verdict of allow or block and a path that ends in
    ``/``. A rule fits its host and all hosts below it, if the path of the
    address starts with the rule's. The longest rule wins; of rules of one
    length block wins. Where none fits, ``rule`` is null and the verdict is
    ``otherwise``.

    Method: the universe is every (parent host, folder) of the corpus, as deep
    as the deepest rule. One
    cascade holds the keys with a blocking rule, another those with an
    allowing one; both answer exactly for this universe, so pages are judged
    in one scan without a join. The filters' size follows from the number of
    rules that occur and is bounded.

    Null or malformed addresses: empty host and path, no rule. Null keys and
    repeated rows are judged like any row. No rows: an empty result.
    """
    for verdict, rule in rules:
        if verdict not in ("allow", "block") or not rule.endswith("/"):
            raise ValueError(f"bad rule {verdict} {rule}")
    spark = pages.sparkSession
    scratch = Scratch(spark)
    rows = keep_columns(pages, key, url, where="pages")
    placed = rows.select(F.col(key), host_of(url).alias("host"), path_of(url).alias("path"))
    depth = (max((r.split("/", 1)[0].count(".") + 1 for _, r in rules), default=1), max((r.count("/") for _, r in rules), default=1))
    universe = scratch.cut(placed.select("host", "path").distinct().select(F.explode(key_columns("host", "path", *depth)).alias("key")).distinct(), "universe")
    listed = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(v).alias("verdict"), F.lit(k).alias("key")) for v, k in rules or [("none", "")]])))
    block = Cascade(universe, listed.where("verdict = 'block'").select("key"), scratch, 0)
    allow = Cascade(universe, listed.where("verdict = 'allow'").select("key"), scratch, 1000)
    keyed = placed.withColumns({"keys": key_columns("host", "path", *depth), **block.columns(), **allow.columns()})
    judged = keyed.withColumn("fits", F.filter(
        F.transform("keys", lambda k: F.struct(F.length(k).alias("long"), block.contains(k).alias("block"), allow.contains(k).alias("allow"), k.alias("rule"))),
        lambda s: s["block"] | s["allow"]))
    best = F.array_max("fits")
    out = judged.select(key, "host", "path", best["rule"].alias("rule"),
                        F.when(best.isNull(), F.lit(otherwise)).when(best["block"], F.lit("block")).otherwise(F.lit("allow")).alias("verdict"))
    return scratch.finish(out, "judged")
