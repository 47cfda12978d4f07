"""Texts that hold a known passage, also with other numbers, names and units."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from orientlake.llm.bloom import Bloom, may_hold, without_keys
from orientlake.llm.common import Scratch, keep_columns, map_rows, mix

# Units that follow a number.
UNITS = frozenset("mm cm m km in ft yd mi mg g kg t oz lb ml l s sec secs second seconds min mins minute minutes h hr hrs hour hours day days "
                  "week weeks month months year years % percent usd eur gbp $ € £ dollars dollar euros euro cents cent px å nm kv".split())
_NUMBER = re.compile(r"[$€£]?[+-]?\d[\d.,:/]*%?")
_EDGES = ".,;:!?\"'()[]{}«»“”„|*"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_EXACT = np.uint64(1 << 32)


class Templates:
    """Turns texts into template words; what is known of a word is remembered up to a number of words."""

    LINE = "\x01"

    def __init__(self, most: int = 300_000):
        self.most = most
        self._clear()

    def _clear(self):
        self.known: dict[str, int] = {}
        self.low: list[str] = []
        self.marks = np.zeros((1024, 6), bool)  # word, number, unit, name, ends a sentence, line break
        self.codes = np.zeros(1024, np.uint64)

    def _learn(self, raws: list[str]):
        start = len(self.low)
        while start + len(raws) > len(self.codes):
            self.marks = np.concatenate([self.marks, np.zeros_like(self.marks)])
            self.codes = np.concatenate([self.codes, np.zeros_like(self.codes)])
        for i, raw in enumerate(raws, start):
            core = raw.strip(_EDGES)
            low = core.lower()
            self.known[raw] = i
            self.low.append(low)
            number = _NUMBER.fullmatch(core) is not None
            self.marks[i] = (bool(core) and raw != self.LINE, number, low in UNITS, len(core) > 1 and core[0].isupper() and core[1:].islower(),
                             raw[-1] in ".!?:", raw == self.LINE)
        self.codes[start:len(self.low)] = pd.util.hash_array(np.array(self.low[start:], dtype=object), categorize=False)

    def words(self, text: str | None) -> "TemplateWords":
        raws = (text or "").replace("\n", f" {self.LINE} ").split()
        new = list(dict.fromkeys(w for w in raws if w not in self.known))
        if new:
            if len(self.low) + len(new) > self.most:
                self._clear()
                new = list(dict.fromkeys(raws))
            self._learn(new)
        ids = np.fromiter(map(self.known.__getitem__, raws), np.int64, len(raws))
        marks = self.marks[ids]
        at = np.flatnonzero(marks[:, 0])
        stops = np.concatenate([[0], np.cumsum(marks[:, 4] | marks[:, 5])])
        before = np.concatenate([[0], stops[at[:-1]]]) if len(at) else stops[:0]
        opens = stops[at] > before
        opens[:1] = True
        number = marks[at, 1]
        unit = marks[at, 2] & np.concatenate([[False], number[:-1]])[:len(at)] & ~number
        name = marks[at, 3] & ~opens & ~number & ~unit
        return TemplateWords(ids[at], self.codes[ids[at]], number, unit, name, self.low)


class TemplateWords:
    """The words of one text: literal codes, and which of them are numbers, units after a number, and names.

    A name has a capital first letter inside a sentence. The first word of a
    window has an unknown past and is never taken for a name.
    """

    def __init__(self, ids, literal, number, unit, name, low):
        self.ids, self.literal, self.low = ids, literal, low
        self.slot = number | unit | name
        self.first_slot = number | unit
        kinds = np.where(number, np.uint64(1), np.where(unit, np.uint64(2), np.uint64(3)))
        self.code = np.where(self.slot, kinds, literal)
        self.first = np.where(self.first_slot, kinds, literal)

    def __len__(self) -> int:
        return len(self.ids)

    def windows(self, size: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and template hash of every window of ``size`` words with at least ``least`` literal words."""
        count = len(self) - size + 1
        if count <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        got = self.first[:count] + np.uint64(size)
        for i in range(1, size):
            got = got * _BASE + self.code[i:count + i]
        literal = np.concatenate([[0], np.cumsum(~self.slot)])
        full = literal[size:] - literal[1:count + 1] + ~self.first_slot[:count]
        at = np.flatnonzero(full >= least)
        return at, mix(got[at])

    def exact_windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and hash of every window of ``size`` words, all taken literally."""
        count = max(len(self) - size + 1, 0)
        got = np.full(count, _EXACT + np.uint64(size))
        for i in range(size):
            got = got * _BASE + self.literal[i:count + i]
        return np.arange(count), mix(got)

    def values(self, at: int, size: int) -> list[str]:
        """Values of the slots of one window."""
        lead = [at] if self.first_slot[at] else []
        return [self.low[self.ids[i]] for i in lead + [at + 1 + int(i) for i in np.flatnonzero(self.slot[at + 1:at + size])]]


def _passage_windows(size: int, shortest: int):
    def run(batches):
        templates = Templates()
        for batch in batches:
            out = {"item": [], "at": [], "hash": [], "slots": [], "width": [], "words": [], "exact": []}
            for item, text in zip(batch["_item"], batch["_text"]):
                words = templates.words(text)
                width = min(size, len(words))
                if width < shortest:
                    continue
                starts, hashes = words.exact_windows(width)
                exact = np.ones(len(starts), bool)
                at, got = words.windows(width, (width + 1) // 2)
                hashes[at], exact[at] = got, False
                for at, h, e in zip(starts, hashes, exact):
                    out["item"].append(item)
                    out["at"].append(int(at))
                    out["hash"].append(int(h.astype(np.int64)))
                    out["slots"].append([] if e else words.values(int(at), width))
                    out["width"].append(width)
                    out["words"].append(len(words))
                    out["exact"].append(bool(e))
            yield out
    return run


def _hits(bloom, widths: list[tuple[int, bool]]):
    """Windows of the texts that may be windows of a passage, with the values of their slots (none where all words are literal)."""
    def run(batches):
        bits, templates = bloom.bits(), Templates()
        for batch in batches:
            out = {"key": [], "start": [], "hash": [], "values": []}
            for key, text in zip(batch["_key"], batch["_text"]):
                words = templates.words(text)
                for width, exact in widths:
                    at, got = words.exact_windows(width) if exact else words.windows(width, (width + 1) // 2)
                    for i in np.flatnonzero(may_hold(bits, got)):
                        out["key"].append(key)
                        out["start"].append(int(at[i]))
                        out["hash"].append(int(got[i].astype(np.int64)))
                        out["values"].append([] if exact else words.values(int(at[i]), width))
            yield out
    return run


def _one_to_one(pairs: F.Column) -> F.Column:
    """True when pairs of (passage value, text value) map both ways without conflict."""
    distinct = F.size(F.array_distinct(pairs))
    return (distinct == F.size(F.array_distinct(F.transform(pairs, lambda p: p["a"])))) & (
        distinct == F.size(F.array_distinct(F.transform(pairs, lambda p: p["b"]))))


def find_passages(texts: DataFrame, passages: DataFrame, key: str = "file", text: str = "value", item: str = "template",
                  item_text: str = "value", window: int = 13, shortest: int = 5) -> DataFrame:
    """Which texts hold a passage: ``key``, ``item``, ``start`` (word), ``n_windows``, ``n_words`` and ``changed``.

    Takes run logs (``file``, ``value``) against log templates, or any texts
    against any passages. One row per text and passage that share at least one
    window of ``window`` template words at one offset. Windows with the same
    values always count; those with changed values count when the slots of all
    of them together map one to one. ``changed`` tells that a slot's value
    differs in a window that counts, so the passage was given other numbers,
    names or units.

    Passages shorter than a window are one window; under ``shortest`` words
    they match nothing. Windows of a passage of which fewer than half are
    literal words are found with the same values only, as all their words are
    taken literally. Windows are joined by hash; a Bloom filter of fixed size
    lets only likely windows of the texts through, whatever the number of
    passages. Nulls in any column match nothing. Repeated rows add nothing.
    No rows on either side: an empty result.
    """
    spark = texts.sparkSession
    docs = keep_columns(texts, key, text, where="texts").select(F.col(key).alias("_key"), F.col(text).alias("_text")).where("_key is not null and _text is not null")
    items = keep_columns(passages, item, item_text, where="passages").select(F.col(item).alias("_item"), F.col(item_text).alias("_text")).where(
        "_item is not null and _text is not null")
    key_kind, item_kind = docs.schema["_key"].dataType.simpleString(), items.schema["_item"].dataType.simpleString()
    scratch = Scratch(spark)
    known = scratch.cut(map_rows(items, _passage_windows(window, shortest),
                         f"item {item_kind}, at int, hash bigint, slots array<string>, width int, words int, exact boolean").dropDuplicates(["item", "at"]), "windows")
    widths = sorted((r["width"], r["exact"]) for r in known.select("width", "exact").distinct().collect())  # at most two for each number up to `window`
    bloom = Bloom(known.select("hash"))
    hits = map_rows(docs, _hits(bloom, widths), f"key {key_kind}, start int, hash bigint, values array<string>")
    joined = hits.join(known, "hash").where(F.size("values") == F.size("slots")).withColumn(
        "pairs", F.zip_with("slots", "values", lambda a, b: F.struct(a.alias("a"), b.alias("b")))).where(_one_to_one(F.col("pairs")))
    def spans(condition) -> F.Column:
        start, at, end = (F.when(condition, c) for c in (F.col("start"), F.col("at"), F.col("at") + F.col("width")))
        return F.struct(F.min(start).alias("start"), F.size(F.collect_set(at)).alias("n_windows"), (F.max(end) - F.min(at)).alias("n_words"))

    # unchanged windows stand by themselves, all changed windows of one alignment must agree; their pairs are at most the slots of the passage
    same = F.forall("pairs", lambda p: p["a"] == p["b"])
    aligned = joined.withColumn("same", same).groupBy("key", "item", (F.col("start") - F.col("at")).alias("offset")).agg(
        spans(F.lit(True)).alias("all"), spans(F.col("same")).alias("unchanged"), F.flatten(F.collect_set(F.when(~F.col("same"), F.col("pairs")))).alias("pairs"))
    agree = _one_to_one(F.col("pairs"))
    told = aligned.select("key", "item", F.when(agree, F.col("all")).otherwise(F.col("unchanged")).alias("w"), (agree & (F.size("pairs") > 0)).alias("changed"))
    best = told.where("w.n_windows > 0").select("key", "item", "w.*", "changed").groupBy("key", "item").agg(
        F.max_by(F.struct("start", "n_windows", "n_words", "changed"), F.struct("n_windows", -F.col("start"))).alias("b"))
    return scratch.finish(best.select(F.col("key").alias(key), F.col("item").alias(item), "b.start", "b.n_windows", "b.n_words", "b.changed"), "passages")


def without_passages(texts: DataFrame, passages: DataFrame, key: str = "file", text: str = "value", item: str = "template",
                     item_text: str = "value", window: int = 13, shortest: int = 5) -> DataFrame:
    """The rows of ``texts`` whose key has no row in ``find_passages``; rows without a key stay."""
    return without_keys(texts, key, find_passages(texts, passages, key, text, item, item_text, window, shortest).select(key))
