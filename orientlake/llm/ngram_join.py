"""Similarity join on word n-grams: which texts are nearly the same."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from orientlake.llm.bloom import Bloom, free_name, may_hold
from orientlake.llm.common import Scratch, keep_columns, map_rows, mix, words_of
from orientlake.llm.components import components
from orientlake.session import shuffle_width

SKETCH_BITS = 18  # counters of the rarity sketch: 2 MB at most in a task, whatever the corpus holds
_CHUNK = 4096
_BINS, _FINE = 64, 256  # ranges of a hash in the filter inside lists, and, at least, in the one before sets are moved
_PER_RANGE = 4  # grams in a range of the latter at most; in fuller ones the counts of unrelated texts are alike
_LIST_BLOCK = 2000  # a longer posting list is compared in blocks of about so many rows
_BASE = np.uint64(0x9E3779B97F4A7C15)


def ngram_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's n-grams; a shorter text is one gram, an empty one has none."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    codes = pd.util.hash_array(np.array(words, dtype=object), categorize=False)
    width = min(n, len(codes))
    grams = np.full(len(codes) - width + 1, width, np.uint64)
    for i in range(width):
        grams = grams * _BASE + codes[i:len(codes) - width + 1 + i]
    return np.unique(mix(grams))


def _bucket(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _describe(n: int):
    """Per text its set's size and fingerprint; per task how often each bucket of grams occurs."""
    def run(batches):
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            sizes, first, second, buckets, bins, fine = [], [], [], [], [], []
            for text in batch["_text"]:
                grams = ngram_set(text, n)
                buckets.append(_bucket(grams))
                sizes.append(len(grams))
                bins.append(_bins(grams, _BINS))
                fine.append(_bins(grams, max(_FINE, 1 << (len(grams) // _PER_RANGE).bit_length())))
                first.append(int(grams.sum(dtype=np.uint64).astype(np.int64)))
                second.append(int(mix(grams ^ _BASE).sum(dtype=np.uint64).astype(np.int64)))
            counts += np.bincount(np.concatenate(buckets), minlength=len(counts)) if buckets else 0
            k = len(sizes)
            yield {"key": batch["_key"], "n": sizes, "f1": first, "f2": second, "bins": bins, "fine": fine, "chunk": [None] * k, "counts": [None] * k}
        used = [c for c in range(len(counts) // _CHUNK) if counts[c * _CHUNK:(c + 1) * _CHUNK].any()]
        if used:
            k = len(used)
            yield {"key": [None] * k, "n": [None] * k, "f1": [None] * k, "f2": [None] * k, "bins": [None] * k, "fine": [None] * k, "chunk": used,
                   "counts": [counts[c * _CHUNK:(c + 1) * _CHUNK].astype("<i8").tobytes() for c in used]}
    return run


def _add_chunks(batches):
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for c, raw in zip(batch["chunk"], batch["counts"]):
            got = np.frombuffer(raw, "<i8")
            sums[c] = sums[c] + got if c in sums else got
    yield {"chunk": list(sums), "counts": [x.tobytes() for x in sums.values()]}


def _prefixes(n: int, percent: int, counts, skip: Bloom | None = None):
    """Postings of each text's rarest grams: so many that any text alike shares one of them.

    Texts whose key may be in ``skip`` are left out.
    """
    def run(batches):
        rarity, bits = counts.value, skip.bits() if skip else None
        for batch in batches:
            out = {"gram": [], "key": [], "n": [], "place": []}
            passed = may_hold(bits, np.array(batch["_hash"], np.int64).view(np.uint64)).tolist() if skip else itertools.repeat(False)
            for key, text, left_out in zip(batch["_key"], batch["_text"], passed):
                if left_out:
                    continue
                grams = ngram_set(text, n)
                size = len(grams)
                if not size:
                    continue
                length = size - -(-percent * size // 100) + 1
                common = rarity[_bucket(grams)]
                if length < size:
                    near = np.argpartition(common, length - 1)[:length]
                    limit = common[near].max()
                    # ties at the limit are ordered by the gram itself, the same way in every text
                    near = np.flatnonzero(common <= limit)
                else:
                    near = np.arange(size)
                near = near[np.lexsort((grams[near], common[near]))][:length]
                out["gram"].append(grams[near].view(np.int64))
                out["key"].append(np.full(length, key))
                out["n"].append(np.full(length, size, np.int32))
                out["place"].append(np.arange(length, dtype=np.int32))
            if out["gram"]:
                yield {c: np.concatenate(x) for c, x in out.items()}
    return run


def _bins(grams: np.ndarray, ranges: int) -> bytes:
    """Grams counted by range of their hash, each count at most 255; differences of capped counts are never larger."""
    return np.minimum(np.bincount((grams >> np.uint64(10)).astype(np.int64) & (ranges - 1), minlength=ranges), 255).astype(np.uint8).tobytes()


def _sets(n: int, bloom: Bloom):
    """Whole sets of the texts whose key may be wanted."""
    def run(batches):
        bits = bloom.bits()
        for batch in batches:
            at = np.flatnonzero(may_hold(bits, np.array(batch["_hash"], np.int64).view(np.uint64)))
            yield {"key": [batch["_key"][i] for i in at], "grams": [ngram_set(batch["_text"][i], n).tobytes() for i in at]}
    return run


def _verify(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch["x"], batch["y"]):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield {"a": [v for v, k in zip(batch["a"], keep) if k], "b": [v for v, k in zip(batch["b"], keep) if k]}
    return run


def _within_lists(percent: int, nearest: bool):
    """Pairs of one posting list from different components that pass the length, positional and suffix filters.

    Rows come sorted by list. With ``nearest`` every row names one partner
    only, the one whose counts by range of hash differ least; else all pairs
    are given. Matrices are built for some rows of a list at a time.
    """
    def pairs(rows):
        bins = rows["bins"].astype(np.int16)
        n, place, c, key, own = (rows[x] for x in ("n", "place", "c", "key", "block"))
        last = rows["j"][0]
        right = np.flatnonzero(own == last)
        left = np.arange(len(key)) if nearest else np.flatnonzero(own == rows["i"][0])
        if nearest:
            right = np.arange(len(key))
        step = max(1, (1 << 21) // (len(right) * _BINS))
        for s in range(0, len(left), step):
            x = left[s:s + step, None]
            y = right[None, :]
            both = n[x] + n[y]
            rest = np.minimum(n[x] - place[x], n[y] - place[y])
            ok = (c[x] != c[y]) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])) & (
                (100 + percent) * (np.minimum(place[x], place[y]) + rest) >= percent * both)
            if not ok.any():
                continue
            far = np.abs(bins[left[s:s + step], None, :] - bins[None, right, :]).sum(2, dtype=np.int64)
            ok &= (100 + percent) * far <= (100 - percent) * both
            if nearest:
                share = np.where(ok, far / both, np.inf)
                pick = share.argmin(1)
                some = np.flatnonzero(np.isfinite(share[np.arange(len(pick)), pick]))
                yield key[left[s:s + step][some]], key[right[pick[some]]]
            else:
                p, q = np.nonzero(ok & ((key[x] < key[y]) | (own[x] != own[y])))
                yield key[left[s:s + step][p]], key[right[q]]

    def run(batches):
        names = ("gram", "i", "j", "block", "key", "n", "place", "c")
        held = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                if not batch["gram"]:
                    continue
                now = {x: np.array(batch[x]) for x in names}
                now["bins"] = np.frombuffer(b"".join(batch["bins"]), np.uint8).reshape(-1, _BINS)
                held = now if held is None else {x: np.concatenate([held[x], now[x]]) for x in held}
            if held is None:
                return
            edge = np.flatnonzero((np.diff(held["gram"]) != 0) | (np.diff(held["i"]) != 0) | (np.diff(held["j"]) != 0)) + 1
            starts = [0, *edge.tolist()]
            ends = [*edge.tolist(), len(held["gram"])]
            whole = len(starts) if batch is None else len(starts) - 1
            a, b = [], []
            for s, e in zip(starts[:whole], ends[:whole]):
                if e - s > 1:
                    for p, q in pairs({x: v[s:e] for x, v in held.items()}):
                        a.append(p)
                        b.append(q)
            if a:
                yield {"key": np.concatenate(a), "other": np.concatenate(b)}
            held = {x: v[starts[-1]:] for x, v in held.items()} if batch is not None else None
    return run


def _apart(x: bytes, y: bytes) -> int:
    """How far the counts by range of two sets differ; the one with more ranges is folded to those of the other."""
    ranges = min(len(x), len(y))
    a, b = (np.minimum(np.frombuffer(v, np.uint8).reshape(-1, ranges).sum(0, dtype=np.int64), 255) for v in (x, y))
    return int(np.abs(a - b).sum())


def _suffix(percent: int):
    """Suffix filter: sets whose counts by range of hash differ too much are not alike."""
    def run(batches):
        for batch in batches:
            if not batch["a"]:
                continue
            ranges = np.array([[len(x), len(y)] for x, y in zip(batch["x"], batch["y"])])
            far = np.zeros(len(ranges), np.int64)
            for width in np.unique(ranges[:, 0]).tolist():
                at = np.flatnonzero((ranges == width).all(1))
                x, y = (np.frombuffer(b"".join([batch[c][i] for i in at]), np.uint8).reshape(-1, width).astype(np.int16) for c in ("x", "y"))
                far[at] = np.abs(x - y).sum(1, dtype=np.int64)
            for i in np.flatnonzero(ranges[:, 0] != ranges[:, 1]).tolist():
                far[i] = _apart(batch["x"][i], batch["y"][i])
            total = np.array(batch["xn"], np.int64) + np.array(batch["yn"], np.int64)
            keep = np.flatnonzero((100 + percent) * far <= (100 - percent) * total)
            yield {"a": [batch["a"][i] for i in keep], "b": [batch["b"][i] for i in keep]}
    return run


def similar_texts(texts: DataFrame, key: str = "file", text: str = "value", n: int = 5, percent: int = 80,
                  turns: int = 2) -> DataFrame:
    """Link texts whose n-gram sets have a Jaccard similarity of ``percent`` or more, and name their components.

    Works on run logs (``file``, ``value``) as they come from
    ``sources.metrics``, or on any table with a key and a text. Returns one
    row per input row: ``key``, ``n_shingles`` (size of the set) and
    ``component_id`` (smallest key reachable by links, itself included).

    Method: texts with equal sets are one class. A class is represented by
    the postings of its rarest n-grams only (rare-first prefix filter; rarity
    is a count sketch over the whole corpus, whose size is fixed). Postings
    that share a gram pass the length and the positional filter, and the
    suffix filter (counts by range of hash, more ranges for longer texts)
    before the whole sets are compared, once per pair. Pairs
    are taken in rounds: neighbours in each posting list by length and by a
    hash first, then ``turns`` times the nearest partner from another
    component, one per text. Pairs inside one component are never formed after that, so a
    large group of near copies costs links in proportion to its size. The last
    round takes every pair that is left, so no link is lost.

    Null or empty text, or text without words: size 0, linked with nothing. A
    null key: component null, linked with nothing. Repeated rows: each is
    returned, with the same component; rows of one key with several texts
    connect the components of these texts. No rows: an empty result.
    """
    spark = texts.sparkSession
    scratch = Scratch(spark)
    docs = keep_columns(texts, key, text, where="texts").select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    kind = docs.schema["_key"].dataType.simpleString()
    told = scratch.cut(map_rows(docs, _describe(n), f"key {kind}, n bigint, f1 bigint, f2 bigint, bins binary, fine binary, chunk int, counts binary"), "ngrams")
    rows = told.where("chunk is null").select("key", "n", "f1", "f2")
    shared = spark.sparkContext.broadcast(_rarity(told))
    known = told.where("chunk is null and key is not null and n > 0")
    classes = known.groupBy("n", "f1", "f2").agg(F.min("key").alias("rep"), F.any_value("bins").alias("bins"), F.any_value("fine").alias("fine"))
    copies = scratch.cut(known.select("key", "n", "f1", "f2").join(classes.drop("bins", "fine"), ["n", "f1", "f2"]).where("key <> rep").select(
        F.col("key").alias("a"), F.col("rep").alias("b")).distinct(), "copies")
    heads = scratch.cut(classes.select(F.col("rep").alias("key"), "n", "bins", "fine"), "heads")

    # texts that are surely no copy are taken at once, the others after an exact test
    hashed, shape = docs.where("_key is not null").withColumn("_hash", F.xxhash64("_key")), f"gram bigint, key {kind}, n int, place int"
    bloom = Bloom(copies.select(F.xxhash64("a")))
    doubtful = bloom.filter(hashed, F.col("_hash"), True).join(copies.select(F.col("a").alias("_key")), "_key", "left_anti")
    postings = map_rows(hashed, _prefixes(n, percent, shared, bloom), shape).union(map_rows(scratch.cut(doubtful, "doubtful"), _prefixes(n, percent, shared), shape))
    lists = scratch.cut(_shared_postings(postings, percent, shuffle_width(spark)), "postings")

    def likely(pairs: DataFrame) -> DataFrame:
        """Pairs that pass the suffix filter."""
        both = pairs.select("a", "b").join(heads.drop("bins").toDF("a", "xn", "x"), "a").join(heads.drop("bins").toDF("b", "yn", "y"), "b")
        return scratch.cut(map_rows(both.select("a", "b", "x", "y", "xn", "yn"), _suffix(percent), f"a {kind}, b {kind}"), "pairs")

    def sets_of(pairs: DataFrame) -> DataFrame:
        """Whole sets of all texts in some pair; only these texts are taken apart again."""
        ends = pairs.select(F.col("a").alias("k")).union(pairs.select("b")).distinct()
        bloom = Bloom(ends.select(F.xxhash64("k")))
        return scratch.cut(map_rows(docs.withColumn("_hash", F.xxhash64("_key")), _sets(n, bloom), f"key {kind}, grams binary"), "sets")

    def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs whose whole sets are alike; each pair comes in once."""
        whole = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
        return scratch.cut(map_rows(whole.select("a", "b", "x", "y"), _verify(percent), f"a {kind}, b {kind}"), "found")

    def across(lists: DataFrame, found: DataFrame, nearest: bool) -> DataFrame:
        """(key, other) from different components, out of the lists that hold several; long lists are dealt in blocks."""
        label = components(found).toDF("key", "c")
        own = lists.select("gram", "key", "n", "place").join(label, "key", "left").withColumn("c", F.coalesce("c", "key"))
        within = Window.partitionBy("gram")
        open_ = own.withColumns({"lo": F.min("c").over(within), "hi": F.max("c").over(within), "m": F.count(F.lit(1)).over(within)}).where("lo <> hi")
        blocks = F.ceil(F.col("m") / _LIST_BLOCK).cast("int")
        dealt = open_.withColumn("block", F.pmod(F.xxhash64("key"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).select(
            "gram", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "key", "n", "place", "c")
        rows = dealt.join(heads.select("key", "bins"), "key").select("gram", "i", "j", "block", "key", "n", "place", "c", "bins")
        placed = rows.repartition(shuffle_width(spark), "gram", "i", "j").sortWithinPartitions("gram", "i", "j")
        return map_rows(placed, _within_lists(percent, nearest), f"key {kind}, other {kind}")

    # neighbours in the lists by length and by a hash, for every text the one with most shared grams
    near = likely(_best(lists.select("key", F.col("by_size").alias("other")).union(lists.select("key", "by_hash"))))
    sets = sets_of(near)
    found = linked(near, sets)
    # then the nearest partner from another component, so that components grow together as in a spanning forest
    for _ in range(turns):
        drawn = scratch.cut(across(lists, found, True), "drawn")
        best = likely(_best(drawn))
        found = found.union(linked(best, sets_of(best)))
        # a text without a partner now has none later, when components are larger
        lists = lists.join(drawn.select("key").distinct(), "key", "left_semi")
    # then every pair that shares a gram and is not in one component yet
    rest = likely(across(lists, found, False).select(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b")).distinct())
    links = found.union(linked(rest, sets_of(rest))).union(copies)
    group = components(links).toDF("key", "component_id")
    out = rows.join(group, "key", "left")
    return scratch.finish(out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "key").alias("component_id")), "groups")


def _rarity(told: DataFrame) -> np.ndarray:
    """The sketch: how many grams fall into each of 2^SKETCH_BITS buckets, from the sums of all tasks."""
    chunks = map_rows(told.where("chunk is not null").select("chunk", "counts").repartition(8, "chunk"), _add_chunks, "chunk int, counts binary")
    rarity = np.zeros(1 << SKETCH_BITS, np.int64)
    for r in chunks.collect():
        rarity[r["chunk"] * _CHUNK:(r["chunk"] + 1) * _CHUNK] = np.frombuffer(r["counts"], "<i8")
    return rarity


def _shared_postings(postings: DataFrame, percent: int, width: int) -> DataFrame:
    """Postings whose gram another text of fitting length has too, with a neighbour by length and one by a hash."""
    by_size = Window.partitionBy("gram").orderBy("n", "key")
    listed = postings.repartition(width, "gram").withColumns({
        "before": F.lag("key").over(by_size), "before_n": F.lag("n").over(by_size), "after_n": F.lead("n").over(by_size)})
    fits = 100 * F.col("before_n") >= percent * F.col("n")
    kept = listed.where(fits | (100 * F.col("n") >= percent * F.col("after_n"))).withColumn("by_size", F.when(fits, F.col("before")))
    drawn = F.lag(F.struct("key", "n")).over(Window.partitionBy("gram").orderBy(F.xxhash64("key"), "key"))
    other = kept.withColumn("drawn", drawn)
    near = 100 * F.least(F.col("drawn.n"), F.col("n")) >= percent * F.greatest(F.col("drawn.n"), F.col("n"))
    return other.select("gram", "key", "n", "place", "by_size", F.when(near, F.col("drawn.key")).alias("by_hash"))


def _best(pairs: DataFrame) -> DataFrame:
    """Pairs (a < b): for every text the partner that comes most often, from (key, other)."""
    counted = pairs.where("other is not null and other <> key").groupBy(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b")).agg(
        F.count(F.lit(1)).alias("w"))
    sides = counted.select("w", F.inline(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))))
    best = sides.groupBy("x").agg(F.max_by("y", F.struct("w", "y")).alias("y"))
    return best.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def one_per_group(texts: DataFrame, key: str = "file", text: str = "value", n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``texts`` without near copies: of each component the row with the smallest key stays.

    Texts without words and rows without a key all stay; of rows that repeat
    one key one stays (the one whose text sorts first, then any).
    """
    groups = similar_texts(texts, key, text, n, percent)
    scratch = Scratch(texts.sparkSession)
    k, mark, count = (free_name(texts, name) for name in ("special", "dropped", "times"))
    gone = groups.where(F.col("component_id") < F.col(key)).select(F.col(key).alias(k), F.lit(True).alias(mark))
    repeated = groups.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(k)).agg(F.count(F.lit(1)).alias(count)).where(F.col(count) > 1).select(k, F.lit(False).alias(mark))
    special = scratch.cut(gone.union(repeated).groupBy(k).agg(F.max(mark).alias(mark)), "special")
    bloom = Bloom(special.select(F.xxhash64(k)))
    # only rows that may be special are moved for the exact test
    held = scratch.cut(bloom.filter(texts, F.xxhash64(F.col(key)), True).join(special, F.col(key) == F.col(k), "left"), "held")
    others = [c for c in texts.columns if c != text]
    row = F.struct(F.col(text).alias("c0"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(others, 1)])
    first = held.where(~F.col(mark)).select(F.col(key).alias("k"), row.alias("row")).groupBy("k").agg(F.min("row").alias("row")).select(
        F.col("row.c0").alias(text), *[F.col(f"row.c{i}").alias(c) for i, c in enumerate(others, 1)])
    return bloom.filter(texts, F.xxhash64(F.col(key)), False).unionByName(held.where(F.col(mark).isNull()).select(*texts.columns)).unionByName(first)
