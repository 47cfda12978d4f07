"""Whole sets of long texts are moved only for pairs that may be alike."""

import random

import numpy as np

from orientlake.llm import common, ngram_join


def test_long_texts_not_alike_are_told_apart_before_their_sets_are_moved(spark, monkeypatch):
    rnd = random.Random(5)
    common_part = [f"w{rnd.randrange(10 ** 6)}" for _ in range(7300)]  # four fifths of each: seven tenths of all
    texts = [(i, " ".join(common_part + [f"x{rnd.randrange(10 ** 6)}" for _ in range(1700)])) for i in range(2)]
    base = [f"v{rnd.randrange(10 ** 6)}" for _ in range(4000)]  # one of these is above a border of ranges, one below
    texts += [(10, " ".join(base)), (11, " ".join(base + [f"u{i}" for i in range(300)]))]
    moved, cut = [], common.Scratch.cut

    def counted(self, df, label):
        out = cut(self, df, label)
        if label == "pairs":
            moved.extend((r["a"], r["b"]) for r in out.collect())
        return out
    monkeypatch.setattr(common.Scratch, "cut", counted)
    got = {r["file"]: r["component_id"] for r in ngram_join.similar_texts(spark.createDataFrame(texts, "file bigint, value string")).collect()}
    assert got == {0: 0, 1: 1, 10: 10, 11: 10}
    assert set(moved) == {(10, 11)}


def test_counts_by_range_never_differ_more_than_the_sets():
    rnd = np.random.default_rng(3)
    for n, other in ((300, 300), (4000, 4200), (9000, 20000), (70000, 66000)):
        pool = rnd.integers(0, 1 << 63, 2 * max(n, other), dtype=np.uint64)
        pool[: len(pool) // 3] &= np.uint64(0xFFFFFFFFFFFC03FF)  # crowded ranges, counted to 255 only
        pool = np.unique(pool)
        x, y = (np.unique(rnd.choice(pool, k)) for k in (n, other))
        apart = len(np.setxor1d(x, y))
        for a in (256, 1024, 16384):
            for b in (256, 2048):
                assert ngram_join._apart(ngram_join._bins(x, a), ngram_join._bins(y, b)) <= apart
