"""The lattice model is fitted to all training words, and many words at once count like single ones."""

import math
from collections import Counter

from orientlake.llm import lattice_lm
from orientlake.llm.common import Scratch

PIECES = [f"\x00{b:02X}" for b in range(256)] + ["▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab", "c" * 5]


def test_every_round_reads_all_training_words(spark):
    texts = spark.createDataFrame([("ab ab ab abc bc", True), ("ccccc cab é bca", True), ("abcabc", False), (None, True)], "_text string, _train boolean")
    models = [lattice_lm.fit_text_model(texts, PIECES, Scratch(spark), frequent) for frequent in (1000, 1, 0)]
    assert len({len(m.frequent) for m in models}) == 3
    scores = [{r["word"]: (r["n"], r["score"]) for r in m.words.collect()} for m in models]
    for got in scores[1:]:
        assert got.keys() == scores[0].keys()
        for word, (n, score) in got.items():
            assert n == scores[0][word][0] and math.isclose(score, scores[0][word][1], rel_tol=1e-9)


def test_words_together_count_like_single_ones():
    score = lattice_lm._weights({p: 1e6 / (i + 10) for i, p in enumerate(PIECES)}, PIECES, 1000, 0.1)
    lattice = lattice_lm.Lattice(score)
    words = ["ab", "", "abcab", "ccccccc", "é漢\x00a", "\ud800b", "abc" * 21, "abc" * 30, "c" * 63, "c" * 64, "\U0001F600"]
    counts = [float(i + 1) for i in range(len(words))]
    assert all(math.isclose(x, lattice.word(w), rel_tol=1e-12) for x, w in zip(lattice.words(words), words))
    want, got = Counter(), Counter()
    for w, n in zip(words, counts):
        lattice.expected(w, n, want)
    lattice.expected_all(words, counts, got)
    assert got.keys() == want.keys() and all(math.isclose(got[p], want[p], rel_tol=1e-9) for p in want)
    assert lattice.words([]).tolist() == []
