"""Token alignment against spans found on whole texts without any cuts."""

import hashlib
import random
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from orientlake.llm import token_alignment
from orientlake.llm.common import Scratch
from orientlake.llm.queries import QUERIES, table

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def brute():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(x): x for x in visible}
    letters |= {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in visible)}

    def ranges(parts):
        at, out = 0, []
        for p in parts:
            out.append((at, at + len(p)))
            at += len(p)
        return out

    def run(texts):
        """Per text: ids, byte ranges and groups; then counts over all of them."""
        found = []
        for text in texts:
            want = f" {text}".encode()
            ids_a, ids_b = a.encode(f" {text}", add_special_tokens=False).ids if text else [], b.encode(text) if text else []
            parts_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
            parts_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
            if not text or b"".join(parts_a) != want or b"".join(parts_b) != want:
                found.append(None)
                continue
            ra, rb = ranges(parts_a), ranges(parts_b)
            cuts = sorted({e for _, e in ra} & {e for _, e in rb})
            sides = []
            for ids, places in ((ids_a, ra), (ids_b, rb)):
                inside = defaultdict(list)
                for i, (_, e) in zip(ids, places):
                    inside[bisect_left(cuts, e)].append(str(i))
                sides.append(inside)
            groups = [",".join(sides[0][k]) + "|" + ",".join(sides[1][k]) for k in range(len(cuts))]
            starts = [t for t, _ in rb]
            links = [(x, ids_b[k]) for x, (s, e) in zip(ids_a, ra) for k in range(bisect_right(starts, s) - 1, bisect_left(starts, e))]
            found.append((len(ids_a), len(ids_b), groups, links))
        counts = Counter(p for f in found if f for p in f[3])
        top = defaultdict(int)
        for (_, y), n in counts.items():
            top[y] = max(top[y], n)
        return [(0,) * 6 + ("",) if f is None else (f[0], f[1], len(f[2]), len(f[3]), sum(counts[p] == top[p[1]] for p in f[3]), sum(counts[p] for p in f[3]),
                                                    hashlib.sha256(";".join(f[2]).encode()).hexdigest()) for f in found]
    return run


TEXTS = [None, "", " ", "  two  blanks ", "a▁b", "plain words here.", "plain words here.", "Straße über 中文 \U0001f600\U0001f600 ẞ́ naïve", "\n\nlines\r\n\tand\ttabs  end \n",
         "<|endoftext|> <s> </s> <unk> <0x41> [INST]", "it's we'll I'M 12345 3.14 ...!!!??", "x" * 3000, "あいう" * 400, " nbsp   em ​ zero", "ﬁ Å é",
         "\U00010348\U0001f9d1‍\U0001f680 ไทย", "a \x00 b \x1c c"]


def results(spark, rows, **names):
    aligned = token_alignment.align_texts(spark.createDataFrame(rows, "file bigint, value string").withColumns({c: F.lit(1) for c in ("row", "links", "_key", "n_a")}), A, B)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    width = sentencepiece.SentencePieceProcessor(model_file=B).get_piece_size()
    return token_alignment.score_links(aligned.withColumn("sha", digest).drop("groups"), width, Scratch(spark), **names).select(
        "file", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "sha")


@pytest.mark.parametrize("most", [1 << 21, 60])
def test_alignment_equals_brute_force(spark, brute, most):
    rnd = random.Random(1)
    letters = "abcdefg hij klm .,;'\n\t éü中क्ष\U0001f600▁<>0123456789"
    texts = TEXTS + ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 120))) for _ in range(150)]
    got = results(spark, list(enumerate(texts)), most_sent=most).collect()
    assert {r["file"]: tuple(r)[1:] for r in got} == dict(enumerate(brute(texts)))


def test_alignment_edges(spark, brute):
    assert results(spark, []).collect() == []
    assert [tuple(r) for r in results(spark, [(None, "same"), (None, "same")]).collect()] == [(None, *brute(["same", "same"])[0])] * 2
    assert {tuple(r)[1:] for r in results(spark, [(1, None), (2, "")]).collect()} == {(0,) * 6 + ("",)}


def test_words_are_forgotten_and_aligned_again(monkeypatch, brute):
    monkeypatch.setattr(token_alignment, "_CACHE_WORDS", 3)
    monkeypatch.setattr(token_alignment, "_TOGETHER", 1)
    aligner = token_alignment.TokenAligner(A, B)
    texts = ("one two three four five six", "one two one two", "six five été four")
    for text, (n_a, n_b, n_groups, groups, links) in zip(texts, aligner.texts(list(texts))):
        assert (n_a, n_b, n_groups, hashlib.sha256(groups.encode()).hexdigest()) == tuple(brute([text])[0][i] for i in (0, 1, 2, 6))
        assert len(links) // 4 == brute([text])[0][3]


def test_spans_are_refined_by_decoded_bytes():
    # one character of four bytes in two tokens that both claim it, then a plain one
    ends = token_alignment.byte_ends(np.array([0, 0, 4]), np.array([4, 4, 5]), np.array([3, 1, 1]))
    assert ends.tolist() == [3, 4, 5]
    one, two, cuts = token_alignment.overlaps(np.array([2, 3, 6]), np.array([3, 6]))
    assert list(zip(one, two)) == [(0, 0), (1, 0), (2, 1)] and cuts.tolist() == [3, 6]


def test_query(spark, brute):
    rows = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    want = {k: v for (k, _), v in zip(rows, brute([t for _, t in rows]))}
    assert {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op11_token_alignment"](spark, SF).collect()} == want
