"""Toxicity scores from confirmed examples and unlabelled text only."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from orientlake.llm.common import Scratch, fold_of, keep_columns, map_batches, map_rows, mix

SIZES = (4, 5, 6)  # characters of the runs that are features, beside whole words
_CACHE_WORDS = 200_000
_LONG = 200  # characters of a word from which on it is not remembered
_TOGETHER = 64  # texts whose words are taken apart at a time
_STEP = 1 << 15  # places of a long word that are taken at a time
_BASE = np.uint64(0x9E3779B97F4A7C15)
# Signs that stand for letters in disguised words.
_SIGNS = str.maketrans("013457@$!|", "oieastasil")
_EDGES = ".,;:!?\"'()[]{}|*#%&$@<>-_=~`"
_REPEATED = re.compile(r"(.)\1+")
_SPACED = re.compile(r"(?<!\S)\S(?:[ ]\S(?!\S)){2,}")
_NONE = np.empty(0, np.int64)


def plain(word: str) -> str:
    """A word as it is meant: lower case without accents, signs that stand for letters read as these, other signs out, repeated letters once."""
    if not (word.isascii() and word.isalpha()):
        if not any(c.isalpha() for c in word):
            return ""
        word = "".join(c for c in unicodedata.normalize("NFKD", word.strip(_EDGES).translate(_SIGNS)) if c.isalpha())
    return _REPEATED.sub(r"\1", word.lower())


def words_in(text: str) -> set[str]:
    """Distinct words of a text; letters written apart (three or more) are one word."""
    if _SPACED.search(text):
        text = _SPACED.sub(lambda m: m[0].replace(" ", ""), text)
    return set(text.lower().split())


def _keys(marked: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit keys of the runs of 4 to 6 characters in each text, and the texts they are from."""
    lens = np.array([len(m) for m in marked], np.int64)
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    owner = np.repeat(np.arange(len(marked)), lens)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(lens) - lens, lens)
    left = np.repeat(lens, lens) - place
    keys, owners = [], []
    for n in SIZES:
        at = np.flatnonzero(left >= n)
        got = np.full(len(at), n, np.uint64)
        for i in range(n):
            got = got * _BASE + codes[at + i]
        keys.append(mix(got))
        owners.append(owner[at])
    return np.concatenate(keys).view(np.int64), np.concatenate(owners)


def _whole(marked: list[str]) -> np.ndarray:
    """64-bit keys of whole words."""
    import pandas as pd

    return pd.util.hash_array(np.array(marked, dtype=object), categorize=False).view(np.int64)


def text_grams(text: str | None) -> np.ndarray:
    """Distinct features of a text's words: the words themselves between marks, and their runs of 4 to 6 characters."""
    marked = [f"^{p}$" for w in words_in(text) if (p := plain(w))] if text else []
    if not marked:
        return _NONE
    parts, some, size = [_whole(marked)], [], 0
    for m in marked:
        for i in range(0, len(m), _STEP):  # only a word of many thousand characters has several parts
            some.append(m[i:i + _STEP + SIZES[-1] - 1])
            size += len(some[-1])
            if size > _STEP:
                parts.append(np.unique(_keys(some)[0]))
                some, size = [], 0
    return np.unique(np.concatenate([*parts, _keys(some)[0]]))


class _Grams:
    """Places of the features of a text's distinct words among those of a model, remembered by word."""

    def __init__(self, grams: np.ndarray):
        self.grams, self.known = grams, {}

    def _placed(self, keys: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.grams):
            return _NONE, _NONE
        at = np.minimum(np.searchsorted(self.grams, keys), len(self.grams) - 1)
        here = np.flatnonzero(self.grams[at] == keys)
        return at[here], owners[here]

    def _learn(self, words: list[str]) -> None:
        marked = [f"^{p}$" if (p := plain(w)) else "" for w in words]
        keys, owners = _keys(marked)
        told = [i for i, m in enumerate(marked) if m]
        if told:
            keys, owners = np.concatenate([keys, _whole([marked[i] for i in told])]), np.concatenate([owners, told])
        keys, owners = self._placed(keys, owners)
        order = np.argsort(owners, kind="stable")
        ends = np.cumsum(np.bincount(owners, minlength=len(words))).tolist()
        keys, start = keys[order], 0
        for w, end in zip(words, ends):
            self.known[w] = keys[start:end].tolist() if end > start else ()
            start = end

    def _long(self, word: str) -> set[int]:
        keys = text_grams(word)
        return set(self._placed(keys, keys)[0].tolist())

    def of(self, texts: list[str | None]) -> list[set[int]]:
        """Features of each text; the new words of some texts are taken apart together."""
        out: list[set[int]] = []
        for start in range(0, len(texts), _TOGETHER):
            words = [words_in(t) if t else set() for t in texts[start:start + _TOGETHER]]
            long = [{w for w in ws if len(w) > _LONG} for ws in words]
            new = [w for w in set().union(*words).difference(*long) if w not in self.known]
            if len(self.known) + len(new) > _CACHE_WORDS:
                self.known.clear()
                new = list(set().union(*words).difference(*long))
            if new:
                self._learn(new)
            known = self.known
            for ws, ls in zip(words, long):
                found: set[int] = set()
                for got in map(known.__getitem__, ws - ls if ls else ws):
                    if got:
                        found.update(got)
                for w in ls:
                    found |= self._long(w)
                out.append(found)
        return out


@dataclass(frozen=True)
class ToxicityModel:
    """Weights, none below zero, of the sorted keys of features."""

    grams: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60.0, 60.0)))


def fit_non_negative(positive: list[np.ndarray], unlabelled: list[np.ndarray], width: int, prior: float, rounds: int = 300,
                     rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Linear classifier with the non-negative risk of positive-unlabelled learning (sigmoid loss, Adam).

    Risk: prior * loss(positive as 1) + max(0, loss(unlabelled as 0) - prior *
    loss(positive as 0)). When the second part falls below zero, the step
    climbs it again instead of overfitting the unlabelled rows. No weight goes
    below zero: nothing in a text makes up for what is toxic in it, so a toxic
    passage counts the same in a text of any length.
    """
    def flat(rows):
        lens = np.array([len(r) for r in rows], np.int64)
        return (np.concatenate(rows).astype(np.int64) if len(rows) else np.empty(0, np.int64)), np.repeat(np.arange(len(rows)), lens), len(rows)

    (pi, pr, pn), (ui, ur, un) = flat(positive), flat(unlabelled)
    w, b = np.zeros(width), 0.0
    m, v, mb, vb = np.zeros(width), np.zeros(width), 0.0, 0.0
    for t in range(1, rounds + 1):
        gp = np.bincount(pr, w[pi], pn) + b if pn else np.zeros(0)
        gu = np.bincount(ur, w[ui], un) + b if un else np.zeros(0)
        sp, su = _sigmoid(gp), _sigmoid(gu)
        # sigmoid loss of label 1 is 1 - s, of label 0 is s; both have slope s (1 - s)
        dp, du = sp * (1 - sp) / max(pn, 1), su * (1 - su) / max(un, 1)
        below = (su.mean() if un else 0.0) - prior * (sp.mean() if pn else 0.0) < 0
        if below:
            grow_p, grow_u = prior * dp, -du
        else:
            grow_p, grow_u = -2 * prior * dp, du
        g = np.bincount(pi, grow_p[pr], width) + np.bincount(ui, grow_u[ur], width) + decay * w
        gb = grow_p.sum() + grow_u.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        w = np.maximum(w - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8), 0.0)
        b = b - rate * (mb / (1 - 0.9 ** t)) / (np.sqrt(vb / (1 - 0.999 ** t)) + 1e-8)
    return w, float(b)


def _alike(text: str | None) -> int:
    """Least hash of the text's three-word runs, the same in most near copies."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    codes = _whole(words).view(np.uint64)
    n = max(len(codes) - 2, 1)
    runs = np.zeros(n, np.uint64)
    for i in range(min(3, len(codes))):
        runs = runs * _BASE + codes[i:i + n]
    return int(mix(runs).view(np.int64).min())


def _marked(batches):
    for batch in batches:
        yield {"_positive": batch["_positive"], "_text": batch["_text"], "_alike": [_alike(t) for t in batch["_text"]]}


def _collect_grams(batches):
    """In how many texts of either kind each feature stands, counted within the task."""
    held: dict[bool, list] = {True: [], False: []}
    size = {True: 0, False: 0}

    def told(positive):
        keys, n = np.unique(np.concatenate(held[positive]), return_counts=True)
        held[positive], size[positive] = [], 0
        return {"positive": [positive] * len(keys), "gram": keys, "n": n}

    for batch in batches:
        for positive, text in zip(batch["_positive"], batch["_text"]):
            held[positive].append(text_grams(text))
            size[positive] += len(held[positive][-1])
            if size[positive] > 2_000_000:
                yield told(positive)
    for positive in held:
        if size[positive]:
            yield told(positive)


def _vectors(known):
    def run(batches):
        grams = _Grams(known)
        for batch in batches:
            yield {"positive": batch["_positive"], "cells": [sorted(g) for g in grams.of(batch["_text"])]}
    return run


def fit_toxicity(texts: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 4,
                 held_out: int = 2, positives: int = 10_000, background: int = 20_000, features: int = 32_768) -> ToxicityModel:
    """Fit on confirmed toxic rows of the training folds and unlabelled rows of the same folds.

    ``positives`` and ``background`` bound the rows that are used (about so
    many, drawn by a hash of the key); of near copies in the sample one
    counts. The class prior is the toxic share of all labelled training rows;
    labels other than 1 serve for the prior only. Features are the words and
    the runs of their characters that stand in three confirmed texts or more,
    and clearly more often there than in unlabelled text (by four standard
    errors, and by a third of the ratio that a mark of toxic texts alone would
    have); ``features`` bounds their number, the surest first.

    Null keys and null labels are not used, null and empty texts have no
    features, repeated labels of a key count once (the highest). Without any
    confirmed row or any row at all the model gives 0 to every text.
    """
    marks = keep_columns(labels, key, label, where="labels").where(F.col(key).isNotNull() & F.col(label).isNotNull() & (fold_of(key, folds) != held_out))
    marks = marks.groupBy(F.col(key).alias("_mark")).agg(F.max(label).alias("_label"))
    n_all, n_toxic = marks.agg(F.count(F.lit(1)), F.count(F.when(F.col("_label") == 1, 1))).first()
    if not n_toxic:
        return ToxicityModel(_NONE, np.empty(0), -60.0, 0.0)
    prior = n_toxic / n_all
    docs = keep_columns(texts, key, text, where="texts").where(F.col(key).isNotNull() & (fold_of(key, folds) != held_out)).select(
        F.col(key).alias("_key"), F.col(text).alias("_text"))
    n_docs = docs.select("_key").count()

    def draw(name: str):
        return F.pmod(F.xxhash64(F.col(name), F.lit("toxicity")), F.lit(1 << 30)) / F.lit(float(1 << 30))

    sure = marks.where(F.col("_label") == 1).where(draw("_mark") < positives / n_toxic).select(F.col("_mark").alias("_sure"))
    # at most about `positives` keys are broadcast
    both = docs.withColumn("_u", draw("_key") < background / max(n_docs, 1)).join(F.broadcast(sure), F.col("_key") == F.col("_sure"), "left").where(
        F.col("_u") | F.col("_sure").isNotNull()).select("_text", F.explode(F.array_compact(F.array(
            F.when(F.col("_sure").isNotNull(), F.lit(True)), F.when(F.col("_u"), F.lit(False))))).alias("_positive"))
    scratch = Scratch(texts.sparkSession)
    sample = scratch.cut(map_rows(both, _marked, "_positive boolean, _text string, _alike bigint").groupBy("_positive", "_alike").agg(F.min("_text").alias("_text")).drop("_alike"), "sample")
    n = {r[0]: r[1] for r in sample.groupBy("_positive").count().collect()}
    n_pos, n_un = n.get(True, 0), n.get(False, 0)
    if not n_pos or not n_un:
        scratch.clear()
        return ToxicityModel(_NONE, np.empty(0), -60.0 if not n_pos else 0.0, prior)
    counted = map_rows(sample, _collect_grams, "positive boolean, gram bigint, n bigint").groupBy("gram").agg(
        F.sum(F.when(F.col("positive"), F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(~F.col("positive"), F.col("n")).otherwise(0)).alias("u"))
    rate_p, rate_u = F.col("p") / n_pos, (F.col("u") + 1) / (n_un + 1)
    z = (rate_p - rate_u) / F.sqrt(rate_u * (1 - F.least(rate_u, F.lit(0.999))) / n_pos)
    clear = rate_p >= rate_u * (1 + (1 / prior - 1) / 3)
    best = counted.where("p >= 3").withColumn("z", z).where(clear & (F.col("z") >= 4)).orderBy(F.desc("z"), "gram").limit(features).select("gram").collect()
    grams = np.array(sorted(r[0] for r in best), np.int64)
    cells = map_rows(sample, _vectors(grams), "positive boolean, cells array<int>").collect()
    scratch.clear()
    rows = {flag: sorted((np.array(r["cells"], np.int64) for r in cells if r["positive"] is flag), key=lambda a: a.tobytes()) for flag in (True, False)}
    weights, bias = fit_non_negative(rows[True], rows[False], len(grams), prior)
    used = np.flatnonzero(weights > 0)
    return ToxicityModel(grams[used], weights[used], bias, prior)


def _score(model: ToxicityModel, grams: _Grams, texts: list[str | None]) -> list[float]:
    sums = [model.weights[sorted(found)].sum() if found else 0.0 for found in grams.of(texts)]
    return _sigmoid(model.bias + np.array(sums, float)).tolist()


def _scores(model: ToxicityModel):
    def run(batches):
        grams = _Grams(model.grams)
        for batch in batches:
            yield {"_key": batch["_key"], "score": _score(model, grams, batch["_text"])}
    return run


def score_toxicity(texts: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text", threshold: float = 0.3,
                   folds: int = 4, held_out: int = 2) -> DataFrame:
    """Score every whole text: ``key``, ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on).

    General: the particle records hold no human writing, so key and text have
    neutral names. Only the text enters a score: the weights of the features
    of its distinct words, all of them, add up, and none is below zero. Words
    are read without accents, disguising signs and repeated letters. Null and empty
    texts get the score of a text without known grams. Null keys and repeated
    rows are scored like any row. No rows: an empty result.
    """
    rows = keep_columns(texts, key, text, where="texts").select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    kind = rows.schema["_key"].dataType.simpleString()
    scored = map_rows(rows, _scores(model), f"_key {kind}, score double").withColumnRenamed("_key", key)
    return scored.select(key, (fold_of(key, folds) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(texts: DataFrame, model: ToxicityModel, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``texts`` whose score is under ``threshold``, with all their columns, without a shuffle.

    Null and empty texts are judged as texts without known features, repeated
    rows each. No rows: an empty result.
    """
    def run(batches):
        grams = _Grams(model.grams)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text)).to_pylist()
            yield batch.filter(pa.array([x < threshold for x in _score(model, grams, column)], pa.bool_()))

    return map_batches(texts, run, texts.schema)
