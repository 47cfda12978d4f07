"""Scores of texts under a subword unigram model that sums over all segmentations."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, functions as F

from orientlake.llm.common import Scratch, fold_of, keep_columns, map_rows, words_of
from orientlake.session import shuffle_width

MARK = "▁"  # stands before the first letter of a word in the vocabulary
END = "\x00end"  # the piece that closes a text
_FLUSH_WORDS = 400_000
_SHORT = 64  # words of so many letters are taken together, place by place; longer ones singly
_TOGETHER = 16_384
_NEVER = -math.inf
ROUNDS = 4  # of expectation, each over all training words


def load_pieces(model_file: str) -> list[str]:
    """Pieces of a sentencepiece vocabulary in its own order, byte pieces as ``\\x00`` and two digits."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    out = []
    for i in range(model.get_piece_size()):
        if model.is_byte(i):
            out.append("\x00" + model.id_to_piece(i)[3:5])
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            out.append(model.id_to_piece(i))
    return out


def _log_add(x: float, y: float) -> float:
    """Log of the sum of two numbers given by their logs."""
    if x == _NEVER:
        return y
    return x + math.log1p(math.exp(y - x)) if x > y else y + math.log1p(math.exp(x - y))


class _Tree:
    """Pieces as a tree of letters in a hash table of arrays, so that the edges of many words are found at once."""

    def __init__(self, pieces: list[str]):
        self.names = pieces
        self.longest = max(map(len, pieces), default=1)
        steps: dict[int, int] = {}
        ends = [-1]
        for k, piece in enumerate(pieces):
            node = 0
            for c in piece:
                node = steps.setdefault(node << 21 | ord(c), len(ends))
                if node == len(ends):
                    ends.append(-1)
            ends[node] = k
        self.piece = np.array(ends)
        self.bits = max(4, len(steps).bit_length() + 2)
        self.key = np.full(1 << self.bits, -1, np.int64)
        self.node = np.full(1 << self.bits, -1, np.int64)
        keys, nodes = np.fromiter(steps, np.int64, len(steps)), np.fromiter(steps.values(), np.int64, len(steps))
        slot = self._slot(keys)
        while len(keys):
            free = self.key[slot] < 0
            self.key[slot[free]], self.node[slot[free]] = keys[free], nodes[free]
            left = self.key[slot] != keys
            keys, nodes, slot = keys[left], nodes[left], slot[left] + 1 & (1 << self.bits) - 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def child(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The node below ``node`` by a letter, -1 where there is none."""
        key = node << 21 | letter
        slot = self._slot(key)
        found = self.key[slot]
        out = np.where(found == key, self.node[slot], -1)
        away = np.flatnonzero((found != key) & (found >= 0))
        while len(away):
            slot[away] = slot[away] + 1 & (1 << self.bits) - 1
            found = self.key[slot[away]]
            same = found == key[away]
            out[away[same]] = self.node[slot[away[same]]]
            away = away[~same & (found >= 0)]
        return out

    def edges(self, letters: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, length, piece) of all pieces in a row of words; ``left`` letters of its word stand from a place on.

        Where a letter is no piece, the edge's piece is ~letter.
        """
        at, node = np.arange(len(letters)), np.zeros(len(letters), np.int64)
        places, lengths, pieces = [], [], []
        spelled = np.ones(len(letters), bool)
        for d in range(self.longest):
            inside = left[at] > d
            at, node = at[inside], node[inside]
            node = self.child(node, letters[at + d])
            at, node = at[node >= 0], node[node >= 0]
            if not len(at):
                break
            piece = self.piece[node]
            places.append(at[piece >= 0])
            lengths.append(np.full(len(places[-1]), d + 1))
            pieces.append(piece[piece >= 0])
            if d == 0:
                spelled[places[-1]] = False
        at = np.flatnonzero(spelled)
        return np.concatenate([*places, at]), np.concatenate([*lengths, np.ones(len(at), np.int64)]), np.concatenate([*pieces, ~letters[at]])


def _groups(key: np.ndarray) -> list[np.ndarray]:
    """Places of equal keys, by key."""
    order = np.argsort(key, kind="stable")
    return np.split(order, np.cumsum(np.bincount(key))[:-1]) if len(key) else []


@dataclass
class Lattice:
    """Log scores of pieces, and the sums over all ways to cut a word into them."""

    score: dict[str, float]

    def __post_init__(self):
        self.longest = max((len(p) for p in self.score if p[0] != "\x00"), default=1)
        self.stems = {p[:i] for p in self.score if p[0] != "\x00" for i in range(1, len(p) + 1)}
        self.bytes = [self.score[f"\x00{b:02X}"] for b in range(256)]

    def spelled(self, char: str) -> list[int]:
        return list(char.encode("utf-8", "surrogatepass"))

    def edges(self, text: str) -> list[list[tuple[int, str | None, float]]]:
        """Per place (end, piece, log score) of all pieces that start there; bytes where the letter itself is no piece."""
        score, stems, out = self.score, self.stems, []
        for at in range(len(text)):
            here = []
            for end in range(at + 1, min(len(text), at + self.longest) + 1):
                piece = text[at:end]
                if piece not in stems:
                    break
                s = score.get(piece)
                if s is not None:
                    here.append((end, piece, s))
            if not here or here[0][0] > at + 1:
                here.append((at + 1, None, sum(self.bytes[b] for b in self.spelled(text[at]))))
            out.append(here)
        return out

    def forward(self, edges: list[list[tuple[int, str | None, float]]]) -> list[float]:
        """Log of the summed scores of all segmentations of every prefix."""
        alpha = [_NEVER] * (len(edges) + 1)
        alpha[0] = 0.0
        for at, found in enumerate(edges):
            a = alpha[at]
            for end, _, s in found:
                alpha[end] = _log_add(alpha[end], a + s)
        return alpha

    def word(self, word: str) -> float:
        """Natural log of a word's probability."""
        return self.forward(self.edges(MARK + word))[-1]

    @cached_property
    def _tree(self) -> _Tree:
        return _Tree([p for p in self.score if p[0] != "\x00"])

    @cached_property
    def _piece_scores(self) -> np.ndarray:
        return np.array([self.score[p] for p in self._tree.names])

    def _laid_out(self, words: list[str]):
        """All words of a list side by side, each with a place before every letter and one behind it.

        Returns the first and last place of every word, and of every edge the
        word, the places it joins, its piece and its score.
        """
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        letters = np.frombuffer("".join([MARK + w for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        stop = np.cumsum(size)
        of = np.repeat(np.arange(len(words)), size)
        at, length, piece = self._tree.edges(letters, stop[of] - np.arange(len(letters)))
        word = of[at]
        score = np.empty(len(at))
        known = piece >= 0
        score[known] = self._piece_scores[piece[known]]
        rare, which = np.unique(piece[~known], return_inverse=True)
        score[~known] = np.array([sum(self.bytes[b] for b in self.spelled(chr(~c))) for c in rare.tolist()], float)[which]
        last = stop + np.arange(len(words))
        return last - size, last, word, at + word, at + word + length, piece, score

    def _forward_all(self, first, last, word, start, end, score) -> np.ndarray:
        alpha = np.full(last[-1] + 1, _NEVER)
        alpha[first] = 0.0
        for own in _groups(start - first[word]):  # edges from one place of a word end at different ones
            to = end[own]
            alpha[to] = np.logaddexp(alpha[to], alpha[start[own]] + score[own])
        return alpha

    def words(self, words: list[str]) -> np.ndarray:
        """``word`` of all words of a list."""
        out = np.empty(len(words))
        short = np.array([i for i, w in enumerate(words) if len(w) < _SHORT], np.int64)
        for i in range(0, len(short), _TOGETHER):
            part = short[i:i + _TOGETHER]
            first, last, word, start, end, _, score = self._laid_out([words[k] for k in part])
            out[part] = self._forward_all(first, last, word, start, end, score)[last]
        for i, w in enumerate(words):
            if len(w) >= _SHORT:
                out[i] = self.word(w)
        return out

    def expected_all(self, words: list[str], counts: list[float], into: Counter) -> None:
        """``expected`` of all words of a list."""
        short = [i for i, w in enumerate(words) if len(w) < _SHORT]
        for i in range(0, len(short), _TOGETHER):
            part = short[i:i + _TOGETHER]
            first, last, word, start, end, piece, score = self._laid_out([words[k] for k in part])
            alpha = self._forward_all(first, last, word, start, end, score)
            beta = np.full(len(alpha), _NEVER)
            beta[last] = 0.0
            for own in reversed(_groups(end - first[word])):  # edges to one place of a word begin at different ones
                at = start[own]
                beta[at] = np.logaddexp(beta[at], beta[end[own]] + score[own])
            share = np.array([counts[k] for k in part], float)[word] * np.exp(alpha[start] + score + beta[end] - alpha[last][word])
            known = piece >= 0
            sums = np.bincount(piece[known], share[known], len(self._tree.names))
            for k in np.flatnonzero(sums).tolist():
                into[self._tree.names[k]] += float(sums[k])
            rare, which = np.unique(piece[~known], return_inverse=True)
            for c, n in zip(rare.tolist(), np.bincount(which, share[~known], len(rare)).tolist()):
                for b in self.spelled(chr(~c)):
                    into[f"\x00{b:02X}"] += n
        for w, n in zip(words, counts):
            if len(w) >= _SHORT:
                self.expected(w, n, into)

    def expected(self, word: str, count: float, into: Counter) -> None:
        """Add to ``into`` how often each piece is expected in ``count`` occurrences of a word."""
        text = MARK + word
        edges = self.edges(text)
        alpha = self.forward(edges)
        beta = [_NEVER] * (len(text) + 1)
        beta[-1] = 0.0
        for at in range(len(text) - 1, -1, -1):
            for end, _, s in edges[at]:
                beta[at] = _log_add(beta[at], beta[end] + s)
        for at, found in enumerate(edges):
            for end, piece, s in found:
                share = count * math.exp(alpha[at] + s + beta[end] - alpha[-1])
                if piece is not None:
                    into[piece] += share
                else:
                    for b in self.spelled(text[at]):
                        into[f"\x00{b:02X}"] += share


def _count_words(batches):
    """Words of all texts with their number in training texts, counted inside the task."""
    held: dict[bool, Counter] = {True: Counter(), False: Counter()}

    def told():
        for train, counts in held.items():
            yield {"word": [w.decode("utf-8", "surrogatepass") for w in counts], "n": list(counts.values()) if train else [0] * len(counts)}
            counts.clear()

    for batch in batches:
        for train, text in zip(batch["_train"], batch["_text"]):
            held[train].update(words_of(text))
        if sum(map(len, held.values())) > _FLUSH_WORDS:
            yield from told()
    yield from told()


def _expect(scores):
    def run(batches):
        lattice, into = Lattice(scores.value), Counter()
        for batch in batches:
            lattice.expected_all(batch["word"], batch["n"], into)
        yield {"piece": list(into), "n": list(into.values())}
    return run


def _score_words(scores):
    def run(batches):
        lattice = Lattice(scores.value)
        for batch in batches:
            yield {"word": batch["word"], "n": batch["n"], "score": (lattice.words(batch["word"]) / math.log(10)).tolist()}
    return run


def _weights(counts: dict[str, float], pieces: list[str], ends: int, smooth: float) -> dict[str, float]:
    """Log scores from expected counts; every piece keeps a small share, so every text has a score."""
    total = sum(counts.values()) + ends + smooth * (len(pieces) + 1)
    out = {p: math.log((counts.get(p, 0.0) + smooth) / total) for p in pieces}
    out[END] = math.log((ends + smooth) / total)
    return out


@dataclass(frozen=True)
class TextModel:
    """A table of all words with training count and score, the frequent ones of it, and the totals of the training texts."""

    words: DataFrame
    frequent: dict[bytes, tuple[float, float]]
    tokens: int
    distinct: int
    ends: int
    end_score: float


def fit_text_model(texts: DataFrame, pieces: list[str], scratch: Scratch, frequent: int = 100_000, smooth: float = 0.1) -> TextModel:
    """Learn piece scores and word counts from the rows of (``_text``, ``_train``) that are for training; score the words of all rows.

    The vocabulary is given. Its order gives first scores (the share of a
    piece falls with its rank); four rounds of expectation over all words of
    the training texts follow. ``frequent`` bounds the words that every task
    gets; all others are found by a join.

    Null and empty texts count as an end only, repeated rows each. No rows for
    training: uniform scores, no counts.
    """
    spark = texts.sparkSession
    counted = map_rows(texts.select("_text", "_train"), _count_words, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    words = scratch.cut(counted, "words")
    distinct, tokens = words.where("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    ends = texts.where("_train").count()
    ranks = {p: 1.0 / (i + 10) for i, p in enumerate(pieces)}
    scale = sum(ranks.values())
    scores = _weights({p: 1e6 * r / scale for p, r in ranks.items()}, pieces, 1000, smooth)
    head = scratch.cut(_most_frequent(words.where("n > 0"), frequent), "head")
    for _ in range(ROUNDS):
        sent = spark.sparkContext.broadcast(scores)
        got = map_rows(words.where("n > 0"), _expect(sent), "piece string, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()  # at most one row per piece
        scores = _weights({r["piece"]: r["n"] for r in got}, pieces, ends, smooth)
    sent = spark.sparkContext.broadcast(scores)
    shape = "word string, n bigint, score double"
    common = {r["word"].encode("utf-8", "surrogatepass"): (math.log10(r["n"] + 1), r["score"])
              for r in map_rows(head, _score_words(sent), shape).toLocalIterator()}
    scored = scratch.cut(map_rows(words, _score_words(sent), shape), "scored-words")
    return TextModel(scored, common, int(tokens), int(distinct), int(ends), scores[END] / math.log(10))


def _most_frequent(words: DataFrame, most: int) -> DataFrame:
    """At most ``most`` words: whole bands of counts from the top. The bands' sizes, a few thousand at most, come to the driver."""
    band = F.floor(64 * F.log2("n"))
    left, lowest = most, None
    for r in words.groupBy(band.alias("band")).count().orderBy(F.desc("band")).collect():
        left -= r["count"]
        if left < 0:
            break
        lowest = r["band"]
    kept = words.where(band >= lowest) if lowest is not None else words.where("false")
    return kept.repartition(shuffle_width(words.sparkSession), "word")


def _score_texts(frequent, ends: int, end_score: float):
    """Per text the sums over its frequent words and its end; per other word a row that asks for its count and score."""
    def run(batches):
        known = frequent.value
        names = ("n_tokens", "n_known", "base", "score")
        for batch in batches:
            out = {"row": [], "key": [], **{c: [] for c in names}, "word": [], "n": []}
            for row, key, text in zip(batch["_row"], batch["_key"], batch["_text"]):
                tokens, sure, base, score = 1, int(ends > 0), math.log10(ends + 1), end_score
                rare = []
                for w, n in Counter(words_of(text)).items():
                    tokens += n
                    got = known.get(w)
                    if got is None:
                        rare.append((w, n))
                    else:
                        sure += n
                        base += n * got[0]
                        score += n * got[1]
                for name, value in zip(out, (row, key, tokens, sure, base, score, None, None)):
                    out[name].append(value)
                out["row"] += [row] * len(rare)
                for name in ("key", *names):
                    out[name] += [None] * len(rare)
                out["word"] += [w.decode("utf-8", "surrogatepass") for w, _ in rare]
                out["n"] += [n for _, n in rare]
            yield out
    return run


def score_texts(texts: DataFrame, model_file: str, key: str = "file", text: str = "value", folds: int = 7, held_out: int = 2,
                frequent: int = 100_000, smooth: float = 0.1) -> DataFrame:
    """Log10 probability of every whole text under a unigram model over subword pieces.

    Takes run logs (``file``, ``value``) or any table with a key and a text.
    Learns from rows whose crc32 of the key, modulo ``folds``, is not
    ``held_out``. Returns ``key``, ``held_out``, ``n_tokens`` (words and one
    end), ``n_known``, ``train_tokens``, ``base_score`` (add-one word model)
    and ``score``: a word's probability is the sum over all its segmentations
    into pieces of the vocabulary (log-space forward recursion), a text's the
    product over its words and its end.

    The vocabulary's file has merge ranks, not probabilities; they start the
    scores, which are then fitted to the training words. Words that are not
    among the ``frequent`` ones are joined with their counts; none of these
    can be frequent, so the join has no hot key.

    Null and empty texts: the end alone. Null keys have fold 0; repeated rows
    are scored each. No rows: an empty result. No training rows: uniform
    scores, no known words.
    """
    spark = texts.sparkSession
    scratch = Scratch(spark)
    rows = keep_columns(texts, key, text, where="texts").select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    model = fit_text_model(rows.select("_text", (fold_of("_key", folds) != held_out).alias("_train")), load_pieces(model_file), scratch, frequent, smooth)
    kind = rows.schema["_key"].dataType.simpleString()
    sc = spark.sparkContext
    # a row's number holds inside the table written here, and nowhere else
    numbered = rows.withColumn("_row", F.monotonically_increasing_id())
    told = scratch.cut(map_rows(numbered, _score_texts(sc.broadcast(model.frequent), model.ends, model.end_score),
                                f"row bigint, key {kind}, n_tokens bigint, n_known bigint, base double, score double, word string, n bigint"), "scored")
    own = told.where("n_tokens is not null").drop("word", "n")
    asked = told.where("word is not null").select("row", "word", "n").join(model.words.toDF("word", "c", "s"), "word")
    more = asked.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more_known"),
                                    F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("more_base"), F.sum(F.col("n") * F.col("s")).alias("more_score"))
    n = model.tokens + model.ends
    v = model.distinct + (1 if model.ends else 0)
    out = own.join(more, "row", "left").select(
        F.col("key").alias(key), (fold_of("key", folds) == held_out).alias("held_out"), "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0)) - F.col("n_tokens") * F.lit(math.log10(n + v + 1))).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"))
    return scratch.finish(out, "scores")
