"""Language of a text from a table of n-grams whose bits are languages."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from orientlake.llm.common import Scratch, keep_columns, map_rows, mix

NONE = "und"  # no text, or no letter in it
SLICE_BYTES = 1 << 24  # of a filter that one task holds at a time
PROBES = 3  # slots of an n-gram
FALSE_RATE = 0.01  # of the language with most n-grams
_CACHE_WORDS = 100_000
_FLUSH_WORDS = 200_000
_EDGES = ".,;:!?\"'()[]{}|*#%<>«»„“”-_=~`0123456789"


def _core(word: str) -> str:
    """The word between its edges; empty when no letter is in it."""
    core = word.strip(_EDGES)
    return core if any(c.isalpha() for c in core) else ""


def _keys(texts: list[str], sizes=(2, 3, 4), starts: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """64-bit keys of all runs of 2 to 4 characters inside each text (of the first ``starts`` places), and the texts they are from."""
    lens = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    owner = np.repeat(np.arange(len(texts)), lens)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(lens) - lens, lens)
    left = np.repeat(lens, lens) - place
    if starts is not None:
        left[place >= starts] = 0
    codes = np.concatenate([codes, np.zeros(3, np.uint64)])
    keys, owners = [], []
    for n in sizes:
        at = np.flatnonzero(left >= n)
        got = codes[at]
        for i in range(1, min(n, 3)):
            got |= codes[at + i] << np.uint64(21 * i)
        # three characters fit the 63 bits, the fourth is spread over all
        got = mix(got)
        keys.append(mix(got + codes[at + 3] * np.uint64(0x9E3779B97F4A7C15)) if n == 4 else got)
        owners.append(owner[at])
    return np.concatenate(keys).view(np.int64), np.concatenate(owners)


def _is_long(word: str) -> bool:
    """Words that are not remembered, such as sentences of a script without blanks."""
    return len(word) > 60


def _long_keys(word: str, step: int = 1 << 16) -> Iterator[np.ndarray]:
    """Keys of all n-grams of one long word, some at a time."""
    core = _core(word)
    marked = f" {core} " if core else ""
    for i in range(0, len(marked), step):
        yield _keys([marked[i:i + step + 3]], starts=step)[0]


def _word_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the n-grams of many words, and the place of the word of each."""
    cores = [_core(w) for w in words]
    return _keys([f" {c} " if c else "" for c in cores])


def _slice_of(keys: np.ndarray, slices: int) -> np.ndarray:
    return ((mix(keys.view(np.uint64) + np.uint64(0x5851F42D4C957F2D)) >> np.uint64(33)) % np.uint64(slices)).astype(np.int64)


def _slots(keys: np.ndarray, slots: int) -> Iterator[np.ndarray]:
    """The slots of each n-gram inside its slice."""
    low, high = keys.view(np.uint64) & np.uint64(0xFFFFFFFF), keys.view(np.uint64) >> np.uint64(32) | np.uint64(1)
    for i in range(PROBES):
        yield (mix(low + np.uint64(i) * high) % np.uint64(slots)).astype(np.int64)


@dataclass(frozen=True)
class LanguageModel:
    """Bit-sliced Bloom filters of all languages' n-grams: a slot holds one bit per language, in ``words`` 64-bit words.

    ``slots`` of each of ``slices`` slices follow from the counted n-grams.
    ``parts`` (slice, bits) stays in the folder of ``spark.checkpoint.dir`` for
    as long as the model is wanted. ``false_rate`` is measured: the share of
    slots that a language has set, to the power of ``PROBES``.
    """

    languages: list[str]
    words: int
    slots: int
    slices: int
    false_rate: np.ndarray
    usual: int
    parts: DataFrame | None = None

    def part(self, number: int) -> np.ndarray:
        """One slice: slots by words."""
        raw = self.parts.where(F.col("slice") == number).select("bits").first()
        return np.frombuffer(raw[0], "<u8").reshape(self.slots, self.words) if raw else np.zeros((self.slots, self.words), np.uint64)

    def languages_of(self, grams: list[str]) -> np.ndarray:
        """Rows of 0 and 1: which languages may have each n-gram (2 to 4 characters); they surely have all of theirs."""
        keys = np.array([_keys([g], sizes=(len(g),))[0][0] for g in grams], np.int64)
        out, of = np.zeros((len(grams), len(self.languages)), np.int64), _slice_of(keys, self.slices)
        for i in range(self.slices):
            mine = np.flatnonzero(of == i)
            out[mine] = _bits(_masks(self.part(i), keys[mine]), len(self.languages))
        return out


def _masks(part: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """All languages that may have each n-gram at once: what its slots have in common."""
    out = None
    for at in _slots(keys, len(part)):
        out = part[at] if out is None else out & part[at]
    return out


def _bits(masks: np.ndarray, languages: int) -> np.ndarray:
    return np.stack([(masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1) for i in range(languages)], 1).astype(np.int64)


def _count(batches):
    """n-grams of the training words per language, counted inside the task."""
    held: dict[int, Counter] = {}

    def summed(number, keys, counts):
        grams, at = np.unique(keys, return_inverse=True)
        n = np.bincount(at, counts, len(grams)).astype(np.int64)
        return {"lang": np.full(len(grams), number), "gram": grams, "n": n}

    def told(number, words):
        keys, owners = _word_keys(list(words))
        return summed(number, keys, np.fromiter(words.values(), np.float64, len(words))[owners])

    for batch in batches:
        for number, text in zip(batch["_lang"], batch["_text"]):
            if text:
                words = text.lower().split()
                long = [w for w in words if _is_long(w)]
                held.setdefault(number, Counter()).update(w for w in words if not _is_long(w))
                for w in long:
                    for keys in _long_keys(w):
                        yield summed(number, keys, np.ones(len(keys)))
        for number, words in held.items():
            if len(words) > _FLUSH_WORDS:
                yield told(number, words)
                words.clear()
    for number, words in held.items():
        yield told(number, words)


def _fill(slots: int, words: int):
    """The slots of the slices in a task, from rows sorted by slice: (slice, gram, langs)."""
    def run(batches):
        now, part = None, None
        for batch in batches:
            number, keys = np.array(batch["slice"], np.int64), np.array(batch["gram"], np.int64)
            edges = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
            for s, e in zip(edges, edges[1:]):
                if s == e:
                    continue
                if number[s] != now:
                    if now is not None:
                        yield {"slice": [now], "bits": [part.tobytes()], "filled": [_bits(part, 64 * words).sum(0).tolist()]}
                    now, part = int(number[s]), np.zeros((slots, words), np.uint64)
                langs = batch["langs"][s:e]
                owner = np.repeat(np.arange(e - s), [len(x) for x in langs])
                lang = np.array([x for ls in langs for x in ls], np.int64)
                bit = np.uint64(1) << (lang % 64).astype(np.uint64)
                for at in _slots(keys[s:e], slots):
                    np.bitwise_or.at(part, (at[owner], lang // 64), bit)
        if now is not None:
            yield {"slice": [now], "bits": [part.tobytes()], "filled": [_bits(part, 64 * words).sum(0).tolist()]}
    return run


def fit_languages(texts: DataFrame, text: str = "text", lang: str = "lang", least: int = 2, share: float = 0.2, false_rate: float = FALSE_RATE,
                  slice_bytes: int = SLICE_BYTES) -> LanguageModel:
    """Put the n-grams of all rows with a text and a language into one bit-sliced Bloom filter.

    A language gets the n-grams seen ``least`` times or more in it whose
    relative frequency is at least ``share`` of the highest among all
    languages, so that single foreign words do not count as its own. All of
    them go in: the number of slots follows from the largest language's count
    and ``false_rate``, and what exceeds ``slice_bytes`` is dealt to further
    slices by the n-gram, so the rate stays the same at every size.

    Null texts and null languages are not learned from, empty texts have no
    n-grams, repeated rows count each, and there may be any number of
    languages. No rows: a model of no language, which answers ``und``.
    """
    scratch = Scratch(texts.sparkSession)
    known = texts.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("_lang"), F.col(text).alias("_text"))
    names = sorted(r[0] for r in known.select("_lang").distinct().collect())
    if not names:
        return LanguageModel([], 1, 1, 1, np.zeros(0), 0)
    rows = known.select((F.array_position(F.lit(names), F.col("_lang")).cast("int") - 1).alias("_lang"), "_text")
    grams = scratch.cut(map_rows(rows, _count, "lang int, gram bigint, n bigint").groupBy("gram", "lang").agg(F.sum("n").alias("n")), "grams")
    totals = {r["lang"]: r["n"] for r in grams.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    total = F.element_at(F.lit([float(totals.get(i, 1)) for i in range(len(names))]), F.col("lang") + 1)
    # one entry per language that has the n-gram
    top = grams.withColumn("rate", F.col("n") / total).groupBy("gram").agg(F.max("rate").alias("top"), F.collect_list(F.struct("lang", "n", "rate")).alias("all"))
    own = F.transform(F.filter("all", lambda s: (s["n"] >= least) & (s["rate"] >= share * F.col("top"))), lambda s: s["lang"])
    kept = scratch.cut(top.select("gram", own.alias("langs")).where(F.size("langs") > 0), "own")
    most = kept.select(F.explode("langs").alias("lang")).groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    words = -(-len(names) // 64)
    needed = math.ceil(-PROBES * most / math.log(1 - false_rate ** (1 / PROBES))) + 64
    slices = -(-needed * words * 8 // slice_bytes)
    slots = -(-needed // slices)
    dealt = map_rows(kept, lambda batches: ({"slice": _slice_of(np.array(b["gram"], np.int64), slices), "gram": b["gram"], "langs": b["langs"]} for b in batches),
                     "slice bigint, gram bigint, langs array<int>")
    parts = scratch.cut(map_rows(dealt.repartition(slices, "slice").sortWithinPartitions("slice"), _fill(slots, words), "slice bigint, bits binary, filled array<bigint>"), "filter")
    scratch.clear(keep=1)
    filled = np.zeros(64 * words)
    for r in parts.select(*[F.sum(F.col("filled")[i]).alias(f"f{i}") for i in range(len(names))]).collect():
        filled[:len(names)] = [x or 0 for x in r]
    usual = max(totals, key=lambda i: (totals[i], -i), default=0)
    return LanguageModel(names, words, slots, slices, (filled[:len(names)] / (slots * slices)) ** PROBES, usual, parts)


def _has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def _votes(sent, model_words: int, languages: int, number: int, slices: int):
    """Of every text: its n-grams that belong to one slice of the filter, and in how many of them each language answers."""
    def run(batches):
        part = sent.value
        known: dict[str, int] = {}
        votes = np.zeros((_CACHE_WORDS + 1, languages + 1), np.int32)

        def told(keys: np.ndarray, owners: np.ndarray, n: int) -> np.ndarray:
            if slices > 1:
                mine = _slice_of(keys, slices) == number
                keys, owners = keys[mine], owners[mine]
            masks = _masks(part, keys)
            some = np.flatnonzero(masks.any(1))
            masks, held = masks[some], owners[some]
            counts = [np.bincount(held[((masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).astype(bool)], minlength=n) for i in range(languages)]
            return np.stack([np.bincount(owners, minlength=n), *counts], 1)

        for batch in batches:
            out = {"row": batch["_row"], "key": batch["_key"], "letter": [_has_letter(t) for t in batch["_text"]], "votes": []}
            for text in batch["_text"]:
                words, long = [], []
                for w in text.lower().split() if text else []:
                    (long if _is_long(w) else words).append(w)
                sums = np.zeros(languages + 1, np.int64)
                for i in range(0, len(words), 50_000):
                    some = words[i:i + 50_000]
                    new = list(dict.fromkeys(w for w in some if w not in known))
                    if len(known) + len(new) > _CACHE_WORDS:
                        known.clear()
                        new = list(dict.fromkeys(some))
                    start = len(known)
                    known.update(zip(new, range(start, start + len(new))))
                    if new:
                        votes[start:start + len(new)] = told(*_word_keys(new), len(new))
                    sums += votes[np.fromiter(map(known.__getitem__, some), np.int64, len(some))].sum(0, dtype=np.int64)
                for w in long:
                    keys = np.empty(0, np.int64)
                    for part_of in _long_keys(w):
                        keys = np.union1d(keys, part_of)
                    sums += told(keys, np.zeros(len(keys), np.int64), 1)[0]
                out["votes"].append(sums.tolist())
            yield out
    return run


def identify_languages(texts: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Language of every whole text: ``key``, ``lang_pred`` and ``score`` (share of the winner among all corrected counts).

    General: the particle records hold no running text. Every n-gram of a
    text, inside words of any length, asks the bit-sliced filter, which
    answers for all languages at once. Of the n-grams that a language answers
    for, as many as its false-positive rate lets expect are taken off again
    (hits = own + rate * (all - own)); hits within three standard errors of
    that are none. The highest rest wins (ties: the first by name). Each slice of the filter is sent to the tasks in turn and adds
    its counts. In words over 60 characters an n-gram counts once, as its
    repeats would all hit or all miss.

    Text with letters of which no n-gram is left gets the language with most
    training text and score 0. Null text and text without a letter: ``und``,
    score 0. Null keys and repeated rows are judged like any row. No rows: an
    empty result.
    """
    rows = keep_columns(texts, key, text, where="texts").select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.monotonically_increasing_id().alias("_row"))
    kind = rows.schema["_key"].dataType.simpleString()
    every = len(model.languages)
    if not every:
        return rows.select(F.col("_key").alias(key), F.lit(NONE).alias("lang_pred"), F.lit(0.0).alias("score"))
    if model.slices > 1:  # several passes need the same row numbers
        rows = Scratch(texts.sparkSession).cut(rows, "texts")
    told = None
    for i in range(model.slices):
        sent = texts.sparkSession.sparkContext.broadcast(model.part(i))
        share = map_rows(rows, _votes(sent, model.words, every, i, model.slices), f"row bigint, key {kind}, letter boolean, votes array<bigint>")
        told = share if told is None else told.unionByName(share)
    if model.slices > 1:
        told = told.groupBy("row").agg(F.first("key").alias("key"), F.first("letter").alias("letter"), F.array(*[F.sum(F.col("votes")[i]) for i in range(every + 1)]).alias("votes"))
    asked = F.col("votes")[0]
    own = F.zip_with(F.slice("votes", 2, every), F.lit([float(r) for r in model.false_rate]), 
                     lambda v, r: F.when(v > r * asked + 3 * F.sqrt(r * (1 - r) * asked), (v - r * asked) / (1 - r + 1e-12)).otherwise(0.0))
    sums = told.select("key", "letter", own.alias("own"))
    total = F.aggregate("own", F.lit(0.0), lambda a, b: a + b)
    best = F.when(total > 0, F.array_position("own", F.array_max("own")).cast("int")).otherwise(model.usual + 1)
    name = F.when(F.col("letter"), F.element_at(F.lit(model.languages), best)).otherwise(NONE)
    score = F.when(F.col("letter") & (total > 0), F.array_max("own") / total).otherwise(0.0)
    return sums.select(F.col("key").alias(key), name.alias("lang_pred"), score.alias("score"))
