"""Alignment of the tokens that two tokenizers cut the same texts into."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from orientlake.llm.common import Scratch, keep_columns, map_rows

_CACHE_WORDS = 200_000
_LONG_WORD = 100  # characters from which on a word is not remembered
_STEP = 1024  # words that are read together
_TOGETHER = 64  # texts whose new words are
_FLUSH_BYTES = 8 << 20
MOST_SENT = 1 << 21  # links that are sent to all tasks at a time, 17 bytes each
#: Both tokenizers always cut before a single blank between other characters.
_CUT = re.compile(r"(?<=\S) (?=\S)")
_OTHER_BLANKS = re.compile(r" (?=\s|\Z)|\s(?= )|\A ")
#: Aligners of this worker process; later tasks find the words of earlier ones.
_ALIGNERS: dict[tuple[str, str], "TokenAligner"] = {}


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: visible Latin-1 for itself, the others from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


def byte_ends(begins: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Byte offsets at which tokens end.

    ``begins`` and ``ends`` are a tokenizer's own spans in bytes. A span that
    starts where the last one ended and ends where the next one starts is a
    coarse cut and taken as it is; tokens that share a character with a
    neighbour (parts of a multibyte character, byte-fallback tokens) are
    placed by the lengths of decoded bytes since the last coarse cut.
    """
    decoded = np.cumsum(sizes)
    coarse = (ends > begins) & (begins == np.append(0, ends[:-1])) & (ends == np.append(begins[1:], ends[-1:]))
    last = np.maximum.accumulate(np.where(coarse, np.arange(len(ends)), -1))
    return decoded + np.where(last >= 0, (ends - decoded)[last], 0)


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the tokens of both sides whose byte ranges overlap, pair by pair, and the offsets at which both end.

    Between two neighbouring ends of any side lies a part of exactly one token
    of each; these parts are the pairs.
    """
    every = np.sort(np.concatenate([a_ends, b_ends]), kind="stable")
    twice = every[1:] == every[:-1]
    cuts = every[np.append(True, ~twice)]
    return np.searchsorted(a_ends, cuts), np.searchsorted(b_ends, cuts), every[1:][twice]


class TokenAligner:
    """Aligns a byte-level ``tokenizers`` file (A) with a ``sentencepiece`` model that puts a blank before a text (B).

    A reads a blank and the text, B the text. Strings of special tokens inside
    a text are plain text. Words are aligned once and remembered, in two halves
    of bounded size of which the older goes when the newer is full.
    """

    def __init__(self, a_file: str, b_file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        letters = _byte_letters()
        self.a_bytes = {i: bytes(letters[c] for c in piece) if all(c in letters for c in piece) else piece.encode() for piece, i in self.a.get_vocab().items()}
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[1:-1], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.width = len(self.b_bytes)
        self.kind = "<u4" if (max(self.a_bytes) + 1) * self.width <= 1 << 32 else "<u8"
        self.a_size = np.array([len(self.a_bytes.get(i, b"")) for i in range(max(self.a_bytes) + 1)], np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)
        top = max(len(self.a_size), self.width)
        # an id and what follows it: another id of the group, the other side, another group
        self.told = [[f"{i}{mark}" for i in range(top)] for mark in ",|;"]
        self.digits = np.array([len(str(i)) for i in range(top)], np.int64)
        self.newer: dict[str, tuple | None] = {}
        self.older: dict[str, tuple | None] = {}

    def align(self, words: list[str]) -> list[tuple | None]:
        """(tokens of A, tokens of B, groups, groups as text, links) of each whole text, None where its bytes are not those of a side.

        Words are read together, a blank between them, as both tokenizers cut there.
        """
        found: dict[int, tuple | None] = {}
        joined: list[int] = []
        for i, w in enumerate(words):
            if not w or w[0].isspace() or w[-1].isspace() or len(w) > _LONG_WORD:
                found[i] = (self._together([w]) or [None])[0]
            else:
                joined.append(i)
        for start in range(0, len(joined), _STEP):
            part = joined[start:start + _STEP]
            got = self._together([words[i] for i in part])
            found.update(zip(part, got if got is not None else [(self._together([words[i]]) or [None])[0] for i in part]))
        return [found[i] for i in range(len(words))]

    def _together(self, words: list[str]) -> list[tuple] | None:
        text = " ".join(words)
        framed = f" {text}"
        raw = framed.encode("utf-8", "surrogatepass")
        a = self.a.encode(framed, add_special_tokens=False)
        b = self.b.encode(text, return_type="proto", num_threads=1)
        b_spans = [(p.id, p.begin, p.end) for p in b.pieces]
        if not a.ids or not b_spans or b"".join(map(self.a_bytes.__getitem__, a.ids)) != raw or b"".join([self.b_bytes[p[0]] for p in b_spans]) != raw:
            return None
        a_ids, b_spans = np.array(a.ids, np.int64), np.array(b_spans, np.int64)
        a_spans, b_ids = np.array(a.offsets, np.int64), b_spans[:, 0]
        edges = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        if len(raw) != len(framed):
            # spans of A count characters
            codes = np.frombuffer(framed.encode("utf-32-le", "surrogatepass"), np.uint32)
            place = np.append(0, np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)))
            a_spans, edges = place[a_spans], place[edges]
        # spans of B count bytes of the text, without the blank before it
        b_begins = b_spans[:, 1] + 1
        b_begins[0] = 0
        a_ends = byte_ends(a_spans[:, 0], a_spans[:, 1], self.a_size[a_ids])
        b_ends = byte_ends(b_begins, b_spans[:, 2] + 1, self.b_size[b_ids])
        one, two, cuts = overlaps(a_ends, b_ends)
        if not (cuts[np.minimum(np.searchsorted(cuts, edges), len(cuts) - 1)] == edges).all():
            return None
        links = (a_ids[one] * self.width + b_ids[two]).astype(self.kind).tobytes()
        step = np.dtype(self.kind).itemsize
        # ids of both sides by group, A's first, each with the mark that follows it
        a_group, b_group = np.searchsorted(cuts, a_ends), np.searchsorted(cuts, b_ends)
        order = np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")
        ids = np.concatenate([a_ids, b_ids])[order]
        marks = np.concatenate([np.where(cuts[a_group] == a_ends, 1, 0), np.where(cuts[b_group] == b_ends, 2, 0)])[order]
        told = self.told
        pieces = "".join([told[m][i] for m, i in zip(marks.tolist(), ids.tolist())])
        at = np.cumsum(self.digits[ids] + 1)
        n_a, n_b, n_g = (np.searchsorted(x, edges, "right") for x in (a_ends, b_ends, cuts))
        n_l = n_a + n_b - n_g  # every end of a side closes a part, and those of both sides are one
        text_ends = at[n_a + n_b - 1].tolist()
        out, last = [], (0, 0, 0, 0, 0)
        for now in zip(n_a.tolist(), n_b.tolist(), n_g.tolist(), text_ends, n_l.tolist()):
            out.append((now[0] - last[0], now[1] - last[1], now[2] - last[2], pieces[last[3]:now[3] - 1], links[step * last[4]:step * now[4]]))
            last = now
        return out

    def learn(self, words: set[str]) -> None:
        """Have all of these words in the newer half."""
        newer, older = self.newer, self.older
        new = [w for w in words if w not in newer]
        if len(newer) + len(new) > _CACHE_WORDS:
            self.older = older = newer
            self.newer = newer = {}
            new = list(words)
        fresh = [w for w in new if w not in older]
        if len(fresh) < len(new):
            newer.update((w, older[w]) for w in new if w in older)
        newer.update(zip(fresh, self.align(fresh)))

    def texts(self, texts: list[str | None]) -> Iterator[tuple]:
        """The alignment of whole texts, word by word: what ``align`` gives, zeros where there is none."""
        nothing = (0, 0, 0, "", b"")
        for start in range(0, len(texts), _TOGETHER):
            split = [(_CUT.split(t) if _OTHER_BLANKS.search(t) else t.split(" ")) if t else [] for t in texts[start:start + _TOGETHER]]
            words = set().union(*split)
            long = {w for w in words if len(w) > _LONG_WORD}
            self.learn(words - long)
            known = self.newer
            for text, words in zip(texts[start:start + _TOGETHER], split):
                if not words:
                    yield nothing
                    continue
                parts = [known[w] if w not in long else self.align([w])[0] for w in words] if long else list(map(known.__getitem__, words))
                if None in parts:
                    whole = self._together([text])
                    yield whole[0] if whole else nothing
                    continue
                a, b, groups, told, links = zip(*parts)
                yield sum(a), sum(b), sum(groups), ";".join(told), b"".join(links)


def _aligned(a_file: str, b_file: str):
    def run(batches) -> Iterator[dict]:
        aligner = _ALIGNERS.setdefault((a_file, b_file), None) or TokenAligner(a_file, b_file)
        _ALIGNERS[a_file, b_file] = aligner
        for batch in batches:
            out, held = {c: [] for c in ("_key", "n_a", "n_b", "n_groups", "n_links", "groups", "links", "times")}, 0
            for key, (n_a, n_b, n_groups, groups, links) in zip(batch["_key"], aligner.texts(batch["_text"])):
                every = np.frombuffer(links, aligner.kind)
                distinct, times = np.unique(every, return_counts=True)
                for c, v in zip(out, (key, n_a, n_b, n_groups, len(every), groups, distinct.astype("<u8").tobytes() if aligner.kind == "<u8" else distinct.tobytes(),
                                      times.astype("<u4").tobytes())):
                    out[c].append(v)
                held += len(groups) + len(links)
                if held > _FLUSH_BYTES:
                    yield out
                    out, held = {c: [] for c in out}, 0
            if out["_key"]:
                yield out
    return run


def align_texts(texts: DataFrame, a_file: str, b_file: str, key: str = "file", text: str = "value") -> DataFrame:
    """How the tokens of two tokenizers cover each whole text.

    Takes run logs (``file``, ``value``) or any table with a key and a text.
    Returns ``key``, ``n_a`` and ``n_b`` (tokens), ``n_groups`` (pieces between
    the byte offsets at which both sides end), ``n_links`` (pairs of tokens
    whose bytes overlap), ``groups`` (ids of each group, ``a1,a2|b1;a3|b2``),
    and the distinct ``links`` of the text with their ``times``, packed as
    unsigned integers (see ``link_counts``).

    Spans come from the tokenizers: character offsets of A, byte spans of B's
    pieces; both are coarse cuts that decoded bytes refine (``byte_ends``).
    Words are aligned apart, which is the same as aligning whole texts, as
    both tokenizers cut before a single blank.

    Null or empty text, and text that the tokens of either side do not spell
    out byte by byte: zeros and empty groups. Null keys and repeated rows are
    aligned like any row. No rows: an empty result.
    """
    rows = keep_columns(texts, key, text, where="texts").select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    kind = rows.schema["_key"].dataType.simpleString()
    return map_rows(rows, _aligned(a_file, b_file), f"_key {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, links binary, times binary"
                    ).withColumnRenamed("_key", key)


def _unpacked(links: bytes, times: bytes) -> tuple[np.ndarray, np.ndarray]:
    times = np.frombuffer(times, "<u4")
    return np.frombuffer(links, "<u4" if len(links) == 4 * len(times) else "<u8").astype(np.int64), times.astype(np.int64)


def _summed(batches):
    """Counts of links, summed within a task."""
    held, size = [], 0

    def told():
        links, at = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
        return links, np.bincount(at, np.concatenate([h[1] for h in held]), len(links)).astype(np.int64)

    for batch in batches:
        for links, times in zip(batch["links"], batch["times"]):
            if links:
                held.append(_unpacked(links, times))
                size += len(held[-1][0])
            if size > 2_000_000:
                links, n = told()
                if len(links) > 1_000_000:
                    yield {"link": links, "n": n}
                    held, size = [], 0
                else:
                    held, size = [(links, n)], len(links)
    if held:
        links, n = told()
        yield {"link": links, "n": n}


def link_counts(aligned: DataFrame, b_width: int) -> DataFrame:
    """How often each pair of ids is linked in all texts: ``link`` (A's id times ``b_width`` plus B's id), ``n``, and
    ``best``: no other link of the same id of B is more frequent. No links: an empty result."""
    counted = map_rows(aligned.select("links", "times"), _summed, "link bigint, n bigint").groupBy("link").agg(F.sum("n").alias("n"))
    b = F.col("link") % b_width
    top = counted.groupBy(b.alias("b")).agg(F.max("n").alias("top"))
    return counted.withColumn("b", b).join(top, "b").select("link", "n", (F.col("n") == F.col("top")).alias("best"))


def _scored(sent):
    def run(batches):
        links, n, best = sent.value
        for batch in batches:
            out = {"row": batch["row"], "n_best": [], "count_sum": []}
            for packed, times in zip(batch["links"], batch["times"]):
                mine, times = _unpacked(packed, times)
                if not len(mine) or not len(links):
                    out["n_best"].append(0)
                    out["count_sum"].append(0)
                    continue
                at = np.minimum(np.searchsorted(links, mine), len(links) - 1)
                here = links[at] == mine
                at, times = at[here], times[here]
                out["n_best"].append(int(times[best[at]].sum()))
                out["count_sum"].append(int((times * n[at]).sum()))
            yield out
    return run


def score_links(aligned: DataFrame, b_width: int, scratch: Scratch, most_sent: int = MOST_SENT) -> DataFrame:
    """Add ``n_best`` (links that are the most frequent of their id of B, ties included) and ``count_sum`` (the counts of all links).

    ``links`` and ``times`` go. The counts are sent to the tasks in as many
    parts as their number asks for, ``most_sent`` at a time; each part adds
    its share to every row. No rows: an empty result.
    """
    rows = scratch.cut(aligned.withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = scratch.cut(link_counts(rows, b_width), "links")
    parts = -(-max(counts.count(), 1) // most_sent)
    spark, shares = aligned.sparkSession, None
    for i in range(parts):
        got = counts.where(F.pmod(F.xxhash64("link"), F.lit(parts)) == i).toArrow()
        order = np.argsort(got["link"].to_numpy())
        sent = spark.sparkContext.broadcast(tuple(got[c].to_numpy()[order] for c in ("link", "n", "best")))
        share = map_rows(rows.select("row", "links", "times"), _scored(sent), "row bigint, n_best bigint, count_sum bigint")
        shares = share if shares is None else shares.unionByName(share)
    summed = shares.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return rows.drop("links", "times").join(summed, "row").drop("row")
