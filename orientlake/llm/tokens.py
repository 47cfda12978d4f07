"""Token ids in flat binary files with document offsets."""

from __future__ import annotations

import os
import re
import sys
import zlib
from array import array

import numpy as np
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from orientlake.llm.common import keep_columns, map_rows, place_of
from orientlake.session import cut, shuffle_width

NO_KEY = -(1 << 63)  # stands for a null key in an index file
_CACHE_WORDS = 300_000
_LONG_WORD = 100
_FLUSH_BYTES = 1 << 21
#: Around a run of ASCII marks (no apostrophe among them) that stands between letters, digits or blanks a tokenizer by word always cuts.
_MARKS, _PLAIN = r"""!"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~""", r"a-z0-9\u00df-\u00f6\u00f8-\u00ff"
_CUT = re.compile(rf"([{_MARKS}](?<=[{_PLAIN} ][{_MARKS}])[{_MARKS}]*)(?=[{_PLAIN} \n]|\Z)")
#: White space for Python, but not for every tokenizer.
_SEPARATORS = re.compile(r"[\x1c-\x1f]")
#: Encoders of this worker process; later tasks find the words of earlier ones.
_ENCODERS: dict[tuple, "WordEncoder"] = {}


class WordEncoder:
    """Ids of a text, as bytes, from a lower-casing tokenizer that never joins words across ASCII white space.

    Words are encoded once per worker process and remembered in two halves of
    bounded size, of which the older goes when the newer is full. A text that
    holds the string of a special token is read as a whole. Tokenizers that keep white space or case, or
    whose special tokens contain these, must encode whole texts
    (``by_word=False``).
    """

    def __init__(self, tokenizer_file: str, width: int = 2, by_word: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.kind = {2: "<u2", 4: "<u4"}[width]
        self.by_word = by_word
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.special = [str(t).lower() for t in self.tokenizer.get_added_tokens_decoder().values()] if by_word else []
        #: ids that end a word, if the tokenizer marks them
        self.last = np.array([bool(suffix) and str(self.tokenizer.id_to_token(i)).endswith(suffix) for i in range(self.tokenizer.get_vocab_size())])
        self.newer: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @classmethod
    def shared(cls, tokenizer_file: str, width: int, by_word: bool) -> "WordEncoder":
        made = (tokenizer_file, width, by_word)
        if made not in _ENCODERS:
            _ENCODERS[made] = cls(*made)
        return _ENCODERS[made]

    def _packed(self, ids: list[int]) -> bytes:
        packed = array({"<u2": "H", "<u4": "I"}[self.kind], ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of each word; words of letters only are read together and told apart by the ids that end a word."""
        out: dict[str, bytes] = {}
        plain = [w for w in words if w.isalpha()]
        for start in range(0, len(plain) if self.last.any() else 0, 1024):
            part = plain[start:start + 1024]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, self.kind)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(part) and ends[-1] == len(ids):
                packed, at = ids.tobytes(), (ids.itemsize * ends).tolist()
                out.update(zip(part, [packed[a:b] for a, b in zip([0, *at], at)]))
        rest = [w for w in words if w not in out]
        out.update(zip(rest, [self._packed(e.ids) for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)]))
        return [out[w] for w in words]

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_word:
            return self._packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        low = text.lower()
        if any(s in low for s in self.special):
            return self._packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        # the one capital letter whose lower case depends on its neighbours is left to the tokenizer
        cut = _CUT.sub(r" \1 ", text if "\u03a3" in text else low)
        words = cut.split(" ") if _SEPARATORS.search(cut) else cut.split()
        newer, older = self.newer, self.older
        new = list({w for w in words if w not in newer})
        if new:
            if len(newer) + len(new) > _CACHE_WORDS:
                self.older = older = newer
                self.newer = newer = {}
                new = list(set(words))
            fresh = [w for w in new if w not in older]
            if len(fresh) < len(new):
                newer.update((w, older[w]) for w in new if w in older)
            newer.update(zip(fresh, self._words(fresh)))
        out = b"".join(map(newer.__getitem__, words))
        for w in new:
            if len(w) > _LONG_WORD:
                del newer[w]
        return out


def _write_shards(folder: str, tokenizer_file: str, end_id: int, width: int, by_word: bool):
    """Encode the sorted rows of a task into one pair of files; they get their names when whole."""
    kind = {2: "<u2", 4: "<u4"}[width]

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        shard = task.partitionId()
        name, attempt = f"tokens-{shard:06d}", task.taskAttemptId()
        system, base = place_of(folder)
        encoder = WordEncoder.shared(tokenizer_file, width, by_word)
        out, n_ids, keys, ends = None, 0, [], []
        pending: list[bytes] = []
        end = np.array([end_id], kind).tobytes()
        held = 0
        for batch in batches:
            for key, text in zip(batch["_key"], batch["_text"]):
                ids = encoder.encode(text) + end
                pending.append(ids)
                held += len(ids)
                n_ids += len(ids) // width
                keys.append(NO_KEY if key is None else key)
                ends.append(n_ids)
                if held >= _FLUSH_BYTES:
                    out = out or system.open_output_stream(f"{base}/.{name}-{attempt}.bin")
                    out.write(b"".join(pending))
                    pending, held = [], 0
        if not keys:
            return
        out = out or system.open_output_stream(f"{base}/.{name}-{attempt}.bin")
        if pending:
            out.write(b"".join(pending))
        out.close()
        with system.open_output_stream(f"{base}/.{name}-{attempt}.idx") as idx:
            idx.write(np.array([len(keys), width], "<i8").tobytes())
            idx.write(np.array([0, *ends], "<i8").tobytes())
            idx.write(np.array(keys, "<i8").tobytes())
        for kind_ in ("bin", "idx"):
            system.move(f"{base}/.{name}-{attempt}.{kind_}", f"{base}/{name}.{kind_}")
        yield {"shard": [shard], "name": [name], "n_docs": [len(keys)], "n_tokens": [n_ids]}
    return run


def write_tokens(texts: DataFrame, folder: str, tokenizer_file: str, key: str = "pid", text: str = "value", end_id: int = 2,
                 width: int = 2, by_word: bool = True) -> DataFrame:
    """Encode texts into flat files of unsigned integers and return the list of files.

    Takes any table with a whole-numbered key and a text, such as run logs
    numbered by ``pid``. Rows are sorted by key (then by text) over all files.
    A file ``tokens-N.bin`` holds ids of ``width`` bytes, little endian, each
    text closed by ``end_id``; ``tokens-N.idx`` holds the number of texts and
    the width, then 64-bit offsets (one more than texts), then 64-bit keys.
    Returns ``shard``, ``name``, ``n_docs``, ``n_tokens``, ``first_doc`` and
    ``base`` (ids in all files before), also kept as Parquet in
    ``folder/shards``; bases are prefix sums over one row per file.

    Null or empty text: the end id alone. Null key: sorted first and kept as
    null. Repeated rows are written each. No rows: no files, an empty list. A
    repeated task writes under its own name and then replaces its files.
    """
    docs = keep_columns(texts, key, text, where="texts").select(F.col(key).cast("bigint").alias("_key"), F.col(text).alias("_text"))
    spark = texts.sparkSession
    system, base = place_of(folder)
    system.create_dir(base, recursive=True)
    tie = F.xxhash64("_text")
    ranged = docs.repartitionByRange(shuffle_width(spark), F.col("_key").asc_nulls_first(), tie).sortWithinPartitions(
        F.col("_key").asc_nulls_first(), tie, "_text")
    shards = cut(map_rows(ranged, _write_shards(folder, tokenizer_file, end_id, width, by_word),
                          "shard int, name string, n_docs bigint, n_tokens bigint"), "shards")
    # one row per file, as many as tasks wrote
    rows = sorted(shards.collect())
    doc, token, table = 0, 0, []
    for r in rows:
        table.append((r["shard"], r["name"], r["n_docs"], r["n_tokens"], doc, token))
        doc, token = doc + r["n_docs"], token + r["n_tokens"]
    listed = spark.createDataFrame(table, "shard int, name string, n_docs bigint, n_tokens bigint, first_doc bigint, base bigint")
    listed.write.mode("overwrite").parquet(f"{folder}/shards")
    return spark.read.parquet(f"{folder}/shards")


def open_shard(folder: str, name: str) -> tuple[np.ndarray, np.ndarray, list]:
    """Ids, offsets and keys of one file, memory-mapped where the file is local."""
    system, base = place_of(folder)
    if isinstance(system, fs.LocalFileSystem):
        raw = np.memmap(f"{base}/{name}.idx", "<i8", "r")
    else:
        with system.open_input_file(f"{base}/{name}.idx") as f:
            raw = np.frombuffer(f.read(), "<i8")
    n, width = int(raw[0]), int(raw[1])
    offsets, keys = raw[2:3 + n], raw[3 + n:3 + 2 * n]
    kind = {2: "<u2", 4: "<u4"}[width]
    if isinstance(system, fs.LocalFileSystem):
        ids = np.memmap(f"{base}/{name}.bin", kind, "r")
    else:
        with system.open_input_file(f"{base}/{name}.bin") as f:
            ids = np.frombuffer(f.read(), kind)
    return ids, offsets, [None if k == NO_KEY else int(k) for k in keys]


def _read(folder: str):
    def run(batches):
        for batch in batches:
            for name, base in zip(batch["name"], batch["base"]):
                ids, offsets, keys = open_shard(folder, name)
                for i in range(0, len(keys), 4096):
                    at = offsets[i:min(i + 4096, len(keys)) + 1].tolist()
                    yield {"key": keys[i:i + 4096], "start": [base + a for a in at[:-1]], "n_tokens": [b - a for a, b in zip(at, at[1:])],
                           "ids_crc32": [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(at, at[1:])]}
    return run


def read_tokens(spark: SparkSession, folder: str, key: str = "pid") -> DataFrame:
    """Per text of the files: ``key``, ``start`` (ids before it in all files), ``n_tokens`` and ``ids_crc32``.

    The checksum is over the ids as little-endian 32-bit integers, whatever
    width the file has. Each task maps whole files and reads them in place.
    Null keys come back as null, repeated rows each; a folder without files
    gives no rows.
    """
    listed = spark.read.parquet(f"{folder}/shards").select("name", "base")
    if not listed.take(1):
        return spark.createDataFrame([], f"{key} bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    spread = listed.repartition(shuffle_width(spark), "name")
    return map_rows(spread, _read(folder), f"key bigint, start bigint, n_tokens bigint, ids_crc32 bigint").withColumnRenamed("key", key)
