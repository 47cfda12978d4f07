"""A Bloom filter of fixed size, built by tasks and sent to all of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from orientlake.llm.common import map_batches, map_rows

BITS = 24  # 2 MB, whatever goes in; more keys only let more rows through to the exact step
_PART = 1 << 16


def _slots(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64), (hashes & np.uint64((1 << BITS) - 1)).astype(np.int64)


def _fill(batches):
    bits = np.zeros(1 << BITS, bool)
    for batch in batches:
        for part in _slots(np.array(batch["hash"], np.int64).view(np.uint64)):
            bits[part] = True
    packed = np.packbits(bits)
    for i in range(0, len(packed), _PART):
        if packed[i:i + _PART].any():
            yield {"part": [i], "bits": [packed[i:i + _PART].tobytes()]}


def _join_parts(batches):
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, raw in zip(batch["part"], batch["bits"]):
            got = np.frombuffer(raw, np.uint8)
            held[part] = held[part] | got if part in held else got
    for part, raw in held.items():
        yield {"part": [part], "bits": [raw.tobytes()]}


def free_name(rows: DataFrame, name: str) -> str:
    """A column name that the table does not have, in any case of its letters."""
    taken = {c.lower() for c in rows.columns}
    while name in taken:
        name += "_"
    return name


class Bloom:
    """Which 64-bit hashes may be among those of a table; never wrong about a hash that is."""

    def __init__(self, hashes: DataFrame):
        """``hashes`` has one BIGINT column."""
        spark = hashes.sparkSession
        parts = map_rows(map_rows(hashes.toDF("hash"), _fill, "part int, bits binary").repartition(8, "part"), _join_parts, "part int, bits binary")
        packed = np.zeros((1 << BITS) // 8, np.uint8)
        for r in parts.collect():
            packed[r["part"]:r["part"] + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
        self.sent = spark.sparkContext.broadcast(packed)

    def bits(self) -> np.ndarray:
        return np.unpackbits(self.sent.value).view(bool)

    def filter(self, rows: DataFrame, hashed: Column, inside: bool) -> DataFrame:
        """Rows whose hash may be in the table (``inside``), or those whose hash is surely not."""
        sent, shape, name = self, rows.schema, free_name(rows, "bloom")
        marked = rows.withColumn(name, hashed)

        def run(batches):
            bits = sent.bits()
            for batch in batches:
                i = batch.schema.get_field_index(name)
                got = may_hold(bits, batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
                yield batch.remove_column(i).filter(pa.array(got == inside))

        return map_batches(marked, run, shape)


def may_hold(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    a, b = _slots(hashes)
    return bits[a] & bits[b]


def without_keys(rows: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """``rows`` whose key is not in the one column of ``gone``; null keys stay.

    Rows that the filter clears stay where they are; only the others are
    shuffled for the exact test.
    """
    name = free_name(rows, "gone")
    keys = gone.toDF(name).where(F.col(name).isNotNull()).distinct()
    bloom = Bloom(keys.select(F.xxhash64(name)))
    doubtful = bloom.filter(rows, F.xxhash64(F.col(key)), True).join(keys, F.col(key) == F.col(name), "left_anti")
    return bloom.filter(rows, F.xxhash64(F.col(key)), False).unionByName(doubtful)
