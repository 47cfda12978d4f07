"""Helpers shared by the text operators."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from orientlake.frames import require_columns
from orientlake.session import new_dir

# A word is a run of characters outside these, and only A-Z are lower-cased.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words as UTF-8; bytes.lower() and bytes.split() know ASCII only, which is the rule."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def fold_of(key: str, parts: int) -> Column:
    """crc32 of the key's text modulo ``parts``; a null key has fold 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % F.lit(parts), F.lit(0))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit integers evenly (xor-shift and multiply)."""
    x = np.array(x, np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def keep_columns(df: DataFrame, *names: str, where: str) -> DataFrame:
    """Only the needed columns, so extra ones of any name cannot clash."""
    require_columns(df, names, where)
    return df.select(*dict.fromkeys(names))


BATCH_BYTES = 4 << 20  # of a batch that is taken apart at a time; long texts would fill a worker many times over


def parts_of(batch: pa.RecordBatch, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``most`` bytes, at least one row each."""
    step = max(1, batch.num_rows * most // max(batch.nbytes, 1))
    for start in range(0, batch.num_rows, step):
        yield batch.slice(start, step)


def give_back() -> None:
    """Hand freed memory back to the system: a worker lives on after its task, and its executor needs the room."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library only
    if trim is not None:
        trim(0)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """Run ``fn`` over the Arrow batches of a task, in parts of bounded size."""
    def run(batches):
        def parts():
            for whole in batches:
                yield from parts_of(whole)
                del whole
        yield from fn(parts())
        give_back()

    return df.mapInArrow(run, schema)


def map_rows(df: DataFrame, fn: Callable[[Iterator[dict]], Iterator[dict]], schema: str | T.StructType) -> DataFrame:
    """Run ``fn`` over the Arrow batches of a task, in parts of bounded size, given and returned as dicts of column lists."""
    shape = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(shape)

    def run(batches):
        def dicts():
            for batch in batches:
                yield {name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)}
        for out in fn(dicts()):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return map_batches(df, run, shape)


def place_of(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a local path or of an address with a scheme."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


class Scratch:
    """Tables of one operator in the shared folder, gone when its result is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def cut(self, df: DataFrame, label: str) -> DataFrame:
        """Write ``df`` and read it back, so that its lineage ends here."""
        path = new_dir(self.spark, label)
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, paths: list[str]) -> None:
        """Delete tables that nothing reads any more."""
        for path in paths:
            system, at = place_of(path)
            system.delete_dir(at)
        self.paths = [p for p in self.paths if p not in paths]

    def clear(self, keep: int = 0) -> None:
        """Delete all tables but the last ``keep``."""
        for path in self.paths[:len(self.paths) - keep]:
            system, at = place_of(path)
            system.delete_dir(at)
        self.paths = self.paths[len(self.paths) - keep:]

    def finish(self, df: DataFrame, label: str) -> DataFrame:
        """Write the result, then delete everything it was made from."""
        out = self.cut(df, label)
        self.clear(keep=1)
        self.paths = []
        return out
