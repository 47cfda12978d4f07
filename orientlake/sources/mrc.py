"""Image stacks and volumes in MRC files, read in ranges so that one large file spreads over many tasks."""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

# Sample types by file mode, and the length of the main header.
MODES = {0: "<i1", 1: "<i2", 2: "<f4", 6: "<u2", 12: "<f2"}
HEADER = 1024
RANGE_BYTES = 32 << 20


def _open(path: str):
    if "://" not in path:
        path = path.removeprefix("file:")
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def parse_header(raw: bytes) -> dict:
    nx, ny, nz, mode = struct.unpack_from("<4i", raw, 0)
    mx = struct.unpack_from("<i", raw, 28)[0]
    width = struct.unpack_from("<f", raw, 40)[0]
    extra = struct.unpack_from("<i", raw, 92)[0]
    if mode not in MODES or min(nx, ny, nz) < 1:
        raise ValueError(f"unreadable header: {nx} x {ny} x {nz}, mode {mode}")
    return {"nx": nx, "ny": ny, "nz": nz, "mode": mode, "extra": extra, "px": width / mx if mx > 0 else 0.0}


def make_header(nx: int, ny: int, nz: int, px: float) -> bytes:
    raw = bytearray(HEADER)
    struct.pack_into("<4i", raw, 0, nx, ny, nz, 2)
    struct.pack_into("<3i", raw, 28, nx, ny, nz)
    struct.pack_into("<3f", raw, 40, nx * px, ny * px, nz * px)
    raw[208:212] = b"MAP "
    raw[212:216] = bytes([0x44, 0x44, 0, 0])
    return bytes(raw)


def list_files(spark: SparkSession, glob: str) -> DataFrame:
    """Paths and lengths; no content is read."""
    return spark.read.format("binaryFile").load(glob).select("path", "length")


def headers(files: DataFrame) -> DataFrame:
    def run(frames):
        for pdf in frames:
            rows = []
            for path in pdf["path"]:
                with _open(path) as f:
                    rows.append({"path": path, **parse_header(f.read(HEADER))})
            yield pd.DataFrame(rows, columns=["path", "nx", "ny", "nz", "mode", "extra", "px"])
    return files.select("path").mapInPandas(run, "path string, nx int, ny int, nz int, mode int, extra int, px double")


def scan_images(spark: SparkSession, glob: str) -> DataFrame:
    """One row per image: path, 1-based index, ny, nx, px, pixels. A two-dimensional file is one image."""
    heads = headers(list_files(spark, glob))
    size = F.when(F.col("mode") == 0, 1).when(F.col("mode") == 2, 4).otherwise(2)
    per = F.greatest(F.lit(1), F.floor(F.lit(RANGE_BYTES) / (F.col("nx").cast("bigint") * F.col("ny") * size))).cast("int")
    ranges = heads.withColumn("per", per).withColumn("start", F.explode(F.sequence(F.lit(0), F.col("nz") - 1, F.col("per"))))
    # ranges of one large file must not stay in the task that read its header
    ranges = ranges.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "start")

    def run(frames):
        for pdf in frames:
            for r in pdf.itertuples():
                kind = np.dtype(MODES[r.mode])
                n, area = min(r.per, r.nz - r.start), r.nx * r.ny
                with _open(r.path) as f:
                    raw = f.read_at(n * area * kind.itemsize, HEADER + r.extra + r.start * area * kind.itemsize)
                block = np.frombuffer(raw, dtype=kind).astype(np.float32).reshape(n, area)
                yield pd.DataFrame({"path": r.path, "index": np.arange(r.start + 1, r.start + n + 1, dtype=np.int64), "ny": np.int32(r.ny),
                                    "nx": np.int32(r.nx), "px": r.px, "pixels": list(block)})
    return ranges.mapInPandas(run, "path string, index bigint, ny int, nx int, px double, pixels array<float>")


def scan_volumes(spark: SparkSession, glob: str, px: float | None = None) -> DataFrame:
    """Voxel rows (path, px, z, y, x, v); a given voxel size must agree with the header."""
    v = scan_images(spark, glob)
    if px is not None:
        v = v.withColumn("px", F.when(F.abs(F.col("px") - px) <= 1e-5 * px + 1e-8, F.col("px")).otherwise(
            F.raise_error(F.lit("voxel size differs from the header")).cast("double")))
    return v.select("path", "px", (F.col("index") - 1).cast("int").alias("z"), "nx", F.posexplode("pixels").alias("i", "v")).select(
        "path", "px", "z", F.expr("cast(i div nx as int)").alias("y"), F.expr("cast(i % nx as int)").alias("x"), F.col("v").cast("double").alias("v"))


def write_stacks(images: DataFrame, folder: str, stack: str = "stack", index: str = "index", side_x: str = "nx", side_y: str = "ny", px: float = 1.0) -> DataFrame:
    """One file per stack below ``folder``; returns (path, images written).

    A file is written by one task, but as a stream of batches in index order:
    its memory does not grow with the stack. The images are dealt by a hash of
    the stack, since a deal by the stack itself may be left to the join before
    it, whose partitions can change at run time.
    """
    base = folder.rstrip("/") + "/"
    sizes = images.groupBy(stack).agg(F.count(F.lit(1)).alias("_n"))
    ordered = images.select(F.col(stack).alias("stack"), F.col(index).alias("index"), F.col(side_x).alias("nx"), F.col(side_y).alias("ny"), "pixels").join(
        sizes.select(F.col(stack).alias("stack"), "_n"), "stack").repartition(F.xxhash64("stack")).sortWithinPartitions("stack", "index")

    def run(batches):
        current = None

        def close(done):
            done["file"].close()
            # the file had another name until it was whole, so a repeated task leaves no torn one
            done["system"].move(done["part"], done["inner"])
            return pa.RecordBatch.from_arrays([pa.array([done["target"]]), pa.array([done["n"]], pa.int64())], names=["path", "n"])

        for batch in batches:
            names = batch.column(0).to_pylist()
            start = 0
            while start < len(names):
                stop = start
                while stop < len(names) and names[stop] == names[start]:
                    stop += 1
                if current is None or current["stack"] != names[start]:
                    if current is not None:
                        yield close(current)
                    target = base + str(names[start])
                    system, inner = fs.FileSystem.from_uri(target if "://" in target else target.removeprefix("file:"))
                    system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                    part = f"{inner}.{uuid.uuid4().hex}.part"
                    row = {n: batch.column(batch.schema.get_field_index(n))[start].as_py() for n in ("nx", "ny", "_n")}
                    current = {"stack": names[start], "target": target, "system": system, "inner": inner, "part": part, "n": 0,
                               "file": system.open_output_stream(part)}
                    current["file"].write(make_header(row["nx"], row["ny"], row["_n"], px))
                pixels = batch.column(batch.schema.get_field_index("pixels")).slice(start, stop - start)
                current["file"].write(pixels.flatten().to_numpy(zero_copy_only=False).astype("<f4").tobytes())
                current["n"] += stop - start
                start = stop
        if current is not None:
            yield close(current)
    return ordered.mapInArrow(run, "path string, n bigint")


def rewrite_stacks(images: DataFrame, plan: DataFrame, folder: str, px: float = 1.0) -> DataFrame:
    """Images (stack, index) copied into the new stacks and places of a regrouping plan (stack, index, new_stack, new_index)."""
    moved = images.join(plan, ["stack", "index"]).select(
        F.concat(F.lit("stack_"), F.lpad(F.col("new_stack").cast("string"), 6, "0"), F.lit(".mrcs")).alias("stack"),
        F.col("new_index").alias("index"), "nx", "ny", "pixels")
    return write_stacks(moved, folder, px=px)
