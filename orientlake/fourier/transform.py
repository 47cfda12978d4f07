"""Three-dimensional transforms of voxel rows in two grouped passes.

The first pass takes the (z, y) plane at each x, the second the x lines at
each z. A group is one plane of one volume, gathered as arrays by a plain
aggregate; the kernel then transforms whole Arrow batches of planes at once.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

VALUES = T.ArrayType(T.DoubleType())
PLANE_BUDGET = 1 << 24


def _planes(df: DataFrame, keep: list[str], size: int, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Rows of sparse planes (at, re, im) through ``kernel`` on dense [N, size] stacks; dense rows out."""
    schema = T.StructType([*[df.schema[k] for k in keep], T.StructField("re", VALUES), T.StructField("im", VALUES)])


    def pack(values: np.ndarray) -> pa.Array:
        flat = np.ascontiguousarray(values, dtype=float)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, flat.shape[1], dtype=np.int32)), pa.array(flat.ravel()))

    def run(batches):
        step = max(1, PLANE_BUDGET // (16 * size))
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                b = whole.slice(start, step)
                at, re, im = (b.column(b.schema.get_field_index(n)) for n in ("at", "re", "im"))
                rows = np.repeat(np.arange(b.num_rows), at.value_lengths().to_numpy(zero_copy_only=False))
                p = np.zeros((b.num_rows, size), dtype=complex)
                p[rows, at.flatten().to_numpy()] = re.flatten().to_numpy() + 1j * im.flatten().to_numpy()
                out = kernel(p)
                yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(k)) for k in keep], pack(out.real), pack(out.imag)],
                                                 names=[*keep, "re", "im"])
    return df.select(*keep, "at", "re", "im").mapInArrow(run, schema)


def transform3(df: DataFrame, group: list[str], side: int, kind: str = "forward", re: str = "re", im: str | None = "im",
               recentre: bool = False) -> DataFrame:
    """Voxel rows in, voxel rows out, columns ``re`` and ``im``.

    forward: transform with the origin of the result at side / 2. inverse: from
    there back. half_inverse: from a half plane (x from 0, z and y centred) to
    real values. ``recentre`` moves the origin of the real side to the middle.
    Missing voxels are zero.
    """
    if kind not in ("forward", "inverse", "half_inverse"):
        raise ValueError("kind must be forward, inverse or half_inverse")
    width = side // 2 + 1 if kind == "half_inverse" else side

    def plane(p: np.ndarray) -> np.ndarray:
        p = p.reshape(-1, side, side)
        axes = (1, 2)
        if kind == "forward":
            p = np.fft.fftshift(p, axes) if recentre else p
            p = np.fft.fftshift(np.fft.fft2(p), axes)
        else:
            p = np.fft.ifft2(np.fft.ifftshift(p, axes))
            p = np.fft.ifftshift(p, axes) if recentre else p
        return p.reshape(-1, side * side)

    def line(p: np.ndarray) -> np.ndarray:
        p = p.reshape(-1, width, side)
        if kind == "forward":
            p = np.fft.fftshift(p, 1) if recentre else p
            p = np.fft.fftshift(np.fft.fft(p, axis=1), 1)
        elif kind == "inverse":
            p = np.fft.ifft(np.fft.ifftshift(p, 1), axis=1)
        else:
            p = np.fft.irfft(p, n=side, axis=1).astype(complex)
        if recentre and kind != "forward":
            p = np.fft.ifftshift(p, 1)
        return p.reshape(len(p), -1)

    imaginary = F.col(im).cast("double") if im else F.lit(0.0)
    source = df.select(*group, F.col("x").cast("int").alias("x"), F.struct(
        (F.col("z") * side + F.col("y")).cast("int").alias("at"), F.col(re).cast("double").alias("re"), imaginary.alias("im")).alias("c"))
    at_x = source.groupBy(*group, "x").agg(F.collect_list("c").alias("c")).select(*group, "x", "c.at", "c.re", "c.im")
    turned = _planes(at_x, [*group, "x"], side * side, plane)
    rows = turned.select(*group, "x", F.explode(F.transform(F.sequence(F.lit(0), F.lit(side - 1)), lambda z: F.struct(
        z.alias("z"), F.slice("re", z * side + 1, side).alias("re"), F.slice("im", z * side + 1, side).alias("im")))).alias("l"))
    at_z = rows.select(*group, "l.z", F.struct("x", "l.re", "l.im").alias("c")).groupBy(*group, "z").agg(F.collect_list("c").alias("c"))
    places = F.flatten(F.transform("c.x", lambda x: F.transform(F.sequence(F.lit(0), F.lit(side - 1)), lambda y: (x * side + y).cast("int"))))
    flat = at_z.select(*group, "z", places.alias("at"), F.flatten("c.re").alias("re"), F.flatten("c.im").alias("im"))
    done = _planes(flat, [*group, "z"], width * side, line)
    return done.select(*group, "z", F.posexplode(F.arrays_zip("re", "im")).alias("i", "v")).select(
        *group, F.col("z").cast("int").alias("z"), F.expr(f"cast(i % {side} as int)").alias("y"), F.expr(f"cast(i div {side} as int)").alias("x"),
        "v.re", "v.im")
