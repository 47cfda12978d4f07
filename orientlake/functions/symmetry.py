"""Point groups as small constant sets of rotation matrices."""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, functions as F


def _turn(axis, order: int) -> np.ndarray:
    a = np.asarray(axis, dtype=float)
    a /= np.linalg.norm(a)
    t = 2 * math.pi / order
    k = np.array([[0, -a[2], a[1]], [a[2], 0, -a[0]], [-a[1], a[0], 0]])
    return np.eye(3) + math.sin(t) * k + (1 - math.cos(t)) * (k @ k)


# Group generators as (axis, fold).
_GENERATORS = {
    "T": [((0, 0, 1), 2), ((1, 1, 1), 3)],
    "O": [((0, 0, 1), 4), ((1, 1, 1), 3)],
    "I": [((0, 0, 1), 2), ((1, 1, 1), 3), ((0, 1, (1 + math.sqrt(5)) / 2), 5)],
}


@lru_cache(maxsize=None)
def group_matrices(name: str) -> tuple[tuple[float, ...], ...]:
    """All operators of C<n>, D<n>, T, O or I as row-major 9-tuples, identity first."""
    label = name.upper()
    cyclic = re.fullmatch(r"([CD])(\d+)", label)
    if cyclic:
        n = int(cyclic.group(2))
        if n < 1:
            raise ValueError(f"bad symmetry {name}")
        turns = [_turn((0, 0, 1), n / k) if k else np.eye(3) for k in range(n)]
        ops = turns if cyclic.group(1) == "C" else [m for t in turns for m in (t, t @ np.diag([1.0, -1.0, -1.0]))]
    elif label in _GENERATORS:
        gens = [_turn(*g) for g in _GENERATORS[label]]
        ops = [np.eye(3)]
        for m in ops:  # grows while it is read, until closed
            for g in gens:
                p = m @ g
                if not any(np.allclose(p, q, atol=1e-9) for q in ops):
                    ops.append(p)
    else:
        raise ValueError(f"unknown symmetry {name}; use C<n>, D<n>, T, O or I")
    return tuple(tuple(float(v) for v in np.where(np.abs(m) < 1e-15, 0.0, m).ravel()) for m in ops)


def sector_fold(name: str) -> int:
    """Fold of the principal z axis of a C or D group."""
    return int(re.fullmatch(r"[CD](\d+)", name.upper()).group(1))


def operator_array(name: str) -> Column:
    """The group as one constant array of (op, s00..s22) structs, to be exploded."""
    return F.array(*[
        F.struct(F.lit(i).alias("op"), *[F.lit(v).alias(f"s{k // 3}{k % 3}") for k, v in enumerate(m)])
        for i, m in enumerate(group_matrices(name))])
