"""Runs a query and its checking SQL on the same tables and compares all values."""

from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None:
        return None
    if isinstance(v, float) or type(v).__name__ in ("float32", "float64", "Decimal"):
        f = float(v)
        return None if math.isnan(f) else f
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return bool(v)
    if type(v).__name__.startswith(("int", "uint")):
        return int(v)
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return tuple(_cell(x) for x in v)
    return str(v)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=lambda r: tuple(_key(c) for c in r))


def _key(c):
    if isinstance(c, tuple):
        return (3, str(c))
    if c is None:
        return (0, "")
    if isinstance(c, (int, float)):
        return (1, round(float(c), 4), "")
    return (2, c)


def _same(a, b, tol=2e-6):
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(_same(x, y, tol) for x, y in zip(a, b))
    if isinstance(a, float) or isinstance(b, float):
        if a is None or b is None:
            return a is b
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=tol)
    return a == b


def compare(df, con, sql: str) -> tuple[int, list[str], int]:
    """(row count, complaints, exact cell mismatches)."""
    names, mine = _rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_names, want = _rows([d[0] for d in cur.description], cur.fetchall())
    faults = []
    if names != want_names:
        faults.append(f"columns {names} / {want_names}")
    if len(mine) != len(want):
        faults.append(f"rows {len(mine)} / {len(want)}")
    exact = 0
    if not faults:
        for a, b in zip(mine, want):
            if a != b:
                exact += 1
            if not _same(a, b):
                faults.append(f"{a} / {b}")
                if len(faults) > 3:
                    break
    return len(mine), faults, exact
