"""Command line: column types of every query beside those of its checking SQL."""

import os
import sys

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]

import __spark_entry__ as entry  # noqa: E402
from harness import duck  # noqa: E402
from orientlake.session import build_session  # noqa: E402

NAMES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "float": "FLOAT", "date": "DATE",
         "timestamp": "TIMESTAMP"}

if __name__ == "__main__":
    sf = "/root/testdata/sf0.001"
    spark = build_session("types", "8")
    spark.sparkContext.setLogLevel("OFF")
    con = duck(sf)
    for name, sql in entry.oracle_sql().items():
        want = {r[0]: r[1] for r in con.execute(f"describe {sql}").fetchall()}
        mine = {c: NAMES.get(t, t) for c, t in entry.queries()[name](spark, sf).dtypes}
        bad = {c: (mine.get(c), want.get(c)) for c in {*mine, *want} if mine.get(c) != want.get(c)}
        if bad:
            print(name, bad, flush=True)
