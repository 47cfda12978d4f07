"""Command line: python tests/check.py SF [name ...] - run queries against their checking SQL."""

import os
import sys
import time
import warnings

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
warnings.filterwarnings("ignore")

import __spark_entry__ as entry  # noqa: E402
from harness import compare, duck  # noqa: E402
from orientlake.session import build_session  # noqa: E402

if __name__ == "__main__":
    sf = sys.argv[1] if sys.argv[1].startswith("/") else f"/root/testdata/{sys.argv[1]}"
    queries, oracles = entry.queries(), entry.oracle_sql()
    wanted = sys.argv[2:] or list(queries)
    spark = build_session("check", "8")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    bad = 0
    for name in wanted:
        start = time.time()
        try:
            df = queries[name](spark, sf)
            if name in oracles:
                n, faults, exact = compare(df, con, oracles[name])
                state = "ok" if not faults else "FAULT"
            else:
                n, faults, exact, state = len(df.collect()), [], 0, "rows"
                if n == 0:
                    state = "EMPTY"
        except Exception as exc:  # noqa: BLE001
            n, faults, exact, state = -1, [str(exc)[:700]], 0, "ERROR"
        bad += state in ("FAULT", "ERROR", "EMPTY")
        print(f"{state:6s} {name:24s} rows={n} inexact={exact} {time.time() - start:.1f}s", *faults, sep=" | ", flush=True)
    print("bad:", bad, "of", len(wanted))
