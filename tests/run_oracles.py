"""CLI: compare every registered query with its SQL oracle.

    python tests/run_oracles.py [sf_dir] [name ...]
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from oracle_harness import compare, duck  # noqa: E402

from tillgrid.session import build_session  # noqa: E402


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = build_session("local[8]", shuffle_partitions=8, extra={"spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    import __spark_entry__ as e
    qs, orc = e.queries(), e.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for n in (names or sorted(qs)):
        t = time.time()
        try:
            r = compare(spark, n, qs[n], orc.get(n), sf_dir, con)
        except Exception as exc:  # report and continue
            r = {"name": n, "status": "error", "detail": f"{type(exc).__name__}: {str(exc)[:400]}"}
        r["sec"] = round(time.time() - t, 2)
        if r["status"] not in ("exact", "rows-only"):
            bad += 1
        print(json.dumps(r, ensure_ascii=False), flush=True)
    print(f"# {len(names or qs) - bad} ok, {bad} not exact", flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
