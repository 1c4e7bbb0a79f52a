"""Command line: python tests/run_checks.py [sf_dir] [key prefix ...]"""

from __future__ import annotations

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as entry  # noqa: E402
from compare import compare, connect  # noqa: E402

from sessionloom.session import local_session  # noqa: E402


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:]) or ("",)
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con, oracle = connect(sf_dir), entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            if name in oracle:
                outcome = compare(spark, con, query, oracle[name], sf_dir)
            else:
                outcome = None
                df = query(spark, sf_dir)
                print("   rows only:", len(df.columns), df.count(), df.limit(3).collect()[:2])
        except Exception as e:  # noqa: BLE001
            outcome = "ERROR " + (traceback.format_exc()[-1500:] if "-v" in os.environ.get("CHECK", "") else str(e)[:600])
        bad += outcome is not None
        print(f"{'ok ' if outcome is None else 'BAD'} {name} {time.time() - start:.2f}s {outcome or ''}", flush=True)
    print("bad:", bad)


main()
