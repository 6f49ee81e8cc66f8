"""Run registered queries against their SQL: ``python tests/run_checks.py [folder] [name part ...]``."""

import sys
import time
import traceback
from pathlib import Path

sys.path[:0] = [str(Path(__file__).resolve().parent.parent), str(Path(__file__).resolve().parent)]

from compare import connect, difference  # noqa: E402

import __spark_entry__ as contract  # noqa: E402
from tabwright.storage import local_session  # noqa: E402


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    parts = sys.argv[2:]
    spark, con, oracles, bad = local_session(8, "8g"), connect(folder), contract.oracle_sql(), 0
    for name, run in contract.queries().items():
        if parts and not any(name.startswith(p) for p in parts):
            continue
        start = time.time()
        try:
            df = run(spark, folder)
            result = difference(df, con, oracles[name]) if name in oracles else f"rows only: {len(df.collect())}"
        except Exception as e:
            result = f"{type(e).__name__}: {str(e)[:600]}"
            if "-v" in parts:
                traceback.print_exc()
        ok = result is None or result.startswith("rows only")
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {result or ''}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
