"""Check every query, or those whose name contains an argument, and print timings.

usage: python tests/run_all.py [folder] [name-part ...]
"""

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tests.compare import check, connect  # noqa: E402
from tidemark.plans import CATALOG  # noqa: E402
from tidemark.session import get_session  # noqa: E402


def main() -> None:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    parts = sys.argv[2:]
    spark = get_session(
        "check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
                                "spark.driver.memory": "12g", "spark.log.level": "ERROR"}
    )
    con = connect(folder)
    failed = []
    for name, q in CATALOG.items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            rows, diff = check(q, spark, con, folder)
        except Exception as e:  # report and go on with the next query
            rows, diff = -1, f"{type(e).__name__}: {str(e)[:600]}"
            if "-v" in os.environ.get("CHECK_FLAGS", ""):
                traceback.print_exc()
        mark = "ok " if diff is None else "BAD"
        if diff is None and rows == 0:
            mark = "nil"
        print(f"{mark} {name} rows={rows} {time.time() - start:.2f}s", flush=True)
        if diff is not None:
            failed.append(name)
            print("    ", diff[:1200], flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
