"""Run queries against DuckDB: python -m verification.run [sf_dir] [key ...]"""

from __future__ import annotations

import sys
import time

from blobtide.scratch import drop_scratch
from blobtide.session import build_session
from verification.catalog import CHECKS
from verification.compare import connect, differences


def main(sf_dir: str = "/root/testdata/sf0.01", *keys: str) -> int:
    spark = build_session(
        "verification",
        "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    failed = 0
    for key in keys or CHECKS:
        start = time.time()
        try:
            found = differences(
                CHECKS[key].run(spark, sf_dir), connection, CHECKS[key].statement()
            )
        except Exception as error:  # report and go on with the next query
            found = [f"{type(error).__name__}: {str(error)[:1500]}"]
        drop_scratch(spark)
        failed += bool(found)
        print(f"{'FAIL' if found else 'ok'} {key} {time.time() - start:.1f}s", flush=True)
        for line in found:
            print("   ", line, flush=True)
    print(f"{failed} failed", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(bool(main(*sys.argv[1:])))
