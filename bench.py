"""Times the registered queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Usage: python bench.py [name ...]   (default: every registered query)
"""

from __future__ import annotations

import json
import os
import sys
import time

from docweave import catalog
from docweave.session import local_session


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    known = catalog.load()
    names = sys.argv[1:] or list(known)
    # One small query first, so that session and code generation start-up is not charged to the first name.
    known["suppliers_by_nation"](spark, sf_dir).write.format("noop").mode("overwrite").save()

    seconds = {}
    for name in names:
        started = time.monotonic()
        known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.monotonic() - started, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "registered queries, total seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
