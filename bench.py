"""Wall time per registered query: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the data and the cores."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from hopscore.session import local_session  # noqa: E402
from workload import QUERIES  # noqa: E402


def seconds(run) -> float:
    begin = time.time()
    run()
    return round(time.time() - begin, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    spark = local_session(cores, **{"spark.ui.showConsoleProgress": "false"})
    names = sys.argv[1:] or list(QUERIES)

    def run(name: str) -> None:
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()

    run(names[0])  # warm-up
    times = {}
    for name in names:
        times[name] = sorted(seconds(lambda: run(name)) for _ in range(repeats))[repeats // 2]
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total query time", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(folder)}))


if __name__ == "__main__":
    main()
