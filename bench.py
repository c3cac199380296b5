"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from duolex import suite  # noqa: E402
from duolex.session import build_session  # noqa: E402

HEADLINE = (
    "top_words word_frequency normalize_text mirror stratified_split shuffle row_budget pair_cosine meteor_corpus "
    "build_examples debounce read_lines write_splits clean_corpus prepare_corpus build_dictionary fuzzy_lookup "
    "segment_words correct_text evaluate_translations"
).split()


def run(spark, folder: str, name: str) -> float:
    """Seconds to compute every row of a query, without bringing rows to the driver."""
    began = time.time()
    suite.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.time() - began


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("duolex-bench", cores)
    seconds = {}
    for name in names:
        # The first run warms the JVM; the second is reported.
        cold = run(spark, folder, name)
        seconds[name] = round(run(spark, folder, name), 3)
        print(f"{name}: {cold:.2f}s cold, {seconds[name]:.2f}s warm", file=sys.stderr, flush=True)
    spark.stop()
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_warm_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(folder).removeprefix("sf")}))


if __name__ == "__main__":
    main()
