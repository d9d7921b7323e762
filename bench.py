"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from compframe.catalog import load  # noqa: E402
from compframe.session import local_session  # noqa: E402

HEADLINE = [
    "export_deals", "valuation_ladder", "town_size_median", "deal_score", "duplicate_profiles", "duplicate_clusters",
    "alert_match", "browse_page_best", "keep_latest", "incremental_merge", "fill_districts", "extract_auctions",
    "extract_cards", "post_classify", "market_by_city", "burst_admitted",
    "comparables_topk", "rule_match", "city_quartiles", "similarity_pairs", "stream_dedupe",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, cpus)
    queries = load()[0]
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times,
                      "sf": Path(sf_dir).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
