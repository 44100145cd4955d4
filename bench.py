"""Wall time of the headline queries; prints one JSON line.

Every query runs as a whole job into Spark's no-op sink, after one warm-up query that
starts the workers. BENCH_SF_DIR and BENCH_CPUS choose data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

from tripweave.plans.registry import QUERIES
from tripweave.session import build_session

HEADLINE = (
    "weather_summary", "weather_silver", "hourly_explode", "daily_explode", "page_extract", "doc_dedupe",
    "match_enrich", "itinerary_active", "dashboard_summary", "itinerary_generate", "itinerary_add_auto",
    "itinerary_move", "packing_catalogue", "packing_rules", "upsert_weather", "upsert_packing",
    "cascade_delete", "quality_report", "embed_documents", "semantic_topk", "semantic_topk_batch",
    "semantic_ann", "text_search", "text_search_stemmed",
)


def main(names: list[str]) -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["embed_documents"](spark, folder).limit(1).collect()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total wall time of the headline queries", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:] or list(HEADLINE))
