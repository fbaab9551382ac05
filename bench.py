"""Times the headline queries; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

HEADLINE = ["pair_counts_baskets", "pair_counts_docs_w2", "mi_baskets", "mi_docs", "top_mi_pairs", "mst_parse", "section_counts", "cosine_similarity", "connected_components", "substitute_pairs", "class_mi", "polysemy_divergence", "store_roundtrip"]


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from lexgraph.operators import mi
    from lexgraph.plans.queries import QUERIES
    from lexgraph.session import write_table

    spark.read.parquet(f"{d}/lineitem.parquet").count()
    times = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    # The scoring alone, of counts written before.
    for name in ("pair_counts_baskets", "pair_counts_docs_w2"):
        counts = write_table(QUERIES[name](spark, d), "bench")
        start = time.time()
        mi.mi_full(counts).write.format("noop").mode("overwrite").save()
        key = name.replace("pair_counts", "score")
        times[key] = round(time.time() - start, 3)
        print(key, times[key], counts.count(), "pairs", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(d.rstrip("/"))}))


if __name__ == "__main__":
    main()
