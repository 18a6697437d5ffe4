"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: median of three runs after a warm-up; one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from lodeworks.plans import catalogue

HEADLINE = (
    "chunk_char_window", "chunk_word_window", "chunk_passthrough_rows", "chunk_sentence_window", "consecutive_line_dedup", "knn_topk_cosine",
    "knn_batch_per_query", "triple_build", "triple_node_dedup", "triple_canonical_nodes", "triple_edge_dedup", "graph_context_like",
    "hybrid_context", "manifest_delta", "embedding_cache_hit", "massive_entity_profile", "short_chunk_merge", "reply_triple_parse",
)


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(4):
            start = time.perf_counter()
            catalogue.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        took[name] = round(statistics.median(runs[1:]), 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
