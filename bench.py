"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import time

from corpusloom import catalog
from corpusloom.session import local_session

HEADLINE = (
    "review_corpus",
    "newsgroup_corpus",
    "movie_corpus",
    "newswire_corpus",
    "news_corpus",
    "clean_reviews",
    "term_frequency",
    "vocab_fit_scope",
    "svmlight_lines",
    "split_nested",
    "sample_per_category",
    "positions",
    "topic_rollup",
)


def run(spark, sf_dir: str, name: str) -> float:
    start = time.perf_counter()
    catalog.queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("OFF")
    run(spark, sf_dir, HEADLINE[0])  # once untimed, so that starting the engine is not measured
    times = {name: round(run(spark, sf_dir, name), 3) for name in HEADLINE}
    scale = re.search(r"sf([\d.]+)", sf_dir)
    result = {
        "metric": "total_query_time",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(scale.group(1)) if scale else None,
    }
    print(json.dumps(result), flush=True)


if __name__ == "__main__":
    main()
