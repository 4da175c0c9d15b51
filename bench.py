"""Time the headline queries: ``BENCH_SF_DIR`` on ``local[BENCH_CPUS]``, one JSON line out."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from siftline.catalog.queries import QUERIES  # noqa: E402
from siftline.session import build_session  # noqa: E402

HEADLINE = [
    "curated_distribution",
    "dedupe_first",
    "stratified_sample",
    "stratified_split",
    "quota_sample",
    "balanced_holdout",
    "take_split",
    "exclude_seen",
    "filter_funnel",
    "mine_fix_pairs_strict",
    "mine_fix_pairs_loose",
    "fix_sets_strict",
    "tokens_legacy",
    "tokens_bug_aware",
    "term_stats",
    "vocabulary_bug_aware",
    "tfidf_bug_aware",
    "tfidf_legacy",
    "encode_fixed",
    "ast_features",
    "extract_functions",
    "confusion_matrix",
    "classification_report",
    "forest_scores",
    "boosted_scores",
    "review_files",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_wall", "value": total, "unit": "sec", "queries": seconds, "sf": Path(sf_dir).name}))
    spark.stop()


if __name__ == "__main__":
    main()
