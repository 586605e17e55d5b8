"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from docketflow.plans.all_queries import all_queries  # noqa: E402
from docketflow.plans.deck_queries import _run  # noqa: E402
from docketflow.session import build_session  # noqa: E402

HEADLINE = [
    "sco1_weighted_score", "sco1_results_by_submission", "sco2_clean_scores", "sco4_finalize_reviews",
    "asg1_auto_assign_empty", "asg1_auto_assign_chosen", "rep6_attention_list", "rep9_results", "rep11_shift_summary",
    "rep13_assignment_rows", "src21_shift_dataset", "aud5_visible_submissions", "aud6_lifecycle_violations",
    "txt1_clean_text", "txt3_split_sentences", "int1_instruction_documents", "src3_file_validation",
    "src5_round_intake", "src6_duplicates", "src8_units_from_documents", "src8_units_from_pages",
    "vis1_span_signals", "vis6_merged_signals", "int_flags", "int_report", "ctx_views", "ctx_sentences",
    "ext_topics", "ext_claims", "rub_criteria", "ver_items", "brf_evidence_rows", "grd_ground_refs",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "20g",
        "spark.ui.showConsoleProgress": "false", "docketflow.spread": cpus,
    })
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    wanted = sys.argv[1:] or HEADLINE
    queries["rep8_recent_events"](spark, folder).write.format("noop").mode("overwrite").save()  # start-up cost
    times: dict[str, float] = {}
    if any(name.startswith(("ext_", "rub_", "ver_", "brf_")) for name in wanted):
        start = time.perf_counter()
        _run(spark, folder)  # the findings all these queries read, written once
        times["findings_write"] = round(time.perf_counter() - start, 3)
    for name in wanted:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": folder.rstrip("/").split("sf")[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
