"""Headline queries on local cores; prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the cores, BENCH_ROUNDS the timed runs per query (best
counts). Each query is run to the end with the no-op sink after one untimed run.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidewall.plans import catalog  # noqa: E402
from tidewall.session import local_session  # noqa: E402

HEADLINE = (
    "P1_pii_scan",
    "P7_redact_text",
    "P12_score_context",
    "flagship_protect_documents",
    "T9_scan_markup",
    "T6_entropy",
    "A8_abac_decide",
    "U4_audit_stats",
    "I1_content_hash",
    "I5_verify_chunks",
    "L1_valid_transitions",
    "N2_shortest_path",
)
# queries whose rate in MB of text per second is reported
TEXT_OF = {
    "P1_pii_scan": ("documents", "text"),
    "P7_redact_text": ("documents", "text"),
    "flagship_protect_documents": ("documents", "text"),
    "I1_content_hash": ("documents", "text"),
    "T9_scan_markup": ("pages", "html"),
    "T6_entropy": ("pages", "html"),
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    rounds = int(os.environ.get("BENCH_ROUNDS", "2"))
    catalog.load_all()
    spark = local_session(cores, "bench")
    times: dict[str, float] = {}
    rates: dict[str, float] = {}
    for name in HEADLINE:
        fn = catalog.QUERIES[name]
        best = None
        for i in range(rounds + 1):
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            spent = time.perf_counter() - t0
            if i:
                best = spent if best is None else min(best, spent)
        times[name] = round(best, 3)
        if name in TEXT_OF:
            table, col = TEXT_OF[name]
            size = spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(f"sum(octet_length({col}))").first()[0]
            rates[name] = round(size / 1e6 / best, 1)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "mb_per_sec": rates,
                "cores": cores,
                "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
            }
        )
    )


if __name__ == "__main__":
    main()
