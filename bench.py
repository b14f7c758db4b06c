"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the number of cores.  Every query is
written to the no-op sink, so its whole result is computed.  Each runs twice: ``queries``
holds the second run, ``first_run`` the one that also compiles its code.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from cargolens import plans  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = (
    "url_extraction",
    "network_indicators",
    "network_findings",
    "corpus_leak_report",
    "secret_findings",
    "corpus_secret_findings",
    "framework_vote",
    "allowlist_findings",
    "blocklist_findings",
    "pattern_findings",
    "member_totals",
    "compression_findings",
    "extraction_budget",
    "format_findings",
    "embedded_executables",
    "bundle_findings",
    "kv_findings",
    "deduped_findings",
    "artifact_summary",
    "category_report",
    "sarif_results",
    "sbom_vulnerabilities",
    "stream_counts",
)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    known = plans.queries()
    names = [n for n in HEADLINE if n in known]

    def run(name: str) -> float:
        start = time.perf_counter()
        known[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    first = {name: round(run(name), 3) for name in names}
    seconds = {name: round(run(name), 3) for name in names}
    rows = sum(
        spark.read.parquet(f"{SF_DIR}/{t}.parquet").count()
        for t in ("documents", "pages", "lineitem", "orders", "events")
    )
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "first_run": first,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "source_rows": rows,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
