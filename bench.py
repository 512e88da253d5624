"""Headline timings: one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from textwarden.operators import analytics, events as ev, sessions
from textwarden.operators.redact import redact
from textwarden.operators.scan import detect, scan
from textwarden.plans.queries import REGISTRY, event_rows
from textwarden.sources import adapters, sinks

FROM_TEXT = ["detector_rollup", "entropy_reasons", "narrative_rollup", "linear_scores", "policy_hits",
             "redaction_rules", "evaluation_matrix"]
FROM_EVENTS = {
    "risk_summary": analytics.risk_summary,
    "by_destination": analytics.by_destination,
    "by_employee": analytics.by_employee,
    "threat_radar": analytics.threat_radar,
    "top_tags": analytics.top_tags,
    "last_100_per_device": ev.last_per_device,
    "alerts": ev.alerts,
    "leak_sessions": lambda e: sessions.leak_sessions(e.withColumn("ts", F.timestamp_millis("timestamp"))),
    "risk_trend": lambda e: sessions.risk_trend(e.withColumn("ts", F.timestamp_millis("timestamp"))),
}


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name: str, action, repeats: int = 1) -> None:
        """Median of the repeats, each of the whole job."""
        spent = []
        for _ in range(repeats):
            start = time.perf_counter()
            action()
            spent.append(time.perf_counter() - start)
        times[name] = round(statistics.median(spent), 3)

    documents = adapters.payloads_documents(spark, folder)
    size = documents.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    run(scan(documents))  # the first job also compiles and starts the JVM's threads
    timed("detect_documents", lambda: run(detect(documents)), 3)
    timed("scan_documents", lambda: run(scan(documents)), 3)
    timed("redact_documents", lambda: run(redact(documents)), 3)
    for name in FROM_TEXT:
        timed(name, lambda: run(REGISTRY[name](spark, folder)))

    # the event table is written once; the analytics read it
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local["):
        raise SystemExit("set spark.checkpoint.dir to a folder all executors share")
    root = root or tempfile.gettempdir()
    scratch = f"{root.rstrip('/')}/bench-{uuid.uuid4().hex}"
    timed("write_event_table", lambda: sinks.write_events(event_rows(spark, folder), f"{scratch}/events"))
    stored = sinks.read_events(spark, f"{scratch}/events")
    for name, rollup in FROM_EVENTS.items():
        timed(f"events_{name}", lambda: run(rollup(stored)))

    scanning = times["scan_documents"]
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")), "cores": int(cpus),
        "scan_payloads_per_sec": round(size.n / scanning, 1), "scan_mb_per_sec": round(size.b / 1e6 / scanning, 2),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
