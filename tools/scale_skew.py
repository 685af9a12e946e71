"""Skew check for seeded sampling: one group holds a third of all rows.

Compares ``hash_top_n`` (histogram path) with a plain ``row_number()`` window
over the same groups: wall time and the largest number of shuffle records
read by any single task (Spark event log in a scratch folder).
Usage: python tools/scale_skew.py [rows] [n]
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def task_records(log_dir: str) -> list[int]:
    out = []
    for d, _, fs in os.walk(log_dir):
        for f in fs:
            with open(os.path.join(d, f), errors="replace") as fh:
                for line in fh:
                    if '"Event":"SparkListenerTaskEnd"' in line:
                        m = json.loads(line).get("Task Metrics") or {}
                        out.append((m.get("Shuffle Read Metrics") or {}).get("Total Records Read", 0))
    return out


def main():
    rows = int(sys.argv[1]) if len(sys.argv) > 1 else 3_000_000
    n = int(sys.argv[2]) if len(sys.argv) > 2 else 100_000
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from poolsift.functions.hashing import order_key
    from poolsift.operators.sampling import hash_top_n
    from poolsift.session import cut_lineage, get_session

    logs = tempfile.mkdtemp(prefix="skew-events-", dir="/tmp")
    spark = get_session("local[8]", shuffle_partitions=64, extra={
        "spark.eventLog.enabled": "true", "spark.eventLog.dir": f"file://{logs}",
        "spark.eventLog.rolling.enabled": "false", "spark.eventLog.compress": "false",
        "spark.sql.adaptive.coalescePartitions.enabled": "false"})
    # group 0 holds a third of the rows; the rest spread over 1,000 groups
    df = spark.range(rows).select(F.col("id").alias("uid"),
                                  F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 1000 + 1).alias("g"))
    df = cut_lineage(df.repartition(32))
    results = {}
    for name, build in (
        ("hash_top_n", lambda: hash_top_n(df, n, by=["g"], seed=7)),
        ("plain_window", lambda: df.withColumn("__k", order_key(7, "uid")).withColumn(
            "__r", F.row_number().over(Window.partitionBy("g").orderBy("__k", "uid"))).filter(F.col("__r") <= n)),
    ):
        before = len(task_records(logs))
        t0 = time.perf_counter()
        kept = build().count()
        dt = time.perf_counter() - t0
        recs = task_records(logs)[before:]
        results[name] = {"sec": round(dt, 2), "rows_kept": kept, "max_task_shuffle_records": max(recs or [0]),
                         "tasks": len(recs)}
    print(json.dumps({"rows": rows, "hot_group_rows": rows // 3, "n_per_group": n, **results}))
    spark.stop()


if __name__ == "__main__":
    main()
