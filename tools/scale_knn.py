"""kNN scale check: pool replicated from ``embeddings`` with new ids.

For each pool size and query count, times the exact ``knn_join`` (k = 50)
and reports the shuffle bytes written, then times the IVF form and its
recall against exact.  Stage metrics come from Spark's status tracker via
the event log in a scratch folder (no UI).  Prints one JSON line per case.

Usage: python tools/scale_knn.py [sf_dir] [pool sizes, comma] [query counts, comma]
"""

from __future__ import annotations

import json
import math
import os
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def shuffle_bytes(log_dir: str) -> int:
    total = 0
    files = [os.path.join(d, f) for d, _, fs in os.walk(log_dir) for f in fs]
    for name in files:
        with open(name, errors="replace") as fh:
            for line in fh:
                if '"Event":"SparkListenerTaskEnd"' not in line:
                    continue
                ev = json.loads(line)
                m = ev.get("Task Metrics") or {}
                total += (m.get("Shuffle Write Metrics") or {}).get("Shuffle Bytes Written", 0)
    return total


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    sizes = [int(x) for x in (sys.argv[2] if len(sys.argv) > 2 else "100000,1000000").split(",")]
    nqs = [int(x) for x in (sys.argv[3] if len(sys.argv) > 3 else "20,500").split(",")]
    from pyspark.sql import functions as F

    from poolsift.operators.similarity import build_ivf, ivf_knn, knn_join, recall_at_k
    from poolsift.session import cut_lineage, get_session

    log_root = tempfile.mkdtemp(prefix="scale-knn-events-", dir="/tmp")
    spark = get_session("local[8]", shuffle_partitions=16,
                        extra={"spark.eventLog.enabled": "true", "spark.eventLog.dir": f"file://{log_root}",
                               "spark.eventLog.rolling.enabled": "false", "spark.eventLog.compress": "false"})
    base = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    n0 = base.count()
    for size in sizes:
        reps = math.ceil(size / n0)
        pool = (base.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
                .select((F.col("rep") * n0 + F.col("vec_id")).alias("uid"),
                        F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
                .filter(F.col("uid") < size).repartition(max(8, size // 50_000)))
        pool = cut_lineage(pool)
        t0 = time.perf_counter()
        cells, centers, _ = build_ivf(pool, n_cells=32, seed=42)
        cells = cut_lineage(cells)
        t_build = time.perf_counter() - t0
        for nq in nqs:
            queries = pool.orderBy(F.xxhash64("uid")).limit(nq)
            queries = cut_lineage(queries.withColumn("uid", F.col("uid") + F.lit(10 ** 12)))
            before = shuffle_bytes(log_root)
            t0 = time.perf_counter()
            exact = cut_lineage(knn_join(queries, pool, k=50))
            t_exact = time.perf_counter() - t0
            sb = shuffle_bytes(log_root) - before
            t0 = time.perf_counter()
            approx = cut_lineage(ivf_knn(queries, cells, centers, k=50, n_probe=4))
            t_ivf = time.perf_counter() - t0
            rec = recall_at_k(approx, exact).first()["recall"]
            print(json.dumps({"pool": size, "queries": nq, "k": 50, "exact_sec": round(t_exact, 2),
                              "exact_shuffle_bytes": sb, "rows": exact.count(), "ivf_build_sec": round(t_build, 2),
                              "ivf_query_sec": round(t_ivf, 2), "ivf_recall": round(rec, 4), "n_probe": 4,
                              "n_cells": 32}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
