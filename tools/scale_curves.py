"""Running-AUC check on long curves: list-per-row + Python trapezoid (as a
DuckDB list window with a Python UDF) against the window-sum form on Spark.

Curves: ``events`` of a scale factor, one curve per event type, step = row
order by (ts, event_id).  Prints one JSON line per scale factor.
Usage: python tools/scale_curves.py sf_dir [sf_dir ...]
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def main():
    import duckdb
    import numpy as np
    from duckdb.sqltypes import DOUBLE
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from poolsift.operators.curves import running_auc
    from poolsift.session import get_session

    spark = get_session("local[8]", shuffle_partitions=16)
    for sf_dir in sys.argv[1:] or ["/root/testdata/sf0.01"]:
        ev = spark.read.parquet(f"{sf_dir}/events.parquet")
        w = Window.partitionBy("event_type").orderBy("ts", "event_id")
        log = ev.select(F.col("event_type").alias("tag"), F.row_number().over(w).alias("step"), "value")
        t0 = time.perf_counter()
        spark_rows = running_auc(log, ["tag"]).agg(F.sum("auc")).first()[0]
        t_spark = time.perf_counter() - t0

        con = duckdb.connect()
        con.create_function("trapz_py", lambda x: float(np.trapezoid(x)) if len(x) > 1 else 0.0, ["DOUBLE[]"], DOUBLE)
        con.execute(f"""CREATE TABLE log AS SELECT event_type AS tag,
            row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS step, value
            FROM read_parquet('{sf_dir}/events.parquet')""")
        t0 = time.perf_counter()
        ddb = con.execute("""SELECT sum(trapz_py(v)) FROM (SELECT list(value) OVER (PARTITION BY tag ORDER BY step) AS v
                             FROM log)""").fetchall()[0][0]
        t_ddb = time.perf_counter() - t0
        n = con.execute("SELECT sum(c), max(c) FROM (SELECT tag, count(*) AS c FROM log GROUP BY tag)").fetchall()[0]
        print(json.dumps({"sf_dir": sf_dir, "rows": n[0], "longest_curve": n[1], "spark_window_sec": round(t_spark, 2),
                          "list_udf_sec": round(t_ddb, 2),
                          "same_total": abs(spark_rows - ddb) <= 1e-6 * max(1.0, abs(ddb))}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
