"""Structured Streaming forms of the run-file ingestion.

Run files are appended continuously while experiments run; these queries
consume them incrementally with checkpoints in the shared folder, so a
restarted (or executor-lost) query resumes exactly where it stopped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import committed

ROUND_SCHEMA = "run long, labelling_round int, subpool_ids array<int>"


def stream_round_ids(spark: SparkSession, src: str, sink: str, checkpoint: str,
                     schema: str = ROUND_SCHEMA, id_field: str = "subpool_ids", delay: str = "1 day") -> dict:
    """Ingest per-round JSON lines, explode the id arrays, drop repeated
    (run, round, id) rows, and append them to a Parquet table.  Runs with the
    ``availableNow`` trigger: processes what is there, then stops.

    A row's time is its file's modification time.  Rows that repeat within ``delay`` are dropped; ids
    whose files lie further back are forgotten, so the state holds the ids of one ``delay`` and not of
    all rounds.  Returns the rows kept in state at the end.
    """
    rows = (spark.readStream.schema(schema).json(src)
            .select("run", "labelling_round", F.explode(id_field).alias("uid"), F.col("_metadata.file_modification_time").alias("seen"))
            .withWatermark("seen", delay)
            .dropDuplicatesWithinWatermark(["run", "labelling_round", "uid"]).drop("seen"))
    q = (rows.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    last = q.lastProgress
    return {"state_rows": sum(op["numRowsTotal"] for op in (last["stateOperators"] if last else []))}


def stream_counts(spark: SparkSession, src_glob: str, schema, keys: Sequence[str], sink: str,
                  checkpoint: str, prepare=None) -> None:
    """Running counts per key from a file stream, in update mode.

    Each micro-batch writes only the keys it changed, under ``epoch=<batch id>``
    with dynamic partition overwrite (a retried batch rewrites its own epoch
    only).  ``read_counts`` returns the latest count per key.
    """
    rows = spark.readStream.schema(schema).parquet(src_glob)
    if prepare is not None:
        rows = prepare(rows)
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))

    def write(batch: DataFrame, epoch: int) -> None:
        (batch.withColumn("epoch", F.lit(epoch).cast("long")).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(sink))

    q = (counts.writeStream.outputMode("update").foreachBatch(write)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def _numbered(spark: SparkSession, root: str, key: str) -> list[int]:
    """The n of all folders ``<key>=<n>`` under ``root``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{key}="))


def _snapshot(spark: SparkSession, sink: str) -> int | None:
    """The last epoch of the newest committed snapshot."""
    done = [e for e in _numbered(spark, f"{sink}-compact", "upto") if committed(spark, f"{sink}-compact/upto={e}")]
    return max(done, default=None)


def read_counts(spark: SparkSession, sink: str, keys: Sequence[str]) -> DataFrame:
    """Current counts from a ``stream_counts`` sink: the latest value per key of the newest snapshot and the epochs behind it."""
    upto = _snapshot(spark, sink)
    epochs = [e for e in _numbered(spark, sink, "epoch") if upto is None or e > upto]
    parts = [spark.read.parquet(f"{sink}/epoch={e}").withColumn("epoch", F.lit(e).cast("long")) for e in epochs]
    if upto is not None:
        parts.insert(0, spark.read.parquet(f"{sink}-compact/upto={upto}").withColumn("epoch", F.lit(upto).cast("long")))
    if not parts:
        raise FileNotFoundError(f"{sink} has no counts")
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy(*keys).agg(F.max_by("n", "epoch").alias("n"))


def compact_counts(spark: SparkSession, sink: str, keys: Sequence[str]) -> int | None:
    """Folds all epochs into one snapshot (its ``_SUCCESS`` file commits it), then drops them and older snapshots.

    Call it between runs of the stream.  Readers that came before the commit use the epochs, later ones the snapshot.
    """
    epochs, old = _numbered(spark, sink, "epoch"), _snapshot(spark, sink)
    upto = max(epochs, default=old)
    if upto is None or upto == old:
        return old
    read_counts(spark, sink, keys).write.mode("overwrite").parquet(f"{sink}-compact/upto={upto}")
    stale = [f"{sink}/epoch={e}" for e in epochs] + [f"{sink}-compact/upto={e}" for e in _numbered(spark, f"{sink}-compact", "upto") if e < upto]
    for name in stale:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return upto


def stream_windowed_sums(spark: SparkSession, src_glob: str, schema, ts: str, value: str, window: str,
                         delay: str, sink: str, checkpoint: str, prepare=None) -> None:
    """Tumbling-window sums with a watermark, append mode: a window is written
    once, after the watermark passes its end; later rows for it are dropped."""
    rows = spark.readStream.schema(schema).parquet(src_glob)
    if prepare is not None:
        rows = prepare(rows)
    sums = (rows.withWatermark(ts, delay).groupBy(F.window(ts, window).alias("w"))
            .agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "total", "n"))
    q = (sums.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
