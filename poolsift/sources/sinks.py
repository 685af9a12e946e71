"""Sinks: Parquet (zstd), TSV, per-round JSON lines, labelled snapshots, datasets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: Sequence[str] = (),
                  compression: str = "zstd") -> str:
    w = df.write.mode(mode).option("compression", compression)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def write_tsv(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    df.write.mode(mode).option("sep", "\t").option("header", "true").csv(path)
    return path


def write_dataset(df: DataFrame, path: str, split_col: str = "split") -> str:
    """Dataset sink partitioned by split; refuses to overwrite an existing dataset."""
    return write_parquet(df, path, mode="errorifexists", partition_by=[split_col])


def id_arrays(df: DataFrame, keys: Sequence[str], id_col: str, array_name: str,
              max_len: int = 1000) -> DataFrame:
    """Group ids into arrays per key, at most about ``max_len`` ids per array.

    A key's rows are split into ``ceil(count / max_len)`` hash chunks (counts
    from a partial aggregate), so no task ever collects a whole hot key; the
    reader explodes the arrays back, so the chunking is invisible to it.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    chunked = df.join(counts, on=list(keys), how="inner").withColumn(
        "__chunk", F.pmod(F.xxhash64(F.col(id_col)), F.ceil(F.col("__n") / F.lit(max_len))))
    return (chunked.groupBy(*keys, "__chunk")
                   .agg(F.sort_array(F.collect_list(F.col(id_col))).alias(array_name))
                   .drop("__chunk"))


def _round_writer(df: DataFrame, round_col: str):
    """Per-round partitioned write with dynamic partition overwrite: writing a round
    again (a retried or re-run round) replaces that round only, so it is idempotent."""
    return (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(round_col))


def append_round_ids(ids: DataFrame, path: str, round_value: int, id_col: str = "uid",
                     array_name: str = "subpool_ids", group: Sequence[str] = (), max_len: int = 1000) -> str:
    """Add one round of JSON objects: id arrays (chunked) under ``labelling_round=<r>``."""
    obj = id_arrays(ids.withColumn("__g", F.lit(0)), [*group, "__g"], id_col, array_name, max_len) \
        .drop("__g").withColumn("labelling_round", F.lit(round_value).cast("int"))
    _round_writer(obj, "labelling_round").json(path)
    return path


def append_logits(scored: DataFrame, path: str, round_value: int, logits: str = "logits",
                  num_classes: int = 10, uid: str = "uid") -> str:
    """Add one round of instance logits (``logit_i`` columns, uid) under ``round=<r>``."""
    wide = scored.select(*[F.get(F.col(logits), i).alias(f"logit_{i}") for i in range(num_classes)],
                         F.col(uid).alias("uid"), F.lit(round_value).cast("int").alias("round"))
    _round_writer(wide, "round").parquet(path)
    return path


def labelled_snapshot(base: DataFrame, label_log: DataFrame, uid: str = "uid") -> DataFrame:
    """Base table left-joined to the label log: ``labelling_round`` and ``is_labelled``."""
    return (base.join(label_log.select(uid, "labelling_round"), on=uid, how="left")
                .withColumn("is_labelled", F.col("labelling_round").isNotNull()))


def write_snapshot(base: DataFrame, label_log: DataFrame, path: str, uid: str = "uid") -> str:
    """Overwrite the snapshot each round; rerunning a round rewrites the same content."""
    labelled_snapshot(base, label_log, uid).write.mode("overwrite").parquet(path)
    return path


def write_latin1_lines(lines: DataFrame, path: str, col: str = "labels") -> str:
    """One line per row, encoded as Latin-1; characters outside it become '?'."""
    plain = F.regexp_replace(F.col(col), r"[^\x00-\xFF]", "?")
    lines.select(F.encode(plain, "ISO-8859-1").cast("string").alias("value")).write.text(path)
    return path
