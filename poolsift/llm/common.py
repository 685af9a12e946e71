"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare

# rows per Arrow batch between the JVM and a Python worker; long texts make a
# default batch of 10,000 rows too large for a worker's memory
ARROW_ROWS = 512
# bytes of text that one numpy pass works on
SLICE_BYTES = 1 << 20


def ready(spark: SparkSession) -> SparkSession:
    """Checkpoint folder, package shipping and small Arrow batches."""
    prepare(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) != ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def plain_names(docs: DataFrame) -> tuple[DataFrame, dict]:
    """The same table with columns c0, c1, ..., which clash with no working column, and the new name of each."""
    new = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*new.values()), new


def own_names(df: DataFrame, new: dict, *added: str) -> DataFrame:
    """Back to the documents' names; an added column replaces one of its name."""
    return df.select(*[F.col(c).alias(name) for name, c in new.items() if name not in added], *added)


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text (null read as empty), under names that clash with nothing."""
    return docs.select(F.col(id_col).cast("long").alias("__id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column as one uint8 array and its row offsets (starting at 0)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if len(col) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str = "__text", most: int = SLICE_BYTES):
    """Row ranges of a batch with about ``most`` bytes of text each (one row at least)."""
    lengths = np.diff(utf8(batch.column(text))[1])
    ends = np.cumsum(lengths)
    lo, done = 0, 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield batch.slice(lo, hi - lo)
        lo, done = hi, int(ends[hi - 1])


def whitespace_table() -> np.ndarray:
    """Marks the bytes 0x20 and 0x09-0x0D; no byte of a longer UTF-8 sequence is among them."""
    t = np.zeros(256, bool)
    t[[0x20, *range(0x09, 0x0E)]] = True
    return t


def empty_like(schema: str, spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], schema)
