"""Tables kept by id: hashed into buckets of one sorted file each, so that a lookup
by id moves the ids and leaves the table where it lies.

The number of buckets is that of the shuffle partitions when the table is written.
A table is opened again in any session from its folder; a folder without a layout
beside it was never finished and cannot be opened.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import committed

LAYOUT = "id string, buckets int, columns string"


def write_id_table(df: DataFrame, path: str, on: str = "uid", buckets: int | None = None) -> DataFrame:
    """Write ``df`` by the id ``on`` and return the table.

    Meant for ids that name rows: a null id is refused, and rows that repeat an id share
    a bucket.  A folder that exists is never overwritten.
    """
    spark = df.sparkSession
    n = buckets or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    checked = F.when(F.col(on).isNull(), F.raise_error(F.lit(f"{on} is null"))).otherwise(F.col(on))
    rows = df.withColumn(on, checked)
    (rows.repartition(n, F.col(on)).write.format("parquet").option("path", path).option("compression", "zstd")
         .bucketBy(n, on).sortBy(on).saveAsTable(_name()))
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    spark.createDataFrame([(on, n, columns)], LAYOUT).coalesce(1).write.json(f"{path}.layout")
    return read_id_table(spark, path)


def read_id_table(spark: SparkSession, path: str) -> DataFrame:
    """Open a finished table of ``write_id_table``, with its buckets known to the planner."""
    if not committed(spark, f"{path}.layout"):
        raise FileNotFoundError(f"{path} is not a finished id table")
    layout = spark.read.schema(LAYOUT).json(f"{path}.layout").first()
    name = _name()
    spark.sql(f"CREATE TABLE {name} ({layout['columns']}) USING parquet CLUSTERED BY (`{layout['id']}`) "
              f"SORTED BY (`{layout['id']}`) INTO {layout['buckets']} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def rows_by_id(table: DataFrame, ids: DataFrame, on: str = "uid") -> DataFrame:
    """Rows of an id table whose id is among ``ids``; repeated ids shrink to one before they move."""
    return table.join(ids.select(on).distinct(), on, "left_semi")


def rows_without_id(table: DataFrame, ids: DataFrame, on: str = "uid") -> DataFrame:
    """Rows of an id table whose id is not among ``ids``; null ids exclude nothing."""
    return table.join(ids.select(on).distinct(), on, "left_anti")


def split_sizes(table: DataFrame, ids: DataFrame, on: str = "uid") -> DataFrame:
    """Sizes of both parts of an id table (one row)."""
    marked = table.select(on).join(ids.select(on).distinct().withColumn("__l", F.lit(1)), on, "left")
    return marked.agg(F.count("__l").alias("labelled_size"), F.count_if(F.col("__l").isNull()).alias("pool_size"))


def _name() -> str:
    return f"poolsift_by_id_{uuid.uuid4().hex}"
