"""Projection, predicate, mapping and id-set helpers."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from pyspark.sql import types as Ty


def select_exclude(df: DataFrame, exclude: Sequence[str], rename: Mapping[str, str] | None = None) -> DataFrame:
    """``SELECT * EXCLUDE (...)`` plus optional renames."""
    out = df.drop(*exclude)
    return out.withColumnsRenamed(dict(rename)) if rename else out


def prune_columns(df: DataFrame, drop_pattern: str | None = None, keep: Sequence[str] = (),
                  drop_constant: bool = True, drop_all_null: bool = True) -> DataFrame:
    """Drop columns by name regex, constant columns (<= 1 distinct non-null value) and
    all-NULL columns, all decided from one aggregate pass."""
    cols = [c for c in df.columns if c in keep or not (drop_pattern and re.search(drop_pattern, c))]
    if not (drop_constant or drop_all_null):
        return df.select(*cols)
    # constant <=> min == max over non-NULL values: plain partial aggregates, no
    # distinct expansion; types without an order fall back to a distinct count
    aggs = []
    for i, c in enumerate(cols):
        ref = F.col(f"`{c}`")
        aggs.append(F.count(ref).alias(f"n{i}"))
        if isinstance(df.schema[c].dataType, Ty.MapType):
            aggs.append((F.count_distinct(ref) <= 1).alias(f"k{i}"))
        else:
            aggs.append(F.coalesce(F.min(ref) == F.max(ref), F.lit(True)).alias(f"k{i}"))
    stats = df.agg(*aggs).first()
    kept = []
    for i, c in enumerate(cols):
        if c in keep:
            kept.append(c)
            continue
        if drop_constant and stats[f"k{i}"]:
            continue
        if drop_all_null and stats[f"n{i}"] == 0:
            continue
        kept.append(c)
    return df.select(*[F.col(f"`{c}`") for c in kept])


def map_lookup(df: DataFrame, col: str, mapping: Mapping, out: str | None = None,
               drop_unmatched: bool = False) -> DataFrame:
    """Dictionary map of a column: unmatched -> NULL; optionally drop those rows."""
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    res = df.withColumn(out or col, F.try_element_at(m, F.col(col)))
    return res.filter(F.col(out or col).isNotNull()) if drop_unmatched else res


def replace_value(df: DataFrame, col: str, old, new) -> DataFrame:
    """Replace one value, every other value kept."""
    return df.withColumn(col, F.when(F.col(col) == F.lit(old), F.lit(new)).otherwise(F.col(col)))


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once (must be empty)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def ids_semi(df: DataFrame, ids: DataFrame, on: str = "uid") -> DataFrame:
    return df.join(ids.select(on), on=on, how="left_semi")


def ids_anti(df: DataFrame, ids: DataFrame, on: str = "uid") -> DataFrame:
    return df.join(ids.select(on), on=on, how="left_anti")


def pool_sizes(base: DataFrame, label_log: DataFrame, on: str = "uid") -> DataFrame:
    """Labelled and pool sizes of a base table under a label log (one row)."""
    marked = base.select(on).join(label_log.select(on).distinct().withColumn("__l", F.lit(1)), on, "left")
    return marked.agg(F.sum(F.coalesce("__l", F.lit(0))).alias("labelled_size"),
                      F.sum(F.when(F.col("__l").isNull(), 1).otherwise(0)).alias("pool_size"))


def assign_uid(df: DataFrame, order: str | Sequence[str], out: str = "uid", start: int = 0,
               lead: Sequence[Column] = ()) -> DataFrame:
    """Contiguous ids ``start .. start + n - 1`` in the order of ``lead`` and ``order``.

    Rows are range-partitioned and sorted on those columns and checkpointed; a
    row's id is its partition's offset (one count per partition) plus its place
    in the partition.  No window, and no task sees more than its range.  The
    columns together must be unique, else the order of equal rows is open; they
    may be sparse, NULLs come first.
    """
    order = [order] if isinstance(order, str) else list(order)
    lead_names = [f"__lead{i}" for i in range(len(lead))]
    by = [*lead_names, *order]
    keyed = df.withColumns(dict(zip(lead_names, lead))) if lead else df
    placed = cut_lineage(keyed.repartitionByRange(*by).sortWithinPartitions(*by))
    placed = placed.withColumn("__at", F.monotonically_increasing_id()) \
        .withColumn("__part", F.shiftrightunsigned("__at", 33).cast("int"))
    counts = sorted((r["__part"], r["count"]) for r in placed.groupBy("__part").count().collect())
    offsets, total = [], start
    for part, n in counts:          # one row per partition
        offsets.append((part, total))
        total += n
    table = df.sparkSession.createDataFrame(offsets, "__part int, __off long")
    return (placed.join(F.broadcast(table), "__part")
            .withColumn(out, F.col("__off") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
            .drop("__part", "__at", "__off", *lead_names))


def concat_text(title: str, content: str, sep: str = "\n") -> Column:
    """``title + sep + content``; NULL if either part is NULL."""
    return F.concat(F.col(title), F.lit(sep), F.col(content))


def union_ragged(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def limit_rows(df: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
    """Row cap after an explicit total order (a debugging limit)."""
    return df.orderBy(*order).limit(n)
