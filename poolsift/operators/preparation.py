"""Dataset preparation from tables: renames, label rules and class names are rows, not code.

``rules(dataset, class_name, priority, code)``: a row's codes (one value or an array) that
occur here give it the class; of several classes the one with the highest priority wins.
``targets(dataset, target)``: ``all`` makes one label per class (names sorted, the
default class last), a class name makes 0/1 labels for that class.
``renames(dataset, old, new)``: columns of a dataset that get the common names.

All datasets run through one plan.  Statistics are counted by the write itself.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import committed

ALL = "all"
OTHERS = "others"
BINARY_NAMES = ("Negative", "Positive")


def rename_by_table(df: DataFrame, renames: DataFrame, dataset: str) -> DataFrame:
    """The columns of one dataset under their common names; a rule for a column that it lacks is an error."""
    # a table of column names: a few rows per dataset
    pairs = {r["old"]: r["new"] for r in renames.filter(F.col("dataset") == dataset).collect()}
    missing = set(pairs) - set(df.columns)
    if missing:
        raise ValueError(f"{dataset} lacks {sorted(missing)}")
    return df.withColumnsRenamed(pairs)


def combined(datasets: Mapping[str, DataFrame], renames: DataFrame, keep: Sequence[str] = ("uid", "split", "text")) -> DataFrame:
    """``dataset``, the kept columns and ``codes ARRAY<STRING>`` of all datasets (their ``codes`` column after renaming
    may be one value or an array)."""
    out = None
    for name, df in datasets.items():
        named = rename_by_table(df, renames, name)
        kind = dict(named.dtypes)["codes"]
        codes = F.col("codes").cast("array<string>") if kind.startswith("array") else F.array(F.col("codes").cast("string"))
        part = named.select(F.lit(name).alias("dataset"), *keep, codes.alias("codes"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no datasets")
    return out


def class_names(rules: DataFrame, targets: DataFrame) -> DataFrame:
    """``dataset, label, name``: the class dimension of every dataset."""
    per_class = rules.select("dataset", "class_name").distinct().join(targets.filter(F.col("target") == ALL), "dataset")
    order = Window.partitionBy("dataset").orderBy("class_name")
    numbered = per_class.select("dataset", (F.row_number().over(order) - 1).alias("label"), F.col("class_name").alias("name"))
    others = numbered.groupBy("dataset").agg(F.count(F.lit(1)).cast("int").alias("label")).withColumn("name", F.lit(OTHERS))
    binary = targets.filter(F.col("target") != ALL).select("dataset", F.posexplode(F.array(*[F.lit(x) for x in BINARY_NAMES])).alias("label", "name"))
    return numbered.unionByName(others).unionByName(binary)


def label_rows(rows: DataFrame, rules: DataFrame, targets: DataFrame) -> DataFrame:
    """``rows`` (``dataset``, ``uid``, ``codes``, ...) with ``labels`` instead of ``codes``.

    Codes are exploded and joined with the rules; of a row's hits the highest priority wins (of equal
    ones the class that sorts last).  Null codes and null arrays match nothing: the
    default class or 0.  ``dataset, uid`` name a row; datasets without a target go.
    """
    names = class_names(rules, targets)
    asked = rules.join(targets, "dataset")
    multi = asked.filter(F.col("target") == ALL).join(names.withColumnRenamed("name", "class_name"), ["dataset", "class_name"])
    single = asked.filter(F.col("class_name") == F.col("target")).withColumn("label", F.lit(1))
    lookup = multi.unionByName(single).groupBy("dataset", "code").agg(F.max(F.struct("priority", "class_name", "label")).alias("best"))
    default = targets.join(names.filter(F.col("name") == OTHERS).select("dataset", F.col("label").alias("last")), "dataset", "left") \
        .select("dataset", F.when(F.col("target") == ALL, F.col("last")).otherwise(0).alias("default"))
    # only ids and codes travel; most rows have no hit
    hits = rows.select("dataset", "uid", F.explode("codes").alias("code")).join(lookup, ["dataset", "code"]) \
        .groupBy("dataset", "uid").agg(F.max("best").alias("best"))
    # one row of two small values per dataset, and each dataset is a branch of the plan: rows never move by dataset
    found = rows.join(F.broadcast(default), "dataset").join(hits, ["dataset", "uid"], "left")
    return found.withColumn("labels", F.coalesce("best.label", "default").cast("int")).drop("codes", "best", "default")


def write_prepared(df: DataFrame, path: str, names: Sequence[str], splits: Sequence[str] = ("train", "test"), metadata: Mapping | None = None) -> str:
    """Data partitioned by split, class statistics and metadata beside it; refused if one of them is there.

    ``names``: class names by label.  The statistics (``split, label, name, n, proportion``; rows of
    other splits or labels make a row with null names) are counted while the data is written, without another scan.
    """
    spark = df.sparkSession
    path = path.rstrip("/")
    for part in ("data", "stats", "metadata"):
        if committed(spark, f"{path}/{part}"):
            raise FileExistsError(f"{path}/{part} exists")
    seen = Observation()
    cells = {f"c{i}_{j}": F.count_if((F.col("split") == s) & (F.col("labels") == j)) for i, s in enumerate(splits) for j in range(len(names))}
    totals = {f"t{i}": F.count_if(F.col("split") == s) for i, s in enumerate(splits)}
    watched = df.observe(seen, *[c.alias(k) for k, c in (cells | totals).items()], F.count(F.lit(1)).alias("rows"))
    watched.write.mode("errorifexists").partitionBy("split").parquet(f"{path}/data")
    got = seen.get
    rows = [(s, j, name, int(got[f"c{i}_{j}"]), got[f"c{i}_{j}"] / got[f"t{i}"] if got[f"t{i}"] else 0.0)
            for i, s in enumerate(splits) for j, name in enumerate(names)]
    odd = int(got["rows"]) - sum(r[3] for r in rows)
    if odd:
        rows.append((None, None, None, odd, None))
    spark.createDataFrame(rows, "split string, label int, name string, n long, proportion double").coalesce(1) \
        .write.mode("errorifexists").parquet(f"{path}/stats")
    facts = json.dumps({**(metadata or {}), "rows": int(got["rows"]), "names": list(names), "schema": df.schema.json()}, sort_keys=True)
    spark.createDataFrame([(facts,)], "metadata string").coalesce(1).write.mode("errorifexists").parquet(f"{path}/metadata")
    return path


def read_prepared(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    """(rows, statistics, metadata) of ``write_prepared``."""
    facts = json.loads(spark.read.parquet(f"{path}/metadata").first()["metadata"])
    schema = StructType.fromJson(json.loads(facts.pop("schema")))
    return spark.read.schema(schema).parquet(f"{path}/data"), spark.read.parquet(f"{path}/stats"), facts
