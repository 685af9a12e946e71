"""Readers: split scans, file-name columns, JSON lines, Latin-1 lines, TSV,
nested configuration, and artefact presence listings."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty


def scan_split(spark: SparkSession, path: str, split: str | None = None, split_col: str = "split") -> DataFrame:
    """Columnar dataset scan; with a ``split`` partition column the filter prunes directories."""
    df = spark.read.parquet(path)
    return df.filter(F.col(split_col) == split) if split is not None else df


def with_filename(df: DataFrame, out: str = "filename") -> DataFrame:
    """Source file path as a column (from the hidden ``_metadata`` struct)."""
    return df.withColumn(out, F.col("_metadata.file_path"))


def scan_with_filename(spark: SparkSession, root: str, glob: str = "*.parquet", fmt: str = "parquet",
                       schema: Ty.StructType | str | None = None, segments: Sequence[str] = (),
                       out: str = "filename") -> DataFrame:
    """Recursive file discovery under ``root`` filtered by file-name glob and, optionally,
    by whole path *segments* (not substrings), with the file path as a column."""
    reader = spark.read.format(fmt).option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    if schema is not None:
        reader = reader.schema(schema)
    df = with_filename(reader.load(root), out)
    if segments:
        cond = F.lit(False)
        for s in segments:
            cond = cond | F.col(out).contains(f"/{s}/")
        df = df.filter(cond)
    return df


def run_dir(path_col: str | Column, levels: int = 1) -> Column:
    """Directory ``levels`` above a file path (the run directory of an artefact)."""
    p = F.col(path_col) if isinstance(path_col, str) else path_col
    for _ in range(levels):
        p = F.regexp_extract(p, r"^(.*)/[^/]*$", 1)
    return p


def read_jsonl(spark: SparkSession, path: str, schema: Ty.StructType | str, filename: bool = False) -> DataFrame:
    """JSON lines with an explicit schema (blank lines are skipped)."""
    df = spark.read.schema(schema).json(path)
    return with_filename(df) if filename else df


def read_latin1_lines(spark: SparkSession, path: str, col: str = "labels") -> DataFrame:
    """One row per line of a Latin-1 text file, blank lines included.

    The ``text`` reader hands on a line's bytes as they are; they are decoded here.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.decode(F.col("value").cast("binary"), "ISO-8859-1").alias(col))


def read_tsv(spark: SparkSession, path: str, schema: Ty.StructType | str | None = None) -> DataFrame:
    r = spark.read.option("sep", "\t").option("header", "true")
    return r.schema(schema).csv(path) if schema is not None else r.option("inferSchema", "true").csv(path)


def flatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """Recursively flatten struct columns to ``parent<sep>child`` names."""
    cols: list[Column] = []

    def walk(prefix: str, dtype, ref: Column):
        if isinstance(dtype, Ty.StructType):
            for f in dtype.fields:
                walk(f"{prefix}{sep}{f.name}" if prefix else f.name, f.dataType, ref.getField(f.name))
        else:
            cols.append(ref.alias(prefix))

    for f in df.schema.fields:
        walk(f.name, f.dataType, F.col(f"`{f.name}`"))
    return df.select(*cols)


def parse_nested(df: DataFrame, col: str, schema: Ty.StructType | str, sep: str = ".",
                 keep: Sequence[str] = ()) -> DataFrame:
    """JSON text column -> struct (explicit schema) -> flat dotted columns."""
    parsed = df.select(*keep, F.from_json(F.col(col), schema).alias(col))
    return flatten(parsed, sep)


def _leaves(dtype, path: str = "$", name: str = ""):
    """(dotted name, JSON path, type) of every leaf of a schema found in variants."""
    for f in dtype.fields:
        at, key = f"{path}[{json.dumps(f.name)}]", f"{name}.{f.name}" if name else f.name
        if isinstance(f.dataType, Ty.StructType) and f.dataType.fields:
            yield from _leaves(f.dataType, at, key)
        else:
            yield key, at, f.dataType


def flatten_variant(df: DataFrame, col: str, keep: Sequence[str] = (), prefix: str = "") -> DataFrame:
    """JSON text column -> one column per dotted name that occurs in any row; no schema is given.

    The schema is found by an aggregate over all rows (its size is that of the schema, not of the
    data).  A name that a row lacks is NULL; a name with values of different kinds, or with
    arrays, becomes its JSON text.  Text that is no JSON object gives NULLs.
    """
    rows = df.select(*keep, F.try_parse_json(F.col(col)).alias("__v"))
    found = rows.agg(F.schema_of_variant_agg("__v").alias("s")).first()["s"]
    if found is None or not found.startswith("OBJECT<"):
        return rows.select(*keep)
    tree = Ty.DataType.fromDDL(found.replace("OBJECT<", "STRUCT<"))
    cols = []
    for name, path, kind in _leaves(tree):
        if isinstance(kind, (Ty.ArrayType, Ty.VariantType, Ty.StructType, Ty.NullType)):
            value = F.to_json(F.try_variant_get(F.col("__v"), path, "variant"))
        else:
            value = F.try_variant_get(F.col("__v"), path, kind.simpleString())
        cols.append(value.alias(f"{prefix}{name}"))
    return rows.select(*keep, *cols)


def read_configs(spark: SparkSession, root: str, glob: str = "*.json") -> DataFrame:
    """Per-run JSON configuration files of any shape -> one flat row each (dotted columns), plus the run directory."""
    raw = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(root, wholetext=True)
           .select(F.col("value").alias("body"), run_dir(F.col("_metadata.file_path")).alias("filename")))
    return flatten_variant(raw, "body", keep=["filename"])


def list_files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """Paths of files under ``root`` matching ``glob`` (contents are never read)."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
            .load(root).select("path"))


def missing_artifacts(runs: DataFrame, listing: DataFrame, run_col: str, path_to_run: Column) -> DataFrame:
    """Runs that lack an artefact: run list left-anti the runs found in a listing."""
    found = listing.select(path_to_run.alias(run_col)).distinct()
    return runs.join(found, on=run_col, how="left_anti")
