"""Label derivation: binarisation, last-match multiclass, class-name dimension."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def binarize(col: str, codes, kind: str = "eq") -> Column:
    """0/1 label from one column.

    ``eq``: value equals the code; ``member``: array contains the code;
    ``overlap``: array shares any of ``codes`` (NULL elements never match).
    """
    c = F.col(col)
    if kind == "eq":
        return F.coalesce((c == F.lit(codes)).cast("int"), F.lit(0))
    if kind == "member":
        return F.coalesce(F.array_contains(c, F.lit(codes)).cast("int"), F.lit(0))
    if kind == "overlap":
        codes_arr = F.array(*[F.lit(x) for x in codes])
        return F.coalesce(F.arrays_overlap(c, codes_arr).cast("int"), F.lit(0))
    raise ValueError(kind)


def multiclass_last(col: str, rules: Mapping[str, Sequence], names: Sequence[str],
                    default: str = "others") -> Column:
    """Class index of the *last* rule (in mapping order) with a code in the array;
    ``default`` when none matches.  ``names`` gives the index of each class name."""
    expr = F.lit(names.index(default))
    for name, codes in rules.items():   # later rules wrap earlier ones: last match wins
        hit = F.coalesce(F.arrays_overlap(F.col(col), F.array(*[F.lit(x) for x in codes])), F.lit(False))
        expr = F.when(hit, F.lit(names.index(name))).otherwise(expr)
    return expr.cast("int")


def sorted_names(rules: Mapping[str, Sequence], default: str = "others") -> list[str]:
    """Class names sorted, with the default class last."""
    return [*sorted(rules.keys()), default]


def label_names(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """Class-name dimension (label INT, name STRING)."""
    return spark.createDataFrame([(i, n) for i, n in enumerate(names)], "label int, name string")


def split_fallback(df: DataFrame, split: str = "split") -> DataFrame:
    """Use validation as test when there is no test split; drop validation."""
    has_test = df.filter(F.col(split) == "test").limit(1).count() > 0
    if has_test:
        return df.filter(F.col(split) != "validation")
    return df.withColumn(split, F.when(F.col(split) == "validation", F.lit("test")).otherwise(F.col(split)))
