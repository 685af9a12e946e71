"""Neighbour lists of labelled rows that are kept up from round to round.

Two-stage strategies need the nearest pool rows of every labelled row, each round anew,
although a round only labels a few rows.  A list holds ``k + spare`` neighbours.  The pool only
shrinks, so a list without its newly labelled entries still begins with the
nearest pool rows, as long as it has ``k`` of them; only new labels and lists that ran
short are searched for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .similarity import knn_join

SPARE = 20


def start_lists(labelled: DataFrame, pool: DataFrame, k: int, spare: int = SPARE, uid: str = "uid", vec: str = "embedding",
                metric: str = "cosine") -> DataFrame:
    """``search_query_uid, uid, dists``: up to ``k + spare`` nearest pool rows of every labelled row."""
    return cut_lineage(knn_join(labelled, pool, k + spare, metric, uid, vec))


def advance_lists(lists: DataFrame, labelled: DataFrame, new: DataFrame, pool: DataFrame, k: int, spare: int = SPARE, uid: str = "uid",
                  vec: str = "embedding", metric: str = "cosine") -> DataFrame:
    """The lists after ``new`` rows moved from the pool to the labelled ones.

    ``labelled`` holds the rows labelled before, ``pool`` the rows that are left.  New labels
    are searched for, and so are lists with fewer than ``k`` entries while the pool has
    more; every other list only loses the rows that were labelled.
    """
    kept = cut_lineage(lists.join(new.select(F.col(uid).cast("long").alias("uid")), "uid", "left_anti")
                       .select("search_query_uid", "uid", "dists"))
    # every labelled row, so that a list that lost all its entries is seen too
    sizes = labelled.filter(F.col(vec).isNotNull()).select(F.col(uid).cast("long").alias("search_query_uid")).join(
        kept.groupBy("search_query_uid").agg(F.count(F.lit(1)).alias("n")), "search_query_uid", "left")
    # at most k rows tell whether the pool has more than a short list holds
    left = pool.filter(F.col(vec).isNotNull()).select(F.lit(1)).limit(k).count()
    short = cut_lineage(sizes.filter(F.coalesce("n", F.lit(0)) < min(k, left)).select("search_query_uid"))
    again = labelled.join(short.withColumnRenamed("search_query_uid", uid), uid, "left_semi")
    asked = new.select(uid, vec).unionByName(again.select(uid, vec))
    found = knn_join(asked, pool, k + spare, metric, uid, vec)
    return cut_lineage(kept.join(short, "search_query_uid", "left_anti").unionByName(found))


def nearest(lists: DataFrame, k: int) -> DataFrame:
    """The first ``k`` entries of every list (ties by uid)."""
    w = Window.partitionBy("search_query_uid").orderBy("dists", "uid")
    return lists.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= k).drop("__r")
