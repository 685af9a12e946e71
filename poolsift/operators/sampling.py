"""Seeded sampling: hash-order top-N, downsampling, stratified and initial sets.

Rule for every sample: order rows by ``md5('<seed>:<uid>')`` then ``uid`` and
keep a prefix of that order (per group where there are groups).

Two physical forms of the same answer:

* small N (``n <= SMALL_N``, 200): ``row_number() <= n`` over the group.  Catalyst
  plans a partial ``WindowGroupLimit`` before the shuffle, so each map task
  ships at most ``n`` rows per group.
* large or per-group N: a histogram of the leading hex digits of the order
  key.  Bucket counts are partially aggregated (skew-safe), prefix-summed
  per group, buckets wholly past N are dropped by a join, and ranks are
  finished inside ``(group, bucket)`` windows.  A hot group is spread over
  up to 16**hex_digits buckets, so no task ever holds a whole group.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import bucket_of, gumbel, order_key

# above this the final window task could see partitions x N rows of one group
SMALL_N = 200


def _by_list(by) -> list[str]:
    if by is None:
        return []
    if isinstance(by, str):
        return [by]
    return list(by)


def _join_cond(left: DataFrame, right: DataFrame, cols: Sequence[str]) -> Column:
    cond = F.lit(True)
    for c in cols:
        cond = cond & left[c].eqNullSafe(right[c])
    return cond


def hash_top_n(df: DataFrame, n, uid: str = "uid", seed=42, by=None,
               rank_col: str | None = None, hex_digits: int = 4) -> DataFrame:
    """Keep the ``n`` first rows per group of ``by`` in (md5(seed:uid), uid) order.

    ``n`` is an int, the name of a column constant within each group, or a
    Column (for instance a scalar subquery).
    """
    by = _by_list(by)
    if isinstance(n, int) and n <= SMALL_N:
        return _top_n_window(df, n, uid, seed, by, rank_col)
    return _top_n_histogram(df, n, uid, seed, by, rank_col, hex_digits)


def _top_n_window(df, n, uid, seed, by, rank_col):
    key = "__k"
    if not by and not rank_col:
        # global sample: per-partition top n, then one merge (TakeOrderedAndProject)
        return (df.withColumn(key, order_key(seed, uid)).orderBy(F.col(key), F.col(uid)).limit(n).drop(key))
    w = Window.partitionBy(*by).orderBy(F.col(key), F.col(uid)) if by else \
        Window.orderBy(F.col(key), F.col(uid))
    rn = rank_col or "__rn"
    out = (df.withColumn(key, order_key(seed, uid))
             .withColumn(rn, F.row_number().over(w))
             .filter(F.col(rn) <= n)
             .drop(key))
    return out if rank_col else out.drop(rn)


def _top_n_histogram(df, n, uid, seed, by, rank_col, hex_digits):
    key, bkt, cnt, off, need = "__k", "__b", "__c", "__off", "__n"
    if isinstance(n, str):
        n_col = F.col(n)
    elif isinstance(n, Column):
        n_col = n
    else:
        n_col = F.lit(int(n))
    keyed = (df.withColumn(key, order_key(seed, uid))
               .withColumn(bkt, bucket_of(seed, uid, hex_digits))
               .withColumn(need, n_col))
    counts = keyed.groupBy(*by, bkt).agg(F.count(F.lit(1)).alias(cnt), F.max(need).alias(need))
    wb = (Window.partitionBy(*by) if by else Window.partitionBy()).orderBy(bkt) \
        .rowsBetween(Window.unboundedPreceding, -1)
    offsets = (counts.withColumn(off, F.coalesce(F.sum(cnt).over(wb), F.lit(0)))
                     .filter(F.col(off) < F.col(need))
                     .select(*by, bkt, off))
    joined = keyed.join(offsets, on=[*by, bkt], how="inner") if not by else \
        keyed.alias("l").join(offsets.alias("r"), _join_cond(keyed.alias("l"), offsets.alias("r"), [*by, bkt]), "inner") \
             .select("l.*", F.col(f"r.{off}"))
    wi = Window.partitionBy(*by, bkt).orderBy(F.col(key), F.col(uid))
    rn = rank_col or "__rn"
    out = (joined.withColumn(rn, F.col(off) + F.row_number().over(wi))
                 .filter(F.col(rn) <= F.col(need))
                 .drop(key, bkt, off, need))
    return out if rank_col else out.drop(rn)


def random_query(pool: DataFrame, n: int, seed=42, uid: str = "uid") -> DataFrame:
    """Uniform sample of ``n`` pool rows (also the no-minority initial set)."""
    return hash_top_n(pool, n, uid=uid, seed=seed)


def random_subset(pool: DataFrame, size: int, seed=42, round_: int | None = None, uid: str = "uid") -> DataFrame:
    """Random subpool; the round enters the seed so each round differs."""
    s = seed if round_ is None else f"{seed}:{round_}"
    return hash_top_n(pool, size, uid=uid, seed=s)


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def downsample_to_prop(df: DataFrame, label: str = "labels", positive=1, prop: float = 0.01,
                       seed=42, uid: str = "uid", negative=0) -> DataFrame:
    """Shrink class ``positive`` to ``ceil(prop * n_negative / (1 - prop))`` rows.

    Every row whose label is not ``positive`` is kept.  Raises if the
    positive class has fewer rows than needed (as sampling without
    replacement would).
    """
    stats = df.agg(F.sum((F.col(label) == negative).cast("long")).alias("neg"),
                   F.sum((F.col(label) == positive).cast("long")).alias("pos")).first()
    n_neg, n_pos = int(stats["neg"] or 0), int(stats["pos"] or 0)
    n = math.ceil(prop * n_neg / (1 - prop))
    if n > n_pos:
        raise ValueError(f"cannot sample {n} rows of class {positive}: only {n_pos} present")
    is_pos = F.col(label).eqNullSafe(F.lit(positive))
    kept = hash_top_n(df.filter(is_pos), n, uid=uid, seed=seed)
    return df.filter(~is_pos).unionByName(kept)


def downsample_class(df: DataFrame, label: str, cls, n: int, seed=42, uid: str = "uid") -> DataFrame:
    """Keep ``n`` rows of class ``cls`` (the majority), every other row untouched."""
    is_c = F.col(label).eqNullSafe(F.lit(cls))
    return df.filter(~is_c).unionByName(hash_top_n(df.filter(is_c), n, uid=uid, seed=seed))


def stratified_allocation(df: DataFrame, label: str, n: int) -> DataFrame:
    """Rows per class for a stratified sample of ``n``: largest remainder, ties by class.

    One row per class, so the window below is over a class-sized table.
    """
    counts = class_counts(df, label)
    total = F.sum("n").over(Window.partitionBy())
    alloc = (counts.withColumn("__tot", total)
                   .withColumn("__q", F.least(F.lit(n), F.col("__tot")) * F.col("n"))
                   .withColumn("__floor", F.floor(F.col("__q") / F.col("__tot")))
                   .withColumn("__rem", F.col("__q") - F.col("__floor") * F.col("__tot"))
                   .withColumn("__left", F.least(F.lit(n), F.col("__tot"))
                               - F.sum("__floor").over(Window.partitionBy()))
                   .withColumn("__ord", F.row_number().over(
                       Window.orderBy(F.col("__rem").desc(), F.col(label).asc()))))
    return alloc.select(label, (F.col("__floor") + (F.col("__ord") <= F.col("__left")).cast("long"))
                        .alias("alloc"))


def stratified_sample(df: DataFrame, label: str, n: int, seed=42, uid: str = "uid") -> DataFrame:
    alloc = stratified_allocation(df, label, n)
    withn = df.join(alloc, on=label, how="inner")
    return hash_top_n(withn, "alloc", uid=uid, seed=seed, by=[label]).drop("alloc")


def initial_budget(df: DataFrame, label: str, positive_budget: int | None, total_budget: int,
                   minority_classes: Sequence | None, seed=42, uid: str = "uid") -> DataFrame:
    """Initial labelled set: ``positive_budget`` rows per minority class, then the
    rest of ``total_budget`` drawn only from non-minority rows.

    Raises if a class has fewer rows than asked of it, or the others too few for the rest.
    """
    if minority_classes is None or positive_budget is None:
        return random_query(df, total_budget, seed=seed, uid=uid)
    minority = list(minority_classes)
    is_min = F.col(label).isin(minority)
    pos = hash_top_n(df.filter(is_min), positive_budget, uid=uid, seed=seed, by=[label])
    counts = {r[label]: r["n"] for r in class_counts(df.filter(is_min), label).collect()}   # minority classes only
    short = [c for c in minority if counts.get(c, 0) < positive_budget]
    n_rest = max(0, int(total_budget) - positive_budget * len(set(minority)))
    others = df.filter(~is_min).count()
    if short or others < n_rest:
        raise ValueError(f"too few rows: classes {short}, others {others} of {n_rest}")
    rest = hash_top_n(df.filter(~is_min), n_rest, uid=uid, seed=seed)
    return pos.unionByName(rest)


def gumbel_top_k(df: DataFrame, score: str, k: int, seed=42, uid: str = "uid",
                 temperature: float = 1.0) -> DataFrame:
    """Sample ``k`` rows without replacement with p = softmax(score / T).

    Gumbel top-k: the k largest ``score/T + G`` are such a sample, and no
    normaliser over the whole table is needed.
    """
    key = F.col(score) / F.lit(temperature) + gumbel(seed, uid)
    return df.withColumn("__g", key).orderBy(F.col("__g").desc(), F.col(uid)).limit(k).drop("__g")


def softmax_column(df: DataFrame, score: str, out: str = "prob", temperature: float = 1.0) -> DataFrame:
    """p = exp(s - max) / sum(exp(s - max)) over the whole table via scalar subqueries."""
    s = F.col(score) / F.lit(temperature)
    m = df.select(F.max(s)).scalar()
    z = df.select(F.sum(F.exp(s - m))).scalar()
    return df.withColumn(out, F.exp(s - m) / z)
