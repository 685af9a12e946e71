"""Class statistics, group aggregates, pivots, joins for reports, design grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def class_stats(df: DataFrame, label: str, names: DataFrame | None = None, total: bool = False) -> DataFrame:
    """Value counts per class, absolute and normalised, with the class name.

    ``total=True`` appends the total row via ``ROLLUP`` (label NULL, name 'total').
    """
    grouped = df.rollup(label) if total else df.groupBy(label)
    counts = grouped.agg(F.count(F.lit(1)).alias("count"), F.grouping(label).alias("__g") if total
                         else F.lit(0).alias("__g"))
    n_all = df.select(F.count(F.lit(1))).scalar()
    out = counts.withColumn("perc", F.col("count") / n_all)
    if names is not None:
        out = out.join(names.withColumnRenamed("label", label), on=label, how="left")
        out = out.withColumn("name", F.when(F.col("__g") == 1, F.lit("total")).otherwise(F.col("name")))
    return out.drop("__g")


def group_quartiles(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Exact median and IQR (linear interpolation) per group; NULL for a group without values."""
    qs = exact_quantiles(df, keys, value, [0.25, 0.5, 0.75])
    return qs.select(*keys, F.col("q_1").alias("median"), (F.col("q_2") - F.col("q_0")).alias("iqr"))


def geometric_mean(col: str) -> Column:
    """exp(mean(ln x)), and exactly 0 when any value is 0."""
    return F.when(F.min(col) == 0, F.lit(0.0)).otherwise(F.exp(F.avg(F.ln(F.col(col)))))


def _distinct(col: str, approx: bool) -> Column:
    # approx: HyperLogLog++ sketch, constant memory per group and mergeable
    return F.approx_count_distinct(col) if approx else F.count_distinct(col)


def count_distinct_having(df: DataFrame, keys: Sequence[str], col: str, min_count: int,
                          exempt: Column | None = None, out: str = "n_runs", approx: bool = False) -> DataFrame:
    """Distinct count per group, kept where it reaches ``min_count`` (or the row is exempt)."""
    agg = df.groupBy(*keys).agg(_distinct(col, approx).alias(out))
    cond = F.col(out) >= min_count
    return agg.filter(cond | exempt if exempt is not None else cond)


def distinct_count_back(df: DataFrame, keys: Sequence[str], col: str, out: str = "n_unique",
                        approx: bool = False) -> DataFrame:
    """Group distinct count written back to rows (aggregate, then join on the keys;
    DISTINCT window aggregates are not available)."""
    agg = df.groupBy(*keys).agg(_distinct(col, approx).alias(out))
    return df.join(agg, on=list(keys), how="inner")


def ordered_list(df: DataFrame, keys: Sequence[str], order: str, value: str, out: str = "values") -> DataFrame:
    """Values of each group as an array ordered by ``order`` (groups are per-run curves)."""
    pts = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    return df.groupBy(*keys).agg(F.transform(pts, lambda p: p["v"]).alias(out))


def pivot_wide(df: DataFrame, index: Sequence[str], column: str, values: Sequence, value: str,
               agg: str = "first", sep: str = "_") -> DataFrame:
    """Long -> wide with the pivot values given (no extra pass to discover them)."""
    fn = {"first": F.first, "max": F.max, "min": F.min, "sum": F.sum, "avg": F.avg}[agg]
    wide = df.groupBy(*index).pivot(column, list(values)).agg(fn(value))
    return wide.withColumnsRenamed({str(v): f"{value}{sep}{v}".rstrip(sep) for v in values})


def unpivot_long(df: DataFrame, ids: Sequence[str], values: Sequence[str], variable: str = "variable",
                 value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(values), variable, value)


def outer_indicator(left: DataFrame, right: DataFrame, keys: Sequence[str], out: str = "_merge") -> DataFrame:
    """Full outer join on ``keys`` with a side indicator: both / left_only / right_only."""
    lm = left.select(*keys).distinct().withColumn("__l", F.lit(True))
    rm = right.select(*keys).distinct().withColumn("__r", F.lit(True))
    j = lm.join(rm, on=list(keys), how="full")
    return j.withColumn(out, F.when(F.col("__l") & F.col("__r"), "both")
                        .when(F.col("__l"), "left_only").otherwise("right_only")).drop("__l", "__r")


def design_grid(df: DataFrame, axes: Sequence[str], large_axis: str | None = None) -> DataFrame:
    """Every combination of the distinct values of ``axes`` (NULL counts as a value).

    The large axis stays a distributed DataFrame; the values of each other axis,
    which every value of the large one meets anyway, enter as one array (a scalar
    subquery) and are attached with ``explode``: no join and no shuffle of the grid.
    """
    axes = list(axes)
    large = large_axis or axes[0]
    grid = df.select(large).distinct()
    for a in axes:
        if a != large:
            values = df.select(F.collect_set(F.struct(F.col(a).alias("v")))).scalar()
            grid = grid.withColumn(a, F.explode(values)).withColumn(a, F.col(a)["v"])
    return grid.select(*axes)


def missing_combinations(grid: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    return grid.join(found.select(*keys).distinct(), on=list(keys), how="left_anti")


def side_by_side(left: DataFrame, right: DataFrame, keys: Sequence[str], lprefix: str, rprefix: str,
                 compare: str | None = None) -> DataFrame:
    """Concat two keyed tables column-wise (full outer on keys, prefixed columns);
    optionally a flag where the two ``compare`` cells differ."""
    lc = [c for c in left.columns if c not in keys]
    rc = [c for c in right.columns if c not in keys]
    l2 = left.select(*keys, *[F.col(c).alias(f"{lprefix}{c}") for c in lc])
    r2 = right.select(*keys, *[F.col(c).alias(f"{rprefix}{c}") for c in rc])
    out = l2.join(r2, on=list(keys), how="full")
    if compare:
        out = out.withColumn("differs", ~F.col(f"{lprefix}{compare}").eqNullSafe(F.col(f"{rprefix}{compare}")))
    return out


def _same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, Column]:
    """``right`` with its keys renamed, and the null-safe equality of the keys."""
    renamed = right.withColumnsRenamed({k: f"__k_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(renamed[f"__k_{k}"])
    return renamed, on


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, qs: Sequence[float],
                    accuracy: int = 10_000) -> DataFrame:
    """Exact quantiles (linear interpolation, as ``percentile``), one plan for groups of any size.

    A mergeable sketch brackets each quantile per group; the rows below the
    bracket are counted, and only the distinct values inside it (about
    ``4 / accuracy`` of a group) are ranked.  The neighbours just outside are kept
    too, because both order statistics of a quantile may lie one rank off.
    Groups with a NULL key and groups without a value stay (NULL quantiles).
    Returns ``keys..., q_<i>`` columns.
    """
    keys, k = list(keys), len(qs)
    rows = cut_lineage(df.select(*keys, F.col(value).cast("double").alias("__v")))   # three passes read it
    marks = [max(0.0, q - 2 / accuracy) for q in qs] + [min(1.0, q + 2 / accuracy) for q in qs]
    stats = rows.groupBy(*keys).agg(F.count("__v").alias("__n"), F.percentile_approx("__v", marks, accuracy).alias("__m"))
    right, on = _same_keys(rows, stats, keys)
    marked = rows.join(right, on).select(*keys, "__n", "__m", "__v")
    v = F.col("__v")

    def low(i):
        return F.col("__m")[i]

    def high(i):
        return F.col("__m")[k + i]

    aggs = []
    for i in range(k):
        aggs += [F.count_if(v < low(i)).alias(f"__below{i}"), F.count_if((v >= low(i)) & (v <= high(i))).alias(f"__in{i}"),
                 F.max(F.when(v < low(i), v)).alias(f"__prev{i}"), F.min(F.when(v > high(i), v)).alias(f"__next{i}")]
    groups = marked.groupBy(*keys).agg(F.max("__n").alias("__n"), *aggs)
    target = F.explode(F.array_compact(F.array(*[F.when((v >= low(i)) & (v <= high(i)), F.lit(i)) for i in range(k)])))
    inside = marked.withColumn("__i", target).groupBy(*keys, "__i", "__v").agg(F.count(F.lit(1)).alias("__c"), F.max("__n").alias("__n"))
    w = Window.partitionBy(*keys, "__i").orderBy("__v")
    ranked = inside.withColumn("__end", F.sum("__c").over(w))
    right, on = _same_keys(ranked, groups.drop("__n"), keys)
    ranked = ranked.join(right, on)
    picks = []
    for i, q in enumerate(qs):
        pos = F.lit(float(q)) * (F.col("__n") - 1)
        for name, r in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            at = r - F.col(f"__below{i}")
            here = (F.col("__i") == i) & (at >= F.col("__end") - F.col("__c")) & (at < F.col("__end"))
            picks.append(F.max(F.when(here, v)).alias(f"__{name}{i}"))
    found = ranked.groupBy(*keys).agg(*picks)
    right, on = _same_keys(groups, found, keys)
    cols = []
    for i, q in enumerate(qs):
        pos = F.lit(float(q)) * (F.col("__n") - 1)

        def at_rank(name, r, i=i):
            return F.when(r < F.col(f"__below{i}"), F.col(f"__prev{i}")) \
                .when(r >= F.col(f"__below{i}") + F.col(f"__in{i}"), F.col(f"__next{i}")).otherwise(F.col(f"__{name}{i}"))

        a, b = at_rank("lo", F.floor(pos)), at_rank("hi", F.ceil(pos))
        cols.append((a + (pos - F.floor(pos)) * (b - a)).alias(f"q_{i}"))
    return groups.join(right, on, "left").select(*keys, *cols)
