"""Learning-curve analytics over a long scalar log ``run, tag, step, value``.

The running area under a curve is rewritten from "collect the running list,
call a Python trapezoid per row" (quadratic, row-at-a-time) into two window
aggregates over a ``ROWS`` frame: trapz with unit spacing of v_1..v_n is
``sum(v) - (v_1 + v_n) / 2``.  Running sums are built from blocks of steps, so a
long curve is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


BLOCK_STEPS = 4096


def _joined_back(df: DataFrame, agg: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Group values back on the rows; NULL keys are keys too."""
    renamed = agg.withColumnsRenamed({k: f"__k_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & df[k].eqNullSafe(renamed[f"__k_{k}"])
    return df.join(renamed, on).drop(*[f"__k_{k}" for k in keys])


def _running_sums(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Adds ``__sum``, the running sum, and ``__first``, the curve's first value.

    A curve is cut into blocks of ``BLOCK_STEPS`` steps, ``floor(step / block)``.
    Windows run inside (curve, block); a block's offset is a prefix sum over the
    table of per-block totals, joined back.  No task holds more than a block of a
    curve, however long it is, and the plan is the same for every length.
    """
    keys = list(keys)
    d = df.withColumn("__blk", F.floor(F.col(order) / F.lit(BLOCK_STEPS)))
    inside = Window.partitionBy(*keys, "__blk").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = d.groupBy(*keys, "__blk").agg(F.sum(value).alias("__bs"), F.min_by(value, order).alias("__bf"))
    blocks = Window.partitionBy(*keys).orderBy("__blk")
    offsets = (totals.withColumn("__off", F.coalesce(F.sum("__bs").over(blocks.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
               .withColumn("__first", F.first("__bf").over(blocks)).drop("__bs", "__bf"))
    d = d.withColumn("__cs", F.sum(value).over(inside))
    return _joined_back(d, offsets, [*keys, "__blk"]).withColumn("__sum", F.col("__off") + F.col("__cs")).drop("__blk", "__cs", "__off")


def _trapezoid(value: str) -> Column:
    return F.col("__sum") - (F.col("__first") + F.col(value)) / F.lit(2.0)


def running_auc(df: DataFrame, keys: Sequence[str], order: str = "step", value: str = "value",
                out: str = "auc") -> DataFrame:
    return _running_sums(df, keys, order, value).withColumn(out, _trapezoid(value)).drop("__sum", "__first")


def running_minutes(df: DataFrame, keys: Sequence[str], order: str = "step", value: str = "value",
                    out: str = "minutes") -> DataFrame:
    return _running_sums(df, keys, order, value).withColumn(out, F.col("__sum") / F.lit(60.0)).drop("__sum", "__first")


def curve_metrics(df: DataFrame, keys: Sequence[str] = ("run", "tag"), order: str = "step",
                  value: str = "value", timer_marker: str = "timer/") -> DataFrame:
    """Final curve value: running minutes for timer tags, running AUC otherwise."""
    final = F.when(F.col("tag").contains(timer_marker), F.col("__sum") / F.lit(60.0)).otherwise(_trapezoid(value))
    return _running_sums(df, keys, order, value).withColumn(value, final).drop("__sum", "__first")


def cumulative_counts(df: DataFrame, keys: Sequence[str], order: str, value: str = "n",
                      out: str = "cum_n") -> DataFrame:
    """Running sum with the default frame (RANGE UNBOUNDED PRECEDING .. CURRENT ROW)."""
    return df.withColumn(out, F.sum(value).over(Window.partitionBy(*keys).orderBy(order)))


def share_of_total(df: DataFrame, keys: Sequence[str], value: str = "cum_n", total: str = "total",
                   out: str = "p") -> DataFrame:
    """Group total written back to each row and the row's share of it."""
    totals = df.groupBy(*keys).agg(F.sum(value).alias(total))
    return _joined_back(df, totals, list(keys)).withColumn(out, F.try_divide(F.col(value), F.col(total)))


def carry_forward_grid(df: DataFrame, run: str, rnd: str, cls: str, value: str = "cum_n") -> DataFrame:
    """Dense form: every (run, round, class) seen in a run, cumulative values carried forward."""
    rounds = df.select(run, rnd).distinct()
    classes = df.select(run, cls).distinct()
    grid = rounds.join(classes, on=run, how="inner")
    w = Window.partitionBy(run, cls).orderBy(rnd).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = grid.join(df.select(run, rnd, cls, value), on=[run, rnd, cls], how="left") \
        .withColumn(value, F.coalesce(F.last(value, ignorenulls=True).over(w), F.lit(0)))
    return filled


def group_max(df: DataFrame, keys: Sequence[str], col: str, out: str) -> DataFrame:
    """Group maximum on every row: one partial aggregate, joined back."""
    return _joined_back(df, df.groupBy(*keys).agg(F.max(col).alias(out)), list(keys))


def last_step_rows(df: DataFrame, keys: Sequence[str], step: str = "step") -> DataFrame:
    """Rows at the last step of each group."""
    last = df.groupBy(*keys).agg(F.max(step).alias("__last"))
    return df.join(last, on=list(keys), how="inner").filter(F.col(step) == F.col("__last")).drop("__last")


def budget_match(cells: DataFrame, group_keys: Sequence[str], strategy: str = "strategy_name",
                 step: str = "step") -> DataFrame:
    """Per (group, strategy) the last step, and the budget every strategy is compared at:
    the minimum over eligible strategies of their last step.  Eligible = not a full-pool
    (``noop_``) strategy, except ``noop_random``; ineligible rows fall back to their own
    last step."""
    per = cells.groupBy(*group_keys, strategy).agg(F.max(step).alias("max_step_exp"))
    s = F.col(strategy)
    eligible = (~s.startswith("noop")) | s.contains("random")
    w = Window.partitionBy(*group_keys)
    matched = F.min(F.when(eligible, F.col("max_step_exp"))).over(w)
    return per.withColumn("min_max_step", F.when(eligible, matched).otherwise(F.col("max_step_exp")))


def common_last_step(df: DataFrame, keys: Sequence[str], step: str = "step") -> DataFrame:
    """Minimum over groups of each group's maximum step (one row)."""
    return df.groupBy(*keys).agg(F.max(step).alias("__m")).agg(F.min("__m").alias("max_step"))
