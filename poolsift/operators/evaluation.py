"""Classification and calibration metrics on ``uid, label, logits``.

One partial-aggregated pass over the scored rows builds the confusion
counts (classes^2 rows); every per-class, micro and macro figure is then
plain arithmetic on that small table, so no metric re-reads the data.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.vectors import argmax, logsumexp, max_prob


def with_predictions(scored: DataFrame, logits: str = "logits") -> DataFrame:
    return scored.withColumn("pred", argmax(logits))


def confusion(scored: DataFrame, label: str = "label", logits: str = "logits") -> DataFrame:
    return (with_predictions(scored, logits)
            .groupBy(F.col(label).cast("int").alias("label"), "pred")
            .agg(F.count(F.lit(1)).alias("n")))


def class_dimension(spark: SparkSession, num_classes: int) -> DataFrame:
    return spark.range(num_classes).select(F.col("id").cast("int").alias("class_id"))


def _safe_div(a, b):
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def class_counts(conf: DataFrame, classes: DataFrame) -> DataFrame:
    """tp, fp, fn, tn per class from the confusion table (absent classes give 0)."""
    total = conf.agg(F.sum("n").alias("N"))
    actual = conf.groupBy(F.col("label").alias("class_id")).agg(F.sum("n").alias("actual"))
    predicted = conf.groupBy(F.col("pred").alias("class_id")).agg(F.sum("n").alias("predicted"))
    diag = conf.filter(F.col("label") == F.col("pred")).select(F.col("label").alias("class_id"),
                                                                F.col("n").alias("tp"))
    n_all = total.select("N").scalar()
    return (classes.join(actual, "class_id", "left").join(predicted, "class_id", "left")
                   .join(diag, "class_id", "left")
                   .fillna(0, subset=["actual", "predicted", "tp"])
                   .select("class_id", F.col("tp").cast("long").alias("tp"),
                           (F.col("predicted") - F.col("tp")).cast("long").alias("fp"),
                           (F.col("actual") - F.col("tp")).cast("long").alias("fn"),
                           (F.coalesce(n_all, F.lit(0)) - F.col("actual") - F.col("predicted") + F.col("tp"))
                           .cast("long").alias("tn")))


def _five(tp, fp, fn, tn):
    return {
        "accuracy": _safe_div(tp, tp + fn),
        "f1": _safe_div(2 * tp, 2 * tp + fp + fn),
        "precision": _safe_div(tp, tp + fp),
        "recall": _safe_div(tp, tp + fn),
        "specificity": _safe_div(tn, tn + fp),
    }


def metrics_perclass(scored: DataFrame, num_classes: int, label: str = "label",
                     logits: str = "logits") -> DataFrame:
    counts = class_counts(confusion(scored, label, logits), class_dimension(scored.sparkSession, num_classes))
    m = _five(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn"))
    return counts.select("class_id", *[v.alias(k) for k, v in m.items()], "tp", "fp", "fn", "tn")


def metrics_micro(scored: DataFrame, num_classes: int, label: str = "label", logits: str = "logits") -> DataFrame:
    counts = class_counts(confusion(scored, label, logits), class_dimension(scored.sparkSession, num_classes))
    s = counts.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")])
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    m = _five(tp, fp, fn, tn)
    # single-label multiclass: micro accuracy is tp over all rows
    m["accuracy"] = _safe_div(tp, tp + fn)
    return s.select(*[v.alias(f"{k}_micro") for k, v in m.items()])


def metrics_macro_f1(scored: DataFrame, num_classes: int, label: str = "label", logits: str = "logits") -> DataFrame:
    """Mean F1 over classes that occur in labels or predictions."""
    per = metrics_perclass(scored, num_classes, label, logits)
    return per.filter(F.col("tp") + F.col("fp") + F.col("fn") > 0).agg(F.avg("f1").alias("f1_macro"))


def minority_f1(scored: DataFrame, num_classes: int, minority_classes: Sequence[int],
                label: str = "label", logits: str = "logits") -> DataFrame:
    per = metrics_perclass(scored, num_classes, label, logits)
    return per.filter(F.col("class_id").isin(list(minority_classes))).agg(F.avg("f1").alias("avg_f1_minclass"))


def calibration(scored: DataFrame, bins: int = 10, label: str = "label", logits: str = "logits") -> DataFrame:
    """Expected (L1), maximum and root-mean-square calibration error over equal bins
    of top-class confidence; bin = least(floor(conf * bins), bins - 1)."""
    rows = (scored.withColumn("conf", max_prob(logits))
                  .withColumn("hit", (argmax(logits) == F.col(label)).cast("double"))
                  .withColumn("bin", F.least(F.floor(F.col("conf") * bins), F.lit(bins - 1))))
    per_bin = rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("conf").alias("conf"),
                                      F.avg("hit").alias("acc"))
    # weights from the (at most ``bins``-row) bin table: one scan of the data
    gap = F.abs(F.col("acc") - F.col("conf"))
    weighted = per_bin.withColumn("w", F.col("n") / F.sum("n").over(Window.partitionBy()))
    w = F.col("w")
    return weighted.agg(F.sum(w * gap).alias("ece"), F.max(gap).alias("mce"),
                        F.sqrt(F.sum(w * gap * gap)).alias("rmsce"))


def mean_loss(scored: DataFrame, label: str = "label", logits: str = "logits") -> DataFrame:
    """Mean cross-entropy over rows."""
    nll = logsumexp(logits) - F.get(F.col(logits), F.col(label))
    return scored.agg(F.avg(nll).alias("loss"))


def round_counts(labelled: DataFrame, pool_size_source: DataFrame, num_classes: int,
                 label: str = "label") -> DataFrame:
    """Per-class labelled counts (0 for absent classes) with labelled and pool sizes."""
    classes = class_dimension(labelled.sparkSession, num_classes)
    counts = labelled.groupBy(F.col(label).cast("int").alias("class_id")).agg(F.count(F.lit(1)).alias("count"))
    n_lab = labelled.select(F.count(F.lit(1))).scalar()
    n_pool = pool_size_source.select(F.count(F.lit(1))).scalar()
    return (classes.join(counts, "class_id", "left")
                   .select("class_id", F.coalesce("count", F.lit(0)).cast("long").alias("count"),
                           n_lab.alias("labelled_size"), n_pool.alias("pool_size")))


def best_step(curves: DataFrame, keys: Sequence[str], step: str = "step", value: str = "value") -> DataFrame:
    """Step of the maximum value per curve, earliest step on ties."""
    return curves.groupBy(*keys).agg(
        F.max_by(F.col(step), F.struct(F.col(value), -F.col(step))).alias("best_step"),
        F.max(value).alias("best_value"))


def early_stop_step(curves: DataFrame, keys: Sequence[str], step: str = "step", value: str = "value",
                    patience: int = 10, min_delta: float = 1e-5) -> DataFrame:
    """Early stopping in mode max: a value improves iff it exceeds best + min_delta;
    stop at the first index with ``patience`` non-improvements in a row.

    Curves are sorted by step inside their partition and folded as they stream
    by, so a task holds one curve's running state and never its values.
    Returns the stop index (NULL if never triggered), the best value up to the
    stop and the curve length.
    """
    keys = list(keys)
    rows = curves.select(*keys, F.col(step).alias("__s"), F.col(value).cast("double").alias("__v"))
    schema = rows.drop("__s", "__v").schema.add("stop_index", "integer").add("best_value", "double").add("n_steps", "integer")
    arrow = to_arrow_schema(schema)

    def run(batches):
        key, state, out = None, None, []

        def close():
            if state is not None:
                out.append((*key, state[2], state[0], state[3]))

        for b in batches:
            for *k, v in zip(*(b.column(c).to_pylist() for c in [*keys, "__v"])):
                if state is None or k != key:
                    close()
                    key, state = k, [None, 0, None, 0]      # best, wait, stop, length
                best, wait, stop, n = state
                if stop is None:
                    if best is None or (v is not None and v > best + min_delta):
                        best, wait = v, 0
                    else:
                        wait += 1
                        stop = n if wait >= patience else None
                state = [best, wait, stop, n + 1]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)
                out = []
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return rows.repartition(*keys).sortWithinPartitions(*keys, "__s", "__v").mapInArrow(run, schema)

