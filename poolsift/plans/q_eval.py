"""Registered queries: evaluation metrics, calibration, round logs, curve stops."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as EV
from . import tables as T
from .tables import (SQL_LABELLED_CTES, SQL_SCALAR_LOG, SQL_SCORED, sql_argmax, sql_max_prob)

QUERIES: dict = {}
ORACLE: dict = {}


def register(key, sql=None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return deco


def r6(c):
    return F.round(c, 6)


NC = T.NUM_CLASSES
PATIENCE = 3
MIN_DELTA = 1e-5

SQL_PRED = f"SELECT label, {sql_argmax()} AS pred, logits FROM ({SQL_SCORED})"

SQL_COUNTS = f"""p AS ({SQL_PRED}),
cls AS (SELECT CAST(range AS INTEGER) AS class_id FROM range({NC})),
cnt AS (SELECT c.class_id,
  CAST(count(CASE WHEN p.label = c.class_id AND p.pred = c.class_id THEN 1 END) AS BIGINT) AS tp,
  CAST(count(CASE WHEN p.label <> c.class_id AND p.pred = c.class_id THEN 1 END) AS BIGINT) AS fp,
  CAST(count(CASE WHEN p.label = c.class_id AND p.pred <> c.class_id THEN 1 END) AS BIGINT) AS fn,
  CAST(count(CASE WHEN p.label <> c.class_id AND p.pred <> c.class_id THEN 1 END) AS BIGINT) AS tn
  FROM cls c CROSS JOIN p GROUP BY c.class_id)"""


def _sdiv(a, b):
    return f"(CASE WHEN ({b}) = 0 THEN 0.0 ELSE ({a}) / ({b}) END)"


def _sql_five(tp="tp", fp="fp", fn="fn", tn="tn", suffix=""):
    return ", ".join([
        f"round({_sdiv(f'1.0 * {tp}', f'{tp} + {fn}')}, 6) AS accuracy{suffix}",
        f"round({_sdiv(f'2.0 * {tp}', f'2 * {tp} + {fp} + {fn}')}, 6) AS f1{suffix}",
        f"round({_sdiv(f'1.0 * {tp}', f'{tp} + {fp}')}, 6) AS precision{suffix}",
        f"round({_sdiv(f'1.0 * {tp}', f'{tp} + {fn}')}, 6) AS recall{suffix}",
        f"round({_sdiv(f'1.0 * {tn}', f'{tn} + {fp}')}, 6) AS specificity{suffix}",
    ])


def _scored(spark, d):
    return T.scored(spark, d)


@register("confusion", f"""WITH p AS ({SQL_PRED})
SELECT CAST(label AS INTEGER) AS label, CAST(pred AS INTEGER) AS pred, count(*) AS n FROM p GROUP BY ALL""")
def q_confusion(spark, d):
    return EV.confusion(_scored(spark, d))


@register("metrics_perclass", f"""WITH {SQL_COUNTS}
SELECT class_id, {_sql_five()}, tp, fp, fn, tn FROM cnt""")
def q_metrics_perclass(spark, d):
    m = EV.metrics_perclass(_scored(spark, d), NC)
    return m.select("class_id", *[r6(c).alias(c) for c in ("accuracy", "f1", "precision", "recall", "specificity")],
                    "tp", "fp", "fn", "tn")


@register("metrics_micro", f"""WITH {SQL_COUNTS},
s AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(tn) AS tn FROM cnt)
SELECT {_sql_five(suffix="_micro")} FROM s""")
def q_metrics_micro(spark, d):
    m = EV.metrics_micro(_scored(spark, d), NC)
    return m.select(*[r6(c).alias(c) for c in m.columns])


@register("metrics_macro_f1", f"""WITH {SQL_COUNTS}
SELECT round(avg({_sdiv('2.0 * tp', '2 * tp + fp + fn')}), 6) AS f1_macro FROM cnt WHERE tp + fp + fn > 0""")
def q_metrics_macro_f1(spark, d):
    return EV.metrics_macro_f1(_scored(spark, d), NC).select(r6("f1_macro").alias("f1_macro"))


@register("minority_f1", f"""WITH {SQL_COUNTS}
SELECT round(avg({_sdiv('2.0 * tp', '2 * tp + fp + fn')}), 6) AS avg_f1_minclass FROM cnt WHERE class_id IN (0)""")
def q_minority_f1(spark, d):
    return EV.minority_f1(_scored(spark, d), NC, T.MINORITY).select(r6("avg_f1_minclass").alias("avg_f1_minclass"))


@register("calibration", f"""WITH s AS ({SQL_SCORED}),
r AS (SELECT {sql_max_prob()} AS conf, CASE WHEN {sql_argmax()} = label THEN 1.0 ELSE 0.0 END AS hit FROM s),
b AS (SELECT least(floor(conf * 10), 9) AS bin, count(*) AS n, avg(conf) AS conf, avg(hit) AS acc FROM r GROUP BY 1),
t AS (SELECT count(*) AS tot FROM r)
SELECT round(sum(n / tot * abs(acc - conf)), 6) AS ece, round(max(abs(acc - conf)), 6) AS mce,
       round(sqrt(sum(n / tot * (acc - conf) * (acc - conf))), 6) AS rmsce FROM b, t""")
def q_calibration(spark, d):
    c = EV.calibration(_scored(spark, d))
    return c.select(*[r6(x).alias(x) for x in c.columns])


@register("mean_loss", f"""WITH s AS ({SQL_SCORED})
SELECT round(avg(list_max(logits) + ln(list_sum(list_transform(logits, lambda x: exp(x - list_max(logits)))))
                 - logits[label + 1]), 6) AS loss FROM s""")
def q_mean_loss(spark, d):
    return EV.mean_loss(_scored(spark, d)).select(r6("loss").alias("loss"))


@register("round_counts", f"""WITH {SQL_LABELLED_CTES},
cls AS (SELECT CAST(range AS INTEGER) AS class_id FROM range({NC})),
c AS (SELECT label, count(*) AS n FROM labelled GROUP BY label)
SELECT cls.class_id, CAST(coalesce(c.n, 0) AS BIGINT) AS count,
       (SELECT count(*) FROM labelled) AS labelled_size, (SELECT count(*) FROM pool) AS pool_size
FROM cls LEFT JOIN c ON c.label = cls.class_id""")
def q_round_counts(spark, d):
    lab = T.labelled(spark, d)
    return EV.round_counts(lab, T.pool(spark, d, lab), NC)


@register("best_step", f"""WITH l AS ({SQL_SCALAR_LOG})
SELECT run, tag, first(step ORDER BY value DESC, step) AS best_step, round(max(value), 6) AS best_value
FROM l GROUP BY run, tag""")
def q_best_step(spark, d):
    b = EV.best_step(T.scalar_log(spark, d), ["run", "tag"])
    return b.select("run", "tag", "best_step", r6("best_value").alias("best_value"))


@register("early_stop_step", f"""WITH RECURSIVE l AS ({SQL_SCALAR_LOG}),
pts AS (SELECT run, tag, value AS v, CAST(row_number() OVER (PARTITION BY run, tag ORDER BY step) - 1 AS INTEGER) AS i
        FROM l),
r AS (
  SELECT run, tag, i, v AS best, 0 AS wait, CASE WHEN 0 >= {PATIENCE} THEN 0 END AS stop FROM pts WHERE i = 0
  UNION ALL
  SELECT r.run, r.tag, p.i,
    CASE WHEN r.stop IS NOT NULL THEN r.best WHEN p.v > r.best + {MIN_DELTA} THEN p.v ELSE r.best END,
    CASE WHEN r.stop IS NOT NULL THEN r.wait WHEN p.v > r.best + {MIN_DELTA} THEN 0 ELSE r.wait + 1 END,
    CASE WHEN r.stop IS NOT NULL THEN r.stop
         WHEN (CASE WHEN p.v > r.best + {MIN_DELTA} THEN 0 ELSE r.wait + 1 END) >= {PATIENCE} THEN p.i END
  FROM r JOIN pts p ON p.run = r.run AND p.tag = r.tag AND p.i = r.i + 1)
SELECT run, tag, CAST(max(stop) AS INTEGER) AS stop_index, round(arg_max(best, i), 6) AS best_value,
       CAST(count(*) AS INTEGER) AS n_steps
FROM r GROUP BY run, tag""")
def q_early_stop_step(spark, d):
    e = EV.early_stop_step(T.scalar_log(spark, d), ["run", "tag"], patience=PATIENCE, min_delta=MIN_DELTA)
    return e.select("run", "tag", "stop_index", r6("best_value").alias("best_value"), "n_steps")
