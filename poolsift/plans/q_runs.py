"""Registered queries: experiment-log analytics (curves, cells, joins, reshapes).

Inputs: the daily scalar log (events), the run-parameter table (customer +
nation) and the label log (lineitem); see ``tables``.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as TX
from ..operators import curves as C
from ..operators import relational as R
from ..operators import report as RP
from ..sources.sinks import id_arrays
from . import tables as T
from .tables import SQL_LABEL_LOG, SQL_RUN_PARAMS, SQL_SCALAR_LOG

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


MIN_RUNS = 3
LAST_STEP = 28          # time rows at or after this step are recoded to LAST_STEP + 1
MINORITY_FLAG = "R"
VARIABLES = ["f1_majority", "f1_minority", "time"]
# Fixed display names for strategies; one key is deliberately misspelt
# ("seals-entropy"), so its rows map to NULL and are dropped.
DISPLAY = {"anchored_entropy": "Anchored", "seals-entropy": "SEALS",
           "randomsubset_entropy": "RandomSubset", "noop_entropy": "Entropy", "noop_random": "Random"}


def _log(spark, d):
    return T.scalar_log(spark, d)


def _params(spark, d):
    return T.run_params(spark, d).withColumn("strategy_name", TX.fix_strategy_name("strategy_name"))


SQL_PARAMS = f"""SELECT * REPLACE (CASE WHEN contains(strategy_name, '_') THEN strategy_name
    ELSE 'noop_' || strategy_name END AS strategy_name) FROM ({SQL_RUN_PARAMS})"""


def _variable():
    t = F.col("tag")
    return (F.when(t.contains("timer/"), F.lit("time"))
             .when(t == "test/purchase", F.lit("f1_minority"))
             .otherwise(F.lit("f1_majority")))


SQL_VARIABLE = ("CASE WHEN contains(tag, 'timer/') THEN 'time' WHEN tag = 'test/purchase' THEN 'f1_minority' "
                "ELSE 'f1_majority' END")


def _joined(spark, d):
    """Curves (final value per step) joined to run parameters, classified by variable."""
    curves = C.curve_metrics(_log(spark, d), ["run", "tag"])
    j = curves.join(_params(spark, d), on="run", how="left")
    return j.withColumn("variable", _variable()).filter(F.col("dataset_name").isNotNull())


SQL_CURVES = f"""(SELECT run, tag, step,
    CASE WHEN contains(tag, 'timer/') THEN sum(value) OVER w / 60.0
         ELSE sum(value) OVER w - (first(value) OVER w + value) / 2.0 END AS value
  FROM ({SQL_SCALAR_LOG})
  WINDOW w AS (PARTITION BY run, tag ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""

SQL_JOINED = f"""(SELECT c.*, h.dataset_name, h.model_name, h.strategy_name, h.experiment_group, h.seed_score,
    {SQL_VARIABLE} AS variable
  FROM {SQL_CURVES} c LEFT JOIN ({SQL_PARAMS}) h USING (run) WHERE h.dataset_name IS NOT NULL)"""

CELL = ["dataset_name", "strategy_name", "step"]


# -------------------------------------------------------------- log scan --

@register("scalar_log", f"SELECT run, tag, step, round(value, 6) AS value FROM ({SQL_SCALAR_LOG})")
def q_scalar_log(spark, d):
    return _log(spark, d).select("run", "tag", "step", r6("value").alias("value"))


@register("tag_filter", f"""SELECT run, tag, step FROM ({SQL_SCALAR_LOG})
WHERE (contains(tag, 'test/') AND NOT ends_with(tag, 'view') AND starts_with(tag, 'test'))
   OR regexp_matches(tag, '^timer/(error|query_time)$')""")
def q_tag_filter(spark, d):
    t = F.col("tag")
    cond = (t.contains("test/") & ~t.endswith("view") & t.startswith("test")) | \
        t.rlike("^timer/(error|query_time)$")
    return _log(spark, d).filter(cond).select("run", "tag", "step")


# ---------------------------------------------------------------- curves --

@register("running_auc", f"""SELECT run, tag, step,
  round(sum(value) OVER w - (first(value) OVER w + value) / 2.0, 6) AS auc
FROM ({SQL_SCALAR_LOG}) WHERE contains(tag, 'test/')
WINDOW w AS (PARTITION BY run, tag ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def q_running_auc(spark, d):
    log = _log(spark, d).filter(F.col("tag").contains("test/"))
    return C.running_auc(log, ["run", "tag"]).select("run", "tag", "step", r6("auc").alias("auc"))


@register("running_minutes", f"""SELECT run, tag, step,
  round(sum(value) OVER (PARTITION BY run, tag ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / 60.0, 6)
  AS minutes FROM ({SQL_SCALAR_LOG}) WHERE contains(tag, 'timer/')""")
def q_running_minutes(spark, d):
    log = _log(spark, d).filter(F.col("tag").contains("timer/"))
    return C.running_minutes(log, ["run", "tag"]).select("run", "tag", "step", r6("minutes").alias("minutes"))


@register("curve_metrics", f"SELECT run, tag, step, round(value, 6) AS value FROM {SQL_CURVES}")
def q_curve_metrics(spark, d):
    c = C.curve_metrics(_log(spark, d), ["run", "tag"])
    return c.select("run", "tag", "step", r6("value").alias("value"))


@register("ordered_list", f"""SELECT run, tag, list(round(value, 6) ORDER BY step) AS values,
  round(list_sum(list(value ORDER BY step)), 6) AS total FROM ({SQL_SCALAR_LOG}) GROUP BY run, tag""")
def q_ordered_list(spark, d):
    ol = RP.ordered_list(_log(spark, d), ["run", "tag"], "step", "value")
    return ol.select("run", "tag", F.transform("values", lambda x: F.round(x, 6)).alias("values"),
                     r6(F.aggregate("values", F.lit(0.0), lambda s, x: s + x)).alias("total"))


@register("udf_trapz", f"""SELECT run, tag, round(CASE WHEN len(v) <= 1 THEN 0.0
  ELSE list_sum(v) - (v[1] + v[-1]) / 2.0 END, 6) AS auc
FROM (SELECT run, tag, list(value ORDER BY step) AS v FROM ({SQL_SCALAR_LOG}) WHERE contains(tag, 'test/')
      GROUP BY run, tag)""")
def q_udf_trapz(spark, d):
    """The registered SQL function ``trapz(array<double>)`` (Arrow-batched pandas UDF)."""
    from ..functions.udfs import register_trapz
    register_trapz(spark)
    log = _log(spark, d).filter(F.col("tag").contains("test/"))
    RP.ordered_list(log, ["run", "tag"], "step", "value").createOrReplaceTempView("poolsift_curve_lists")
    return spark.sql("SELECT run, tag, round(trapz(values), 6) AS auc FROM poolsift_curve_lists")


# ----------------------------------------------------- joins and mapping --

@register("join_hparams", f"""SELECT c.run, c.tag, c.step, round(c.value, 6) AS value, h.dataset_name, h.strategy_name
FROM {SQL_CURVES} c LEFT JOIN ({SQL_PARAMS}) h USING (run)""")
def q_join_hparams(spark, d):
    c = C.curve_metrics(_log(spark, d), ["run", "tag"])
    j = c.join(_params(spark, d).select("run", "dataset_name", "strategy_name"), "run", "left")
    return j.select("run", "tag", "step", r6("value").alias("value"), "dataset_name", "strategy_name")


@register("case_collapse", f"""SELECT run, tag, CASE WHEN variable = 'time' AND step >= {LAST_STEP}
  THEN {LAST_STEP + 1} ELSE step END AS step, variable
FROM (SELECT *, max(CASE WHEN variable = 'time' AND step >= {LAST_STEP} THEN step END)
        OVER (PARTITION BY run, tag) AS last_hi FROM {SQL_JOINED})
WHERE NOT (variable = 'time' AND step >= {LAST_STEP}) OR step = last_hi""")
def q_case_collapse(spark, d):
    """Variable classes by CASE, and the conditional recode of late time steps to one
    step; only the latest such step per curve is kept, so no key is duplicated."""
    j = _joined(spark, d)
    late = (F.col("variable") == "time") & (F.col("step") >= LAST_STEP)
    last_hi = F.max(F.when(late, F.col("step"))).over(Window.partitionBy("run", "tag"))
    kept = j.withColumn("__hi", last_hi).filter(~late | (F.col("step") == F.col("__hi")))
    step = F.when(late, F.lit(LAST_STEP + 1)).otherwise(F.col("step"))
    return kept.select("run", "tag", step.alias("step"), "variable")


def _sql_display():
    return "CASE strategy_name " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in DISPLAY.items()) + " END"


@register("map_lookup", f"""SELECT run, display, model FROM (SELECT run, {_sql_display()} AS display,
  CASE WHEN model_name = 'GERMANY' THEN 'DEUTSCHLAND' ELSE model_name END AS model FROM ({SQL_PARAMS}))
WHERE display IS NOT NULL""")
def q_map_lookup(spark, d):
    """Dictionary map (unmatched -> NULL, rows dropped) and a one-value replace (rest kept)."""
    p = _params(spark, d).select("run", F.col("strategy_name").alias("display"), F.col("model_name").alias("model"))
    p = R.replace_value(p, "model", "GERMANY", "DEUTSCHLAND")
    return R.map_lookup(p, "display", DISPLAY, drop_unmatched=True)


@register("coalesce_cols", f"""SELECT c.run, c.tag, c.step, coalesce(h.strategy_name, 'unknown') AS strategy_name,
  coalesce(h.dataset_name, c.tag) AS dataset_name FROM {SQL_CURVES} c LEFT JOIN ({SQL_PARAMS}) h USING (run)""")
def q_coalesce_cols(spark, d):
    c = C.curve_metrics(_log(spark, d), ["run", "tag"])
    j = c.join(_params(spark, d), "run", "left").fillna({"strategy_name": "unknown"})
    return j.select("run", "tag", "step", "strategy_name",
                    F.coalesce("dataset_name", "tag").alias("dataset_name"))


@register("budget_axis", f"""SELECT run, tag, step, step * 25 + 100 AS budget FROM ({SQL_SCALAR_LOG})""")
def q_budget_axis(spark, d):
    return _log(spark, d).select("run", "tag", "step", (F.col("step") * 25 + 100).alias("budget"))


@register("prune_columns", f"SELECT run, dataset_name, model_name, strategy_name FROM ({SQL_PARAMS})")
def q_prune_columns(spark, d):
    """Drop constant, all-NULL and ``seed``-named columns of the run table."""
    return R.prune_columns(_params(spark, d), drop_pattern="seed")


# ------------------------------------------------------------ cell stats --

@register("median_iqr", f"""SELECT dataset_name, strategy_name, variable, step,
  round(quantile_cont(value, 0.5), 6) AS median,
  round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr
FROM {SQL_JOINED} GROUP BY ALL""")
def q_median_iqr(spark, d):
    q = RP.group_quartiles(_joined(spark, d), ["dataset_name", "strategy_name", "variable", "step"])
    return q.select("dataset_name", "strategy_name", "variable", "step", r6("median").alias("median"),
                    r6("iqr").alias("iqr"))


SQL_CELLS = f"""(SELECT dataset_name, strategy_name, step, count(DISTINCT run) AS n_runs FROM {SQL_JOINED}
  GROUP BY ALL HAVING count(DISTINCT run) >= {MIN_RUNS}
     OR (contains(strategy_name, 'noop') AND NOT contains(strategy_name, 'random')))"""


def _exempt():
    s = F.col("strategy_name")
    return s.contains("noop") & ~s.contains("random")


def _cells(spark, d):
    return RP.count_distinct_having(_joined(spark, d), CELL, "run", MIN_RUNS, _exempt())


@register("nunique_runs", f"SELECT * FROM {SQL_CELLS}")
def q_nunique_runs(spark, d):
    return _cells(spark, d)


@register("nunique_transform", f"""SELECT * FROM (SELECT j.run, j.dataset_name, j.strategy_name, j.step, j.variable,
  count(DISTINCT j.run) OVER (PARTITION BY dataset_name, strategy_name, step) AS n_unique FROM {SQL_JOINED} j)
WHERE n_unique >= {MIN_RUNS}""")
def q_nunique_transform(spark, d):
    j = _joined(spark, d).select("run", "dataset_name", "strategy_name", "step", "variable")
    return RP.distinct_count_back(j, CELL, "run").filter(F.col("n_unique") >= MIN_RUNS)


SQL_BUDGET = f"""(SELECT dataset_name, strategy_name, max_step_exp,
  CASE WHEN NOT starts_with(strategy_name, 'noop') OR contains(strategy_name, 'random')
       THEN min(CASE WHEN NOT starts_with(strategy_name, 'noop') OR contains(strategy_name, 'random')
                     THEN max_step_exp END) OVER (PARTITION BY dataset_name)
       ELSE max_step_exp END AS min_max_step
FROM (SELECT dataset_name, strategy_name, max(step) AS max_step_exp FROM {SQL_CELLS} GROUP BY ALL))"""


@register("budget_match", f"SELECT * FROM {SQL_BUDGET}")
def q_budget_match(spark, d):
    return C.budget_match(_cells(spark, d), ["dataset_name"])


@register("max_step_per_run", f"""SELECT run, tag, step, max(step) OVER (PARTITION BY run) AS max_step
FROM ({SQL_SCALAR_LOG})""")
def q_max_step_per_run(spark, d):
    return C.group_max(_log(spark, d).select("run", "tag", "step"), ["run"], "step", "max_step")


@register("last_step_rows", f"""SELECT run, tag, step, round(value, 6) AS value FROM (
  SELECT *, max(step) OVER (PARTITION BY run, tag) AS m FROM ({SQL_SCALAR_LOG})) WHERE step = m""")
def q_last_step_rows(spark, d):
    r = C.last_step_rows(_log(spark, d), ["run", "tag"])
    return r.select("run", "tag", "step", r6("value").alias("value"))


@register("common_last_step", f"""SELECT min(m) AS max_step FROM (SELECT max(step) AS m FROM {SQL_CELLS}
  GROUP BY dataset_name, strategy_name)""")
def q_common_last_step(spark, d):
    return C.common_last_step(_cells(spark, d), ["dataset_name", "strategy_name"])


SQL_AGG = f"""(SELECT dataset_name, strategy_name, variable, step,
  quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr
  FROM {SQL_JOINED} GROUP BY ALL)"""


def _agg(spark, d):
    return RP.group_quartiles(_joined(spark, d), ["dataset_name", "strategy_name", "variable", "step"])


@register("overall_vs_matched", f"""WITH b AS {SQL_BUDGET}, a AS {SQL_AGG},
o AS (SELECT a.dataset_name, a.strategy_name, a.variable, a.median FROM a JOIN b USING (dataset_name, strategy_name)
      WHERE a.step = b.max_step_exp),
m AS (SELECT a.dataset_name, a.strategy_name, a.variable, a.median FROM a JOIN b USING (dataset_name, strategy_name)
      WHERE a.step = b.min_max_step)
SELECT dataset_name, strategy_name, variable, round(o.median, 6) AS overall_median,
       round(m.median, 6) AS matched_median, o.median IS DISTINCT FROM m.median AS differs
FROM o FULL OUTER JOIN m USING (dataset_name, strategy_name, variable)""")
def q_overall_vs_matched(spark, d):
    b = C.budget_match(_cells(spark, d), ["dataset_name"])
    a = _agg(spark, d)
    keys = ["dataset_name", "strategy_name"]
    o = a.join(b, keys).filter(F.col("step") == F.col("max_step_exp")).select(*keys, "variable", "median")
    m = a.join(b, keys).filter(F.col("step") == F.col("min_max_step")).select(*keys, "variable", "median")
    s = RP.side_by_side(o, m, keys + ["variable"], "overall_", "matched_", compare="median")
    return s.select(*keys, "variable", r6("overall_median").alias("overall_median"),
                    r6("matched_median").alias("matched_median"), "differs")


@register("pivot_metrics", f"""WITH a AS {SQL_AGG}, cs AS (SELECT min(m) AS ms FROM (SELECT max(step) AS m FROM {SQL_CELLS}
  GROUP BY dataset_name, strategy_name))
SELECT dataset_name, strategy_name,
  round(first(median) FILTER (WHERE variable = 'f1_majority'), 6) AS median_f1_majority,
  round(first(median) FILTER (WHERE variable = 'f1_minority'), 6) AS median_f1_minority,
  round(first(median) FILTER (WHERE variable = 'time'), 6) AS median_time
FROM a WHERE step = (SELECT ms FROM cs) GROUP BY dataset_name, strategy_name""")
def q_pivot_metrics(spark, d):
    """Median per cell at the common last step, one column per variable."""
    last = C.common_last_step(_cells(spark, d), ["dataset_name", "strategy_name"]).select("max_step").scalar()
    a = _agg(spark, d).filter(F.col("step") == last)
    w = RP.pivot_wide(a, ["dataset_name", "strategy_name"], "variable", VARIABLES, "median")
    return w.select("dataset_name", "strategy_name", *[r6(f"median_{v}").alias(f"median_{v}") for v in VARIABLES])


SQL_TWO_DEC = ("CAST(floor(CAST(round(round({x}, 6) * 100.0, 0) AS BIGINT) / 100) AS BIGINT)::VARCHAR || '.' || "
               "lpad((CAST(round(round({x}, 6) * 100.0, 0) AS BIGINT) % 100)::VARCHAR, 2, '0')")


@register("format_cells", f"""WITH a AS {SQL_AGG}
SELECT upper(left(dataset_name, 1)) || lower(substr(dataset_name, 2)) AS dataset, strategy_name, variable, step,
  coalesce(({SQL_TWO_DEC.format(x="median")}) || ' ± ' || ({SQL_TWO_DEC.format(x="iqr")}), '') AS cell,
  CASE WHEN step * 25 + 100 < 1000 THEN CAST(CAST(step * 25 + 100 AS BIGINT) AS VARCHAR)
       ELSE printf('%.1f', round((step * 25 + 100) / 1000.0, 1)) || 'k' END AS budget
FROM a""")
def q_format_cells(spark, d):
    a = _agg(spark, d)
    return a.select(F.initcap(F.lower("dataset_name")).alias("dataset"), "strategy_name", "variable", "step",
                    TX.format_median_iqr("median", "iqr").alias("cell"),
                    TX.format_thousands(F.col("step") * 25 + 100).alias("budget"))


# ----------------------------------------------------------- label log --

SQL_LABEL_COUNTS = f"""(SELECT run, labelling_round, labels, count(*) AS n FROM ({SQL_LABEL_LOG}) GROUP BY ALL)"""
SQL_CUM = f"""(SELECT *, CAST(sum(n) OVER (PARTITION BY run, labels ORDER BY labelling_round) AS BIGINT) AS cum_n
  FROM {SQL_LABEL_COUNTS})"""


def _label_counts(spark, d):
    return T.label_log(spark, d).groupBy("run", "labelling_round", "labels").agg(F.count(F.lit(1)).alias("n"))


def _cum(spark, d):
    return C.cumulative_counts(_label_counts(spark, d), ["run", "labels"], "labelling_round")


@register("label_counts", f"SELECT * FROM {SQL_LABEL_COUNTS}")
def q_label_counts(spark, d):
    return _label_counts(spark, d)


@register("cumulative_labels", f"SELECT * FROM {SQL_CUM}")
def q_cumulative_labels(spark, d):
    return _cum(spark, d)


@register("share_of_total", f"""SELECT run, labelling_round, labels, cum_n,
  CAST(sum(cum_n) OVER (PARTITION BY run, labelling_round) AS BIGINT) AS total,
  round(cum_n / sum(cum_n) OVER (PARTITION BY run, labelling_round), 6) AS p FROM {SQL_CUM}""")
def q_share_of_total(spark, d):
    s = C.share_of_total(_cum(spark, d), ["run", "labelling_round"])
    return s.select("run", "labelling_round", "labels", "cum_n", "total", r6("p").alias("p"))


@register("gmean_share", f"""WITH s AS (SELECT run, labelling_round, labels,
  cum_n / sum(cum_n) OVER (PARTITION BY run, labelling_round) AS p FROM {SQL_CUM})
SELECT labelling_round, round(CASE WHEN min(p) = 0 THEN 0.0 ELSE exp(avg(ln(p))) END, 6) AS gmean_p
FROM s WHERE labels = '{MINORITY_FLAG}' GROUP BY labelling_round""")
def q_gmean_share(spark, d):
    s = C.share_of_total(_cum(spark, d), ["run", "labelling_round"])
    g = s.filter(F.col("labels") == MINORITY_FLAG).groupBy("labelling_round") \
        .agg(RP.geometric_mean("p").alias("gmean_p"))
    return g.select("labelling_round", r6("gmean_p").alias("gmean_p"))


@register("label_subpool", f"""SELECT c.run, c.labels, c.n, n.n_name FROM
  (SELECT run, labels, count(*) AS n FROM ({SQL_LABEL_LOG}) GROUP BY ALL) c
  LEFT JOIN supplier s ON c.run = s.s_suppkey
  LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey
WHERE s.s_acctbal > 0""")
def q_label_subpool(spark, d):
    """Left joins (the second on unlike-named keys) then a filter on the right side."""
    c = T.label_log(spark, d).groupBy("run", "labels").agg(F.count(F.lit(1)).alias("n"))
    s = T.read(spark, d, "supplier")
    n = T.read(spark, d, "nation")
    j = c.join(s, c.run == s.s_suppkey, "left").join(n, s.s_nationkey == n.n_nationkey, "left")
    return j.filter(F.col("s_acctbal") > 0).select("run", "labels", "n", "n_name")


@register("explode_ids", f"""SELECT run, labelling_round, unnest(ids) AS uid FROM (
  SELECT l_suppkey AS run, CAST(year(l_shipdate) * 12 + month(l_shipdate) AS INTEGER) AS labelling_round,
         list(l_orderkey * 8 + l_linenumber) AS ids FROM lineitem GROUP BY ALL)""")
def q_explode_ids(spark, d):
    """Per-round id arrays (as the round files store them) back to rows."""
    li = T.read(spark, d, "lineitem")
    rnd = (F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("labelling_round")
    rows = li.select(F.col("l_suppkey").alias("run"), rnd,
                     (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("uid"))
    arr = id_arrays(rows, ["run", "labelling_round"], "uid", "ids")
    return arr.select("run", "labelling_round", F.explode("ids").alias("uid"))


@register("union_ragged", f"""SELECT run, tag, step, round(value, 6) AS value, NULL::INTEGER AS labelling_round,
  NULL::VARCHAR AS labels, NULL::BIGINT AS n FROM ({SQL_SCALAR_LOG})
UNION ALL BY NAME SELECT run, NULL::VARCHAR AS tag, NULL::INTEGER AS step, NULL::DOUBLE AS value, labelling_round,
  labels, n FROM {SQL_LABEL_COUNTS}""")
def q_union_ragged(spark, d):
    a = _log(spark, d).select("run", "tag", "step", r6("value").alias("value"))
    return R.union_ragged([a, _label_counts(spark, d)])


# ------------------------------------------------------- grids, presence --

SQL_FOUND = "SELECT DISTINCT user_id, event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events"


@register("design_grid", f"""SELECT u.user_id, t.event_type, d.day FROM (SELECT DISTINCT user_id FROM events) u
  CROSS JOIN (SELECT DISTINCT event_type FROM events) t CROSS JOIN (SELECT DISTINCT CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events) d""")
def q_design_grid(spark, d):
    ev = T.read(spark, d, "events").select("user_id", "event_type", F.to_date("ts").cast("string").alias("day"))
    return RP.design_grid(ev, ["user_id", "event_type", "day"], large_axis="user_id")


@register("missing_runs", f"""SELECT u.user_id, t.event_type, d.day FROM (SELECT DISTINCT user_id FROM events) u
  CROSS JOIN (SELECT DISTINCT event_type FROM events) t CROSS JOIN (SELECT DISTINCT CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events) d
  ANTI JOIN ({SQL_FOUND}) f ON f.user_id = u.user_id AND f.event_type = t.event_type AND f.day = d.day""")
def q_missing_runs(spark, d):
    ev = T.read(spark, d, "events").select("user_id", "event_type", F.to_date("ts").cast("string").alias("day"))
    grid = RP.design_grid(ev, ["user_id", "event_type", "day"], large_axis="user_id")
    return RP.missing_combinations(grid, ev, ["user_id", "event_type", "day"])


@register("outer_indicator", """SELECT coalesce(c.run, e.run) AS run,
  CASE WHEN c.run IS NOT NULL AND e.run IS NOT NULL THEN 'both' WHEN c.run IS NOT NULL THEN 'left_only'
       ELSE 'right_only' END AS _merge
FROM (SELECT DISTINCT c_custkey AS run FROM customer) c
FULL OUTER JOIN (SELECT DISTINCT user_id AS run FROM events) e ON c.run = e.run""")
def q_outer_indicator(spark, d):
    """Expected runs (run table) against found runs (logs): missing and unexpected."""
    exp = T.read(spark, d, "customer").select(F.col("c_custkey").alias("run"))
    found = T.read(spark, d, "events").select(F.col("user_id").alias("run"))
    return RP.outer_indicator(exp, found, ["run"])


# ----------------------------------------------------------- name parts --

SQL_PATHS = f"""(SELECT run, CASE WHEN strategy_name LIKE 'anchored%'
    THEN '../outputs/ablations/num_anchors/' || CAST(run AS VARCHAR)
    ELSE '../outputs/main/' || lower(dataset_name) || '/' || CAST(run AS VARCHAR) END AS path,
  strategy_name FROM ({SQL_RUN_PARAMS}))"""


def _paths(spark, d):
    p = T.run_params(spark, d)
    path = F.when(F.col("strategy_name").like("anchored%"),
                  F.concat(F.lit("../outputs/ablations/num_anchors/"), F.col("run").cast("string"))) \
        .otherwise(F.concat(F.lit("../outputs/main/"), F.lower("dataset_name"), F.lit("/"),
                            F.col("run").cast("string")))
    return p.select("run", path.alias("path"), "strategy_name")


@register("path_parts", f"""SELECT run, trim(CASE WHEN contains(path, 'ablations') OR contains(path, 'additional')
    THEN array_to_string(string_split(path, '/')[3:4], '-') ELSE string_split(path, '/')[3] END) AS experiment_group,
  regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent FROM {SQL_PATHS}""")
def q_path_parts(spark, d):
    p = _paths(spark, d)
    return p.select("run", TX.experiment_group("path").alias("experiment_group"),
                    TX.parent_dir("path").alias("parent"))


@register("strategy_parts", f"""SELECT run, fixed, split_part(fixed, '_', 1) AS stage, split_part(fixed, '_', 2) AS base,
  split_part(fixed, '_', 3) AS extra, string_split(strategy_name, '_')[2] AS second_or_null
FROM (SELECT run, strategy_name, CASE WHEN contains(strategy_name, '_') THEN strategy_name
      ELSE 'noop_' || strategy_name END AS fixed FROM ({SQL_RUN_PARAMS}))""")
def q_strategy_parts(spark, d):
    p = T.run_params(spark, d).withColumn("fixed", TX.fix_strategy_name("strategy_name"))
    return p.select("run", "fixed", TX.name_part("fixed", "_", 1).alias("stage"),
                    TX.name_part("fixed", "_", 2).alias("base"), TX.name_part("fixed", "_", 3).alias("extra"),
                    TX.name_part_or_null("strategy_name", "_", 1).alias("second_or_null"))
