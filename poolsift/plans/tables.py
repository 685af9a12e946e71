"""Stand-ins for the reference's inputs, derived from the supplied tables.

Every registered query starts from these, so its work grows with the data.
Each Spark builder has a SQL twin (``SQL_*``) used by the DuckDB oracle.

* embeddings   -> pool rows ``uid, label, embedding ARRAY<DOUBLE>``
* labelled set -> the reference's initial budget drawn from the embeddings
                  (5 rows of minority class 0, 100 rows in total)
* scored rows  -> logits = dot products of the whole vector with the 10 class means x 100
* scalar log   -> events per (run = user, tag, step = day): one value per step
* run params   -> customer + nation as the per-run hyper-parameter table
* label log    -> lineitem: run = supplier, class = return flag, round = month
* corpus       -> documents + labels (toxic as the imbalanced class)
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import sql_order_key
from ..functions.vectors import as_doubles
from ..operators.sampling import initial_budget
from ..operators.scorers import class_means, with_mean_logits
from ..session import cut_lineage

NUM_CLASSES = 10
MINORITY = [0]
POSITIVE_BUDGET = 5
TOTAL_BUDGET = 100
BUDGET_SEED = 42
NUM_LOGITS = NUM_CLASSES
LOGIT_SCALE = 100.0

# Fixed stand-in vocabulary: event types as reference-style metric tags and
# run-level strategy names per region key.
TIMER_EVENT = "error"
REGION_STRATEGY = {0: "anchored_entropy", 1: "seals_entropy", 2: "randomsubset_entropy",
                   3: "entropy", 4: "random"}
DAY_ORIGIN = "2024-01-01"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("uid"), "label", as_doubles("embedding").alias("embedding"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The initial labelled set; a bounded sample, checkpointed into the shared
    folder so the many plans that reuse it read it instead of recomputing it."""
    lab = initial_budget(embeddings(spark, sf_dir), "label", POSITIVE_BUDGET, TOTAL_BUDGET, MINORITY,
                         seed=BUDGET_SEED)
    return cut_lineage(lab)


def pool(spark: SparkSession, sf_dir: str, lab: DataFrame | None = None) -> DataFrame:
    lab = lab if lab is not None else labelled(spark, sf_dir)
    return embeddings(spark, sf_dir).join(lab.select("uid"), "uid", "left_anti")


def with_logits(spark: SparkSession, sf_dir: str, df: DataFrame) -> DataFrame:
    """Logits of a model in closed form: the class means of all embeddings."""
    return with_mean_logits(df, class_means(embeddings(spark, sf_dir), NUM_CLASSES), LOGIT_SCALE)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_logits(spark, sf_dir, embeddings(spark, sf_dir))


def scalar_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read(spark, sf_dir, "events")
    tag = F.concat(F.when(F.col("event_type") == TIMER_EVENT, F.lit("timer/")).otherwise(F.lit("test/")),
                   F.col("event_type"))
    step = F.datediff(F.to_date("ts"), F.lit(DAY_ORIGIN).cast("date"))
    return (ev.groupBy(F.col("user_id").alias("run"), tag.alias("tag"), step.alias("step"))
              .agg(F.sum("value").alias("value")))


def run_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    n = read(spark, sf_dir, "nation")
    m = F.create_map(*[x for k, v in REGION_STRATEGY.items() for x in (F.lit(k), F.lit(v))])
    return (c.join(n, c.c_nationkey == n.n_nationkey, "left")
             .select(F.col("c_custkey").alias("run"), F.col("c_mktsegment").alias("dataset_name"),
                     F.col("n_name").alias("model_name"),
                     F.try_element_at(m, F.col("n_regionkey")).alias("strategy_name"),
                     F.lit("main").alias("experiment_group"), F.col("c_acctbal").alias("seed_score")))


def label_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    rnd = F.year("l_shipdate") * 12 + F.month("l_shipdate")
    return li.select(F.col("l_suppkey").alias("run"), F.col("l_returnflag").alias("labels"),
                     rnd.alias("labelling_round"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    lab = read(spark, sf_dir, "labels")
    return d.join(lab, "doc_id", "left").select(
        F.col("doc_id").alias("uid"), "text", "lang", "source", "n_chars",
        F.col("toxic").alias("labels"), "quality")


# ------------------------------------------------------------ SQL twins --

def sql_top_n(source: str, n: str, seed, by: str | None = None, uid: str = "uid") -> str:
    part = f"PARTITION BY {by} " if by else ""
    return (f"SELECT * EXCLUDE (__rn) FROM (SELECT *, row_number() OVER ({part}ORDER BY "
            f"{sql_order_key(seed, uid)}, {uid}) AS __rn FROM {source}) WHERE __rn <= {n}")


SQL_EMB = "SELECT vec_id AS uid, label, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings"

SQL_LABELLED_CTES = f"""
emb AS ({SQL_EMB}),
lab_min AS ({sql_top_n("(SELECT * FROM emb WHERE label IN (0))", str(POSITIVE_BUDGET), BUDGET_SEED, by="label")}),
lab_rest AS ({sql_top_n("(SELECT * FROM emb WHERE label NOT IN (0))",
                        f"({TOTAL_BUDGET} - (SELECT count(*) FROM lab_min))", BUDGET_SEED)}),
labelled AS (SELECT * FROM lab_min UNION ALL SELECT * FROM lab_rest),
pool AS (SELECT * FROM emb WHERE uid NOT IN (SELECT uid FROM labelled))"""


def sql_means(rows: str = "emb0") -> str:
    """Scalar subquery: the list of class means of ``rows(label, embedding)``."""
    source = f"({SQL_EMB})" if rows == "emb0" else rows
    return (f"(SELECT list(coalesce(m, list_transform(range((SELECT max(len(embedding)) FROM embeddings)), lambda z: 0.0)) ORDER BY class_id) "
            f"FROM (SELECT range AS class_id FROM range({NUM_CLASSES})) LEFT JOIN (SELECT label, list(a ORDER BY pos) AS m FROM ("
            f"SELECT label, pos, avg(v) AS a FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos "
            f"FROM {source}) GROUP BY label, pos) GROUP BY label) ON label = class_id)")


def sql_logits(vec: str = "embedding", rows: str = "emb0") -> str:
    return f"list_transform({sql_means(rows)}, lambda c: list_inner_product({vec}, c) * {LOGIT_SCALE})"


def sql_entropy(logits: str = "logits") -> str:
    m = f"list_max({logits})"
    s = f"list_sum(list_transform({logits}, lambda x: exp(x - {m})))"
    t = f"list_sum(list_transform({logits}, lambda x: exp(x - {m}) * (x - {m})))"
    return f"(ln({s}) - {t} / {s})"


def sql_argmax(logits: str = "logits") -> str:
    return f"(list_position({logits}, list_max({logits})) - 1)"


def sql_max_prob(logits: str = "logits") -> str:
    return f"(1.0 / list_sum(list_transform({logits}, lambda x: exp(x - list_max({logits})))))"


def sql_cos_dist(a: str, b: str) -> str:
    return f"(1.0 - list_cosine_similarity({a}, {b}))"


SQL_SCORED = f"SELECT uid, label, embedding, {sql_logits()} AS logits FROM ({SQL_EMB})"

SQL_SCALAR_LOG = f"""SELECT user_id AS run,
       CASE WHEN event_type = '{TIMER_EVENT}' THEN 'timer/' ELSE 'test/' END || event_type AS tag,
       CAST(date_diff('day', DATE '{DAY_ORIGIN}', CAST(ts AS DATE)) AS INTEGER) AS step,
       sum(value) AS value
FROM events GROUP BY ALL"""

SQL_RUN_PARAMS = ("SELECT c_custkey AS run, c_mktsegment AS dataset_name, n_name AS model_name, "
                  "CASE n_regionkey " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in REGION_STRATEGY.items())
                  + " END AS strategy_name, 'main' AS experiment_group, c_acctbal AS seed_score "
                  "FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")

SQL_LABEL_LOG = ("SELECT l_suppkey AS run, l_returnflag AS labels, "
                 "CAST(year(l_shipdate) * 12 + month(l_shipdate) AS INTEGER) AS labelling_round FROM lineitem")

SQL_CORPUS = ("SELECT d.doc_id AS uid, text, lang, source, n_chars, l.toxic AS labels, l.quality "
              "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
