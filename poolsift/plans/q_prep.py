"""Registered queries: corpus preparation -- ids, labels, sampling, text, stats."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as TX
from ..operators import labels as L
from ..operators import preparation as PR
from ..operators import relational as R
from ..operators import report as RP
from ..operators import sampling as S
from ..session import shared_path
from ..sources import id_tables as IT
from . import tables as T
from .tables import SQL_CORPUS, SQL_LABELLED_CTES, sql_top_n

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


SQL_LABELLED_DOCS = f"SELECT * FROM ({SQL_CORPUS}) WHERE labels IS NOT NULL"

# Fixed stand-in rule table for the last-match multiclass label over the
# words of part names; rule order matters (later rules overwrite earlier).
PART_RULES = {
    "temperature": ["hot", "cold"],
    "size": ["small", "large", "big"],
    "colour": ["red", "blue", "green"],
    "device": ["widget", "gizmo"],
}
PART_NAMES = L.sorted_names(PART_RULES)
OVERLAP_CODES = ["bolt", "gear", "ring"]


def _part_words(spark, d):
    p = T.read(spark, d, "part")
    return p.select(F.col("p_partkey").alias("uid"), F.split("p_name", " ").alias("words"))


SQL_PART_WORDS = "SELECT p_partkey AS uid, string_split(p_name, ' ') AS words FROM part"


# ------------------------------------------------------------- labels --

@register("label_binary_eq", f"SELECT uid, CAST(coalesce(lang = 'fr', false) AS INTEGER) AS labels FROM ({SQL_CORPUS})")
def q_label_binary_eq(spark, d):
    return T.corpus(spark, d).select("uid", L.binarize("lang", "fr", "eq").alias("labels"))


@register("label_binary_member",
          f"SELECT uid, CAST(coalesce(list_contains(words, 'widget'), false) AS INTEGER) AS labels FROM ({SQL_PART_WORDS})")
def q_label_binary_member(spark, d):
    return _part_words(spark, d).select("uid", L.binarize("words", "widget", "member").alias("labels"))


@register("label_binary_overlap",
          "SELECT uid, CAST(coalesce(list_has_any(words, ['bolt', 'gear', 'ring']), false) AS INTEGER) AS labels "
          f"FROM ({SQL_PART_WORDS})")
def q_label_binary_overlap(spark, d):
    return _part_words(spark, d).select("uid", L.binarize("words", OVERLAP_CODES, "overlap").alias("labels"))


def _sql_multiclass() -> str:
    expr = str(PART_NAMES.index("others"))
    for name, codes in PART_RULES.items():
        lst = "[" + ", ".join(f"'{c}'" for c in codes) + "]"
        expr = f"CASE WHEN coalesce(list_has_any(words, {lst}), false) THEN {PART_NAMES.index(name)} ELSE {expr} END"
    return expr


@register("label_multiclass_last", f"SELECT uid, CAST({_sql_multiclass()} AS INTEGER) AS labels FROM ({SQL_PART_WORDS})")
def q_label_multiclass_last(spark, d):
    return _part_words(spark, d).select("uid", L.multiclass_last("words", PART_RULES, PART_NAMES).alias("labels"))


def _sql_names_values() -> str:
    return ", ".join(f"({i}, '{n}')" for i, n in enumerate(PART_NAMES))


@register("label_names", f"""WITH lab AS (SELECT CAST({_sql_multiclass()} AS INTEGER) AS labels FROM ({SQL_PART_WORDS})),
names AS (SELECT * FROM (VALUES {_sql_names_values()}) t(label, name))
SELECT n.label AS labels, n.name, count(l.labels) AS n FROM names n LEFT JOIN lab l ON l.labels = n.label
GROUP BY n.label, n.name""")
def q_label_names(spark, d):
    lab = _part_words(spark, d).select(L.multiclass_last("words", PART_RULES, PART_NAMES).alias("labels"))
    counts = lab.groupBy("labels").agg(F.count(F.lit(1)).alias("n"))
    names = L.label_names(spark, PART_NAMES).withColumnRenamed("label", "labels")
    return names.join(counts, "labels", "left").select("labels", "name", F.coalesce("n", F.lit(0)).alias("n"))


@register("split_fallback", f"""SELECT uid, CASE WHEN labels IS NOT NULL THEN 'train' ELSE 'test' END AS split
FROM ({SQL_CORPUS})""")
def q_split_fallback(spark, d):
    c = T.corpus(spark, d).select("uid", F.when(F.col("labels").isNotNull(), "train")
                                  .otherwise("validation").alias("split"))
    return L.split_fallback(c)


# ----------------------------------------------------------- sampling --

@register("downsample_prop", f"""WITH docs AS ({SQL_LABELLED_DOCS}),
n AS (SELECT CAST(ceil(0.05 * sum(CASE WHEN labels = 0 THEN 1 ELSE 0 END) / 0.95) AS BIGINT) AS n FROM docs)
SELECT uid, labels FROM docs WHERE labels IS DISTINCT FROM 1
UNION ALL
SELECT uid, labels FROM ({sql_top_n("(SELECT * FROM docs WHERE labels = 1)", "(SELECT n FROM n)", 42)})""")
def q_downsample_prop(spark, d):
    docs = T.corpus(spark, d).filter(F.col("labels").isNotNull())
    return S.downsample_to_prop(docs, "labels", positive=1, prop=0.05, seed=42).select("uid", "labels")


@register("downsample_majority", f"""WITH docs AS ({SQL_LABELLED_DOCS})
SELECT uid, labels FROM docs WHERE labels IS DISTINCT FROM 0
UNION ALL
SELECT uid, labels FROM ({sql_top_n("(SELECT * FROM docs WHERE labels = 0)", "200", 42)})""")
def q_downsample_majority(spark, d):
    docs = T.corpus(spark, d).filter(F.col("labels").isNotNull())
    return S.downsample_class(docs, "labels", 0, 200, seed=42).select("uid", "labels")


STRAT_N = 300


@register("stratified_sample", f"""WITH docs AS ({SQL_CORPUS}),
c AS (SELECT lang, count(*) AS n FROM docs GROUP BY lang),
t AS (SELECT sum(n) AS tot FROM c),
a AS (SELECT lang, least({STRAT_N}, tot) * n AS q, tot FROM c, t),
f AS (SELECT lang, q // tot AS fl, q - (q // tot) * tot AS rem, tot FROM a),
o AS (SELECT lang, fl, row_number() OVER (ORDER BY rem DESC, lang) AS ord,
             least({STRAT_N}, tot) - sum(fl) OVER () AS lft FROM f),
alloc AS (SELECT lang, fl + CASE WHEN ord <= lft THEN 1 ELSE 0 END AS alloc FROM o),
ranked AS (SELECT docs.uid, docs.lang, alloc.alloc, row_number() OVER (PARTITION BY docs.lang
           ORDER BY md5('42:' || CAST(docs.uid AS VARCHAR)), docs.uid) AS rn
           FROM docs JOIN alloc ON docs.lang = alloc.lang)
SELECT uid, lang FROM ranked WHERE rn <= alloc""")
def q_stratified_sample(spark, d):
    docs = T.corpus(spark, d)
    return S.stratified_sample(docs, "lang", STRAT_N, seed=42).select("uid", "lang")


@register("initial_budget", f"""WITH {SQL_LABELLED_CTES}
SELECT uid, label FROM labelled""")
def q_initial_budget(spark, d):
    return T.labelled(spark, d).select("uid", "label")


@register("random_query", f"""WITH {SQL_LABELLED_CTES}
SELECT uid FROM ({sql_top_n("pool", "25", 45)})""")
def q_random_query(spark, d):
    return S.random_query(T.pool(spark, d), 25, seed=45).select("uid")


@register("random_subset", f"""WITH {SQL_LABELLED_CTES}
SELECT uid FROM ({sql_top_n("pool", "200", "42:3")})""")
def q_random_subset(spark, d):
    return S.random_subset(T.pool(spark, d), 200, seed=42, round_=3).select("uid")


# ------------------------------------------------------ relational ops --

@register("assign_uid", """SELECT doc_id, CAST(row_number() OVER (ORDER BY CASE WHEN l.doc_id IS NOT NULL THEN 0 ELSE 1 END,
       d.doc_id) - 1 AS BIGINT) AS uid FROM documents d LEFT JOIN (SELECT doc_id FROM labels) l USING (doc_id)""")
def q_assign_uid(spark, d):
    """Contiguous ids from 0, labelled (train) documents first, then by doc_id."""
    docs = T.read(spark, d, "documents").select("doc_id")
    lab = T.read(spark, d, "labels").select("doc_id").withColumn("__t", F.lit(0))
    j = docs.join(lab, "doc_id", "left").withColumn("__t", F.coalesce("__t", F.lit(1)))
    return R.assign_uid(j, "doc_id", lead=[F.col("__t")]).select("doc_id", "uid")


@register("concat_text", "SELECT doc_id, lang || chr(10) || text AS text FROM documents")
def q_concat_text(spark, d):
    return T.read(spark, d, "documents").select("doc_id", R.concat_text("lang", "text").alias("text"))


@register("select_exclude", "SELECT * EXCLUDE (text, n_chars) RENAME (doc_id AS uid) FROM documents")
def q_select_exclude(spark, d):
    return R.select_exclude(T.read(spark, d, "documents"), ["text", "n_chars"], {"doc_id": "uid"})


@register("ids_semi", f"""WITH {SQL_LABELLED_CTES}
SELECT uid, label FROM emb WHERE uid IN (SELECT uid FROM labelled)""")
def q_ids_semi(spark, d):
    return R.ids_semi(T.embeddings(spark, d), T.labelled(spark, d)).select("uid", "label")


@register("ids_anti", f"""WITH {SQL_LABELLED_CTES}
SELECT uid, label FROM pool""")
def q_ids_anti(spark, d):
    return R.ids_anti(T.embeddings(spark, d), T.labelled(spark, d)).select("uid", "label")


@register("pool_sizes", f"""WITH {SQL_LABELLED_CTES}
SELECT CAST((SELECT count(*) FROM labelled) AS BIGINT) AS labelled_size,
       CAST((SELECT count(*) FROM pool) AS BIGINT) AS pool_size""")
def q_pool_sizes(spark, d):
    return R.pool_sizes(T.embeddings(spark, d), T.labelled(spark, d))


def _id_table(spark, d):
    """All embeddings as a table kept by id, opened anew from its folder."""
    path = shared_path(spark, "by-id")
    IT.write_id_table(T.embeddings(spark, d), path)
    return IT.read_id_table(spark, path)


@register("id_table_semi", f"""WITH {SQL_LABELLED_CTES}
SELECT uid, label, len(embedding) AS dim FROM emb WHERE uid IN (SELECT uid FROM labelled)""")
def q_id_table_semi(spark, d):
    """The labelled rows of a table kept by id; only the ids move."""
    found = IT.rows_by_id(_id_table(spark, d), T.labelled(spark, d))
    return found.select("uid", "label", F.size("embedding").cast("long").alias("dim"))


@register("id_table_anti", f"""WITH {SQL_LABELLED_CTES}
SELECT uid, label, len(embedding) AS dim FROM pool""")
def q_id_table_anti(spark, d):
    """The pool rows of a table kept by id; only the ids move."""
    found = IT.rows_without_id(_id_table(spark, d), T.labelled(spark, d))
    return found.select("uid", "label", F.size("embedding").cast("long").alias("dim"))


@register("id_table_sizes", f"""WITH {SQL_LABELLED_CTES}
SELECT CAST((SELECT count(*) FROM labelled) AS BIGINT) AS labelled_size,
       CAST((SELECT count(*) FROM pool) AS BIGINT) AS pool_size""")
def q_id_table_sizes(spark, d):
    """Sizes of the labelled and the pool part of a table kept by id."""
    return IT.split_sizes(_id_table(spark, d), T.labelled(spark, d))


@register("assert_unique", f"""WITH {SQL_LABELLED_CTES}
SELECT uid, count(*) AS n FROM labelled GROUP BY uid HAVING count(*) > 1""")
def q_assert_unique(spark, d):
    return R.assert_unique(T.labelled(spark, d), ["uid"])


@register("distinct_pairs", "SELECT DISTINCT o_custkey, o_orderpriority FROM orders")
def q_distinct_pairs(spark, d):
    return T.read(spark, d, "orders").select("o_custkey", "o_orderpriority").distinct()


@register("limit_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def q_limit_rows(spark, d):
    o = T.read(spark, d, "orders")
    return R.limit_rows(o.select("o_orderkey", "o_totalprice"), 20,
                        [F.col("o_totalprice").desc(), F.col("o_orderkey")])


# ------------------------------------------------------------ text ----

MAX_LEN = 64


@register("tokenize_truncate", f"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'),
    lambda x: x <> '') AS toks FROM documents)
SELECT doc_id, CAST(len(toks) AS INTEGER) AS n_tokens, toks[1:{MAX_LEN}] AS input_tokens FROM t""")
def q_tokenize_truncate(spark, d):
    docs = T.read(spark, d, "documents")
    toks = docs.select("doc_id", TX.tokens("text").alias("toks"))
    return toks.select("doc_id", F.size("toks").alias("n_tokens"),
                       TX.truncate_tokens("toks", MAX_LEN).alias("input_tokens"))


@register("sort_by_length", """WITH t AS (SELECT doc_id, len(list_filter(regexp_split_to_array(lower(text),
    '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS n FROM documents)
SELECT doc_id, CAST(row_number() OVER (ORDER BY n, doc_id) AS BIGINT) AS position FROM t""")
def q_sort_by_length(spark, d):
    """Documents sorted by token count (ties by id); the position is the output order."""
    docs = T.read(spark, d, "documents").select("doc_id", F.size(TX.tokens("text")).alias("n"))
    return R.assign_uid(docs, ["n", "doc_id"], out="position", start=1).select("doc_id", "position")


# ----------------------------------------------------------- statistics --

@register("class_stats", f"""WITH docs AS ({SQL_LABELLED_DOCS})
SELECT labels, count(*) AS count, round(count(*) / (SELECT count(*) FROM docs), 6) AS perc,
       CASE labels WHEN 0 THEN 'Negative' WHEN 1 THEN 'Positive' END AS name FROM docs GROUP BY labels""")
def q_class_stats(spark, d):
    docs = T.corpus(spark, d).filter(F.col("labels").isNotNull())
    names = L.label_names(spark, ["Negative", "Positive"])
    out = RP.class_stats(docs, "labels", names)
    return out.select("labels", "count", r6("perc").alias("perc"), "name")


@register("class_stats_total", f"""WITH docs AS ({SQL_LABELLED_DOCS})
SELECT labels, count(*) AS count, round(count(*) / (SELECT count(*) FROM docs), 6) AS perc,
       CASE WHEN grouping(labels) = 1 THEN 'total' WHEN labels = 0 THEN 'Negative' ELSE 'Positive' END AS name
FROM docs GROUP BY ROLLUP (labels)""")
def q_class_stats_total(spark, d):
    docs = T.corpus(spark, d).filter(F.col("labels").isNotNull())
    names = L.label_names(spark, ["Negative", "Positive"])
    out = RP.class_stats(docs, "labels", names, total=True)
    return out.select("labels", "count", r6("perc").alias("perc"), "name")


@register("unpivot_stats", f"""WITH docs AS ({SQL_CORPUS}),
s AS (SELECT lang, count(*) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS n_chars, count(labels) AS n_labelled FROM docs GROUP BY lang)
UNPIVOT s ON n_docs, n_chars, n_labelled INTO NAME variable VALUE value""")
def q_unpivot_stats(spark, d):
    docs = T.corpus(spark, d)
    s = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("n_chars"),
                                 F.count("labels").alias("n_labelled"))
    return RP.unpivot_long(s, ["lang"], ["n_docs", "n_chars", "n_labelled"])


# ------------------------------------------- preparation by tables of rules --

# the stand-in datasets' rule tables: (dataset, class, codes), later classes win
SET_RULES = [("parts", name, codes) for name, codes in PART_RULES.items()] + [
    ("documents", "english", ["en"]), ("documents", "french", ["fr"]), ("orders", "urgent", ["1-URGENT", "2-HIGH"])]
SET_TARGETS = [("parts", PR.ALL), ("documents", "french"), ("orders", "urgent")]
SET_RENAMES = [("parts", "p_partkey", "uid"), ("parts", "p_name", "text"), ("documents", "doc_id", "uid"), ("documents", "lang", "codes"),
               ("orders", "o_orderkey", "uid"), ("orders", "o_orderstatus", "text"), ("orders", "o_orderpriority", "codes")]


def _prepared(spark, d):
    rules = spark.createDataFrame([(s, c, i, x) for i, (s, c, codes) in enumerate(SET_RULES) for x in codes],
                                  "dataset string, class_name string, priority int, code string")
    targets = spark.createDataFrame(SET_TARGETS, "dataset string, target string")
    renames = spark.createDataFrame(SET_RENAMES, "dataset string, old string, new string")
    part = T.read(spark, d, "part").withColumn("codes", F.split("p_name", " "))
    sets = {"parts": part, "documents": T.read(spark, d, "documents"), "orders": T.read(spark, d, "orders")}
    split = F.when(F.conv(F.substring(F.md5(F.col("uid").cast("string")), 1, 1), 16, 10).cast("int") < 4, "test").otherwise("train")
    renamed = {name: PR.rename_by_table(df, renames, name).withColumn("split", split) for name, df in sets.items()}
    rows = PR.combined(renamed, renames.limit(0))
    return PR.label_rows(rows, rules, targets), PR.class_names(rules, targets)


def _sql_prepared() -> str:
    split = "CASE WHEN ('0x' || substr(md5(CAST(uid AS VARCHAR)), 1, 1))::INT < 4 THEN 'test' ELSE 'train' END AS split"
    return f"""prep AS (SELECT dataset, uid, {split}, labels FROM (
  SELECT 'parts' AS dataset, uid, CAST({_sql_multiclass()} AS INTEGER) AS labels FROM ({SQL_PART_WORDS})
  UNION ALL SELECT 'documents', doc_id, CAST(coalesce(lang = 'fr', FALSE) AS INTEGER) FROM documents
  UNION ALL SELECT 'orders', o_orderkey, CAST(coalesce(o_orderpriority IN ('1-URGENT', '2-HIGH'), FALSE) AS INTEGER) FROM orders))"""


@register("prepare_labels", f"WITH {_sql_prepared()} SELECT dataset, uid, split, labels FROM prep")
def q_prepare_labels(spark, d):
    """Three datasets in one plan: columns renamed, labels derived, by tables of names and rules."""
    return _prepared(spark, d)[0].select("dataset", "uid", "split", "labels")


@register("prepare_stats", f"""WITH {_sql_prepared()},
names(dataset, label, name) AS (SELECT 'parts', label, name FROM (VALUES {_sql_names_values()}) t(label, name)
  UNION ALL SELECT d, i, n FROM (VALUES ('documents'), ('orders')) a(d), (VALUES (0, 'Negative'), (1, 'Positive')) b(i, n)),
g AS (SELECT s.split, n.* FROM names n, (VALUES ('train'), ('test')) s(split)),
c AS (SELECT dataset, split, labels, count(*) AS n FROM prep GROUP BY ALL),
t AS (SELECT dataset, split, count(*) AS t FROM prep GROUP BY ALL)
SELECT g.dataset, g.split, CAST(g.label AS INTEGER) AS label, g.name, CAST(coalesce(c.n, 0) AS BIGINT) AS n,
  round(coalesce(c.n / t.t, 0.0), 6) AS proportion
FROM g LEFT JOIN c ON c.dataset = g.dataset AND c.split = g.split AND c.labels = g.label
  LEFT JOIN t ON t.dataset = g.dataset AND t.split = g.split""")
def q_prepare_stats(spark, d):
    """Every dataset written with the class statistics and metadata that its write counts."""
    rows, names = _prepared(spark, d)
    by_set: dict = {}
    for r in names.orderBy("dataset", "label").collect():
        by_set.setdefault(r["dataset"], []).append(r["name"])
    out = None
    for name, classes in by_set.items():
        path = shared_path(spark, f"prepared-{name}")
        PR.write_prepared(rows.filter(F.col("dataset") == name), path, classes, metadata={"dataset": name, "binarised": True})
        stats = PR.read_prepared(spark, path)[1].withColumn("dataset", F.lit(name))
        out = stats if out is None else out.unionByName(stats)
    return out.select("dataset", "split", "label", "name", "n", r6("proportion").alias("proportion"))
