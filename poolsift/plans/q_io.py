"""Registered queries: sources and sinks (round trips through the shared
checkpoint folder), streams, approximate kNN, text embedding, active rounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import strategies as ST
from ..operators.anchors import anchors_random
from ..operators.cell_index import CellIndex
from ..operators.rounds import hash_embed, round_log, run_rounds
from ..operators.scorers import mean_scorer
from ..operators.similarity import build_ivf, ivf_knn, knn_join, load_ivf, recall_at_k, write_ivf
from ..session import shared_path
from ..sources import readers as RD
from ..sources import sinks as SK
from ..streaming import streams as SM
from . import tables as T
from .tables import (SQL_CORPUS, SQL_LABEL_LOG, SQL_LABELLED_CTES, SQL_RUN_PARAMS, SQL_SCALAR_LOG, sql_entropy,
                     sql_logits)

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


# ------------------------------------------------------------ datasets --

@register("scan_split", f"SELECT uid, labels FROM ({SQL_CORPUS}) WHERE labels IS NOT NULL")
def q_scan_split(spark, d):
    """Write the corpus partitioned by split (refusing to overwrite), scan the train split."""
    c = T.corpus(spark, d).withColumn("split", F.when(F.col("labels").isNotNull(), "train").otherwise("test"))
    path = SK.write_dataset(c.select("uid", "labels", "text", "split"), shared_path(spark, "corpus"))
    return RD.scan_split(spark, path, "train").select("uid", "labels")


@register("sink_roundtrip", f"SELECT run, tag, step, round(value, 6) AS value FROM ({SQL_SCALAR_LOG})")
def q_sink_roundtrip(spark, d):
    """zstd Parquet sink of the scalar log, read back."""
    path = SK.write_parquet(T.scalar_log(spark, d), shared_path(spark, "scalars"), compression="zstd")
    return spark.read.parquet(path).select("run", "tag", "step", r6("value").alias("value"))


PARAMS_SCHEMA = ("run long, dataset_name string, model_name string, strategy_name string, "
                 "experiment_group string, seed_score double")


@register("tsv_roundtrip", f"SELECT run, dataset_name, model_name, strategy_name FROM ({SQL_RUN_PARAMS})")
def q_tsv_roundtrip(spark, d):
    path = SK.write_tsv(T.run_params(spark, d), shared_path(spark, "hparams-tsv"))
    return RD.read_tsv(spark, path, PARAMS_SCHEMA).select("run", "dataset_name", "model_name", "strategy_name")


ROUNDS_SCHEMA = "run long, labelling_round int, subpool_ids array<long>"


def _write_round_files(spark, d):
    li = T.read(spark, d, "lineitem")
    rnd = (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("int").alias("labelling_round")
    rows = li.select(F.col("l_suppkey").alias("run"), rnd,
                     (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("uid"))
    obj = SK.id_arrays(rows, ["run", "labelling_round"], "uid", "subpool_ids")
    path = shared_path(spark, "rounds-jsonl")
    obj.write.mode("append").json(path)
    return path


SQL_ROUND_ROWS = """SELECT l_suppkey AS run, CAST(year(l_shipdate) * 12 + month(l_shipdate) AS INTEGER) AS labelling_round,
  l_orderkey * 8 + l_linenumber AS uid FROM lineitem"""


@register("jsonl_rounds", SQL_ROUND_ROWS)
def q_jsonl_rounds(spark, d):
    """Append one JSON object per (run, round) with its id array; read back with
    explicit types and the file name, then explode the arrays."""
    path = _write_round_files(spark, d)
    df = RD.read_jsonl(spark, path, ROUNDS_SCHEMA, filename=True)
    return df.select("run", "labelling_round", F.explode("subpool_ids").alias("uid"))


CORPUS_JSON_SCHEMA = "uid long, title string, content string, n_chars long"


@register("jsonl_corpus", """SELECT d.doc_id AS uid, d.lang || chr(10) || d.text AS text,
  CASE WHEN l.doc_id IS NOT NULL THEN 'train' ELSE 'test' END AS split
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def q_jsonl_corpus(spark, d):
    """Two JSON-lines files (train / test) -> one table with a split column and
    the text assembled as title + newline + content."""
    c = T.corpus(spark, d).select("uid", F.col("lang").alias("title"), F.col("text").alias("content"),
                                  "n_chars", "labels")
    base = shared_path(spark, "corpus-jsonl")
    c.filter(F.col("labels").isNotNull()).drop("labels").write.json(f"{base}/trn")
    c.filter(F.col("labels").isNull()).drop("labels").write.json(f"{base}/tst")
    parts = [RD.read_jsonl(spark, f"{base}/{name}", CORPUS_JSON_SCHEMA).withColumn("split", F.lit(split))
             for name, split in (("trn", "train"), ("tst", "test"))]
    out = parts[0].unionByName(parts[1])
    return out.select("uid", F.concat("title", F.lit("\n"), "content").alias("text"), "split")


@register("latin1_lines", """SELECT unnest(string_split(regexp_replace(text, '[^\\x00-\\xFF]', '?', 'g'), chr(10))) AS labels
FROM documents WHERE text IS NOT NULL""")
def q_latin1_lines(spark, d):
    """Every line of every document, blank ones too, written as a Latin-1 file and read
    back (characters outside Latin-1 become '?')."""
    lines = T.read(spark, d, "documents").select(F.explode(F.split("text", "\n", -1)).alias("labels"))
    return RD.read_latin1_lines(spark, SK.write_latin1_lines(lines, shared_path(spark, "latin1")))


def _write_run_artifacts(spark, d, run):
    """All events under one directory per run."""
    ev = T.read(spark, d, "events")
    path = shared_path(spark, "artifacts")
    ev.select(run.alias("run"), "event_id", "value").write.partitionBy("run").parquet(path)
    return path


LACKING = "error"


@register("missing_artifacts", f"""SELECT event_type || '-' || CAST(user_id % 16 AS VARCHAR) AS run FROM events
EXCEPT SELECT event_type || '-' || CAST(user_id % 16 AS VARCHAR) FROM events WHERE event_type <> '{LACKING}'""")
def q_missing_artifacts(spark, d):
    """Runs whose directory lacks the artefact file (listing reads paths, never contents).

    A run is an event type and a sixteenth of the users; runs of one type write nothing.
    """
    run = F.concat_ws("-", "event_type", (F.col("user_id") % 16).cast("string"))
    ev = T.read(spark, d, "events").select(run.alias("run"), "event_type", "event_id", "value")
    root = shared_path(spark, "artifacts")
    ev.filter(F.col("event_type") != LACKING).write.partitionBy("run").parquet(root)
    listing = RD.list_files(spark, root, "*.parquet")
    return RD.missing_artifacts(ev.select("run").distinct(), listing, "run", F.regexp_extract("path", r"/run=([^/]+)/", 1))


@register("scan_with_filename", """SELECT event_type AS run, count(*) AS n FROM events GROUP BY event_type""")
def q_scan_with_filename(spark, d):
    """Recursive scan of per-run files with the file path as a column; run from the path."""
    root = _write_run_artifacts(spark, d, F.col("event_type"))
    df = RD.scan_with_filename(spark, root, "*.parquet")
    run = F.regexp_extract(RD.run_dir("filename"), r"run=([^/]+)$", 1)
    return df.groupBy(run.alias("run")).agg(F.count(F.lit(1)).alias("n"))


@register("flatten_nested", """SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS "props.k" FROM events""")
def q_flatten_nested(spark, d):
    ev = T.read(spark, d, "events")
    return RD.parse_nested(ev, "props", "k int", keep=["event_id"])


@register("flatten_variant", """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS "props.k" FROM events""")
def q_flatten_variant(spark, d):
    """The dotted columns of a JSON column, found from its rows."""
    return RD.flatten_variant(T.read(spark, d, "events"), "props", keep=["event_id"], prefix="props.")


@register("logits_wide", f"""SELECT {", ".join(f"round(logits[{i + 1}], 6) AS logit_{i}" for i in range(T.NUM_LOGITS))},
  uid, 0 AS round FROM (SELECT vec_id AS uid, {sql_logits("CAST(embedding AS DOUBLE[])")} AS logits FROM embeddings)""")
def q_logits_wide(spark, d):
    """Instance logits appended as ``logit_i`` columns, partitioned by round, read back."""
    path = SK.append_logits(T.scored(spark, d), shared_path(spark, "logits"), 0, num_classes=T.NUM_LOGITS)
    back = spark.read.parquet(path)
    return back.select(*[r6(f"logit_{i}").alias(f"logit_{i}") for i in range(T.NUM_LOGITS)], "uid", "round")


@register("labelled_snapshot", f"""WITH {SQL_LABELLED_CTES},
s AS (SELECT uid, {sql_logits()} AS logits FROM pool),
picks AS (SELECT uid FROM s ORDER BY {sql_entropy()} DESC, uid LIMIT 25),
log AS (SELECT uid, -1 AS labelling_round FROM labelled UNION ALL SELECT uid, 0 FROM picks)
SELECT e.uid, e.label, CAST(l.labelling_round AS INTEGER) AS labelling_round, l.uid IS NOT NULL AS is_labelled
FROM emb e LEFT JOIN log l USING (uid)""")
def q_labelled_snapshot(spark, d):
    """Label log (initial set at round -1, one entropy batch at round 0) joined to
    the base table, overwritten as a snapshot and read back."""
    base = T.embeddings(spark, d)
    lab = T.labelled(spark, d)
    picks = ST.entropy_query(T.with_logits(spark, d, T.pool(spark, d, lab)), 25)
    log = lab.select("uid", F.lit(-1).alias("labelling_round")).unionByName(
        picks.select("uid", F.lit(0).alias("labelling_round")))
    path = SK.write_snapshot(base.select("uid", "label"), log, shared_path(spark, "snapshot"))
    return spark.read.parquet(path).select("uid", "label", "labelling_round", "is_labelled")


# ------------------------------------------------------------- streams --

@register("stream_rounds", f"SELECT DISTINCT * FROM ({SQL_ROUND_ROWS})")
def q_stream_rounds(spark, d):
    src = _write_round_files(spark, d)
    sink, ckpt = shared_path(spark, "stream-rounds"), shared_path(spark, "stream-rounds-ckpt")
    SM.stream_round_ids(spark, src, sink, ckpt, schema=ROUNDS_SCHEMA)
    return spark.read.parquet(sink).select("run", "labelling_round", "uid")


def _label_log_rows(rows):
    rnd = (F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("labelling_round")
    return rows.select(F.col("l_suppkey").alias("run"), rnd, F.col("l_returnflag").alias("labels"))


@register("stream_label_counts", f"SELECT run, labelling_round, labels, count(*) AS n FROM ({SQL_LABEL_LOG}) GROUP BY ALL")
def q_stream_label_counts(spark, d):
    """Streaming running class counts per run and round; final state equals the batch counts."""
    schema = T.read(spark, d, "lineitem").schema
    sink, ckpt = shared_path(spark, "stream-counts"), shared_path(spark, "stream-counts-ckpt")
    keys = ["run", "labelling_round", "labels"]
    SM.stream_counts(spark, f"{d}/lineitem*.parquet", schema, keys, sink, ckpt, prepare=_label_log_rows)
    return SM.read_counts(spark, sink, keys)


WINDOW = "1 day"

def _timer_rows(r):
    return r.filter(F.col("event_type") == "error").withColumn("ts", F.col("ts").cast("timestamp"))


DELAY = "1 hour"


@register("stream_timer_window", """WITH e AS (SELECT * FROM events WHERE event_type = 'error'),
w AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, round(sum(value), 6) AS total, count(*) AS n
      FROM e GROUP BY 1)
SELECT CAST(window_start AS VARCHAR) AS window_start, CAST(window_start + INTERVAL 1 DAY AS VARCHAR) AS window_end,
  total, n FROM w
WHERE window_start + INTERVAL 1 DAY <= (SELECT max(ts) FROM events WHERE event_type = 'error') - INTERVAL 1 HOUR""")
def q_stream_timer_window(spark, d):
    """Daily windows of timer values with a one-hour watermark; only closed windows are emitted."""
    schema = T.read(spark, d, "events").schema
    sink, ckpt = shared_path(spark, "stream-win"), shared_path(spark, "stream-win-ckpt")
    SM.stream_windowed_sums(spark, f"{d}/events*.parquet", schema, "ts", "value", WINDOW, DELAY, sink, ckpt,
                            prepare=_timer_rows)
    out = spark.read.parquet(sink)
    return out.select(F.col("window_start").cast("string").alias("window_start"),
                      F.col("window_end").cast("string").alias("window_end"), r6("total").alias("total"), "n")


# ------------------------------------------------- ANN, embedding, loop --

@register("ivf_knn")
def q_ivf_knn(spark, d):
    """Approximate kNN: anchors probe 3 of 8 k-means cells of the pool."""
    lab = T.labelled(spark, d)
    pool = T.pool(spark, d, lab)
    path = write_ivf(*build_ivf(pool, n_cells=8, seed=42), shared_path(spark, "ivf"))
    cells, centers, meta = load_ivf(spark, path)
    anchors = anchors_random(lab, 5, seed=43)
    cands = ivf_knn(anchors, cells, centers, k=20, n_probe=3, meta=meta)
    return cands.select("search_query_uid", "uid", r6("dists").alias("dists"))


SQL_ANCHOR_KNN = f"""WITH {SQL_LABELLED_CTES},
anchors AS ({T.sql_top_n("labelled", "5", 43, by="label")}),
pairs AS (SELECT a.uid AS search_query_uid, p.uid AS uid, {T.sql_cos_dist("a.embedding", "p.embedding")} AS dists
          FROM anchors a CROSS JOIN pool p)
SELECT search_query_uid, uid, round(dists, 6) AS dists FROM (SELECT *, row_number() OVER (
  PARTITION BY search_query_uid ORDER BY dists, uid) AS rn FROM pairs) WHERE rn <= 20"""


def _anchors_and_labelled(spark, d):
    lab = T.labelled(spark, d)
    return anchors_random(lab, 5, seed=43), lab


@register("ivf_filtered", SQL_ANCHOR_KNN)
def q_ivf_filtered(spark, d):
    """Cells of all rows, labelled rows masked; every anchor probes cells in bound order until its 20
    nearest allowed rows are certain."""
    anchors, lab = _anchors_and_labelled(spark, d)
    index = CellIndex.create(T.embeddings(spark, d), shared_path(spark, "cells"), n_cells=16)
    found = index.search(anchors, 20, mask=lab)
    return found.select("search_query_uid", "uid", r6("dists").alias("dists"))


@register("ivf_recall", f"""WITH {SQL_LABELLED_CTES},
n AS (SELECT least(20, (SELECT count(*) FROM pool)) AS k, (SELECT count(*) FROM ({T.sql_top_n("labelled", "5", 43, by="label")})) AS q)
SELECT q AS n_queries, CAST(q * k AS BIGINT) AS n_rows, TRUE AS recall_reached FROM n""")
def q_ivf_recall(spark, d):
    """Approximate search with as many probes as a sample of rows needs for a recall of 0.9: rows found, and
    whether their share of the exact neighbours of all anchors is 0.9 or more."""
    anchors, lab = _anchors_and_labelled(spark, d)
    index = CellIndex.create(T.embeddings(spark, d), shared_path(spark, "cells"), n_cells=16)
    found = index.search(anchors, 20, mask=lab, n_probe=index.probes_for(0.93, 20))
    recall = recall_at_k(found, knn_join(anchors, T.pool(spark, d, lab), 20))
    size = found.agg(F.count_distinct("search_query_uid").alias("n_queries"), F.count(F.lit(1)).alias("n_rows"))
    # one row on either side
    both = size.withColumn("one", F.lit(1)).join(recall.withColumn("one", F.lit(1)), "one")
    return both.select("n_queries", "n_rows", (F.col("recall") >= 0.9).alias("recall_reached"))


@register("ivf_upkeep", SQL_ANCHOR_KNN)
def q_ivf_upkeep(spark, d):
    """Cells of the first classes, the other classes appended, large cells split, labelled rows deleted: the
    anchors' nearest rows are those of the pool."""
    anchors, lab = _anchors_and_labelled(spark, d)
    rows = T.embeddings(spark, d)
    index = CellIndex.create(rows.filter("label < 5"), shared_path(spark, "cells"), n_cells=8)
    index = index.append(rows.filter("label >= 5"))
    mean = sum(r["n"] for r in index.cells.values()) // max(1, len(index.cells))
    found = index.split(mean).delete(lab).search(anchors, 20)
    return found.select("search_query_uid", "uid", r6("dists").alias("dists"))


@register("hash_embed", """WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text),
    '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS t FROM documents),
b AS (SELECT doc_id, ('0x' || substr(md5(t), 1, 8))::BIGINT % 64 AS k, count(*) AS n FROM w GROUP BY ALL),
l AS (SELECT doc_id, sqrt(sum(n * n)) AS len FROM b GROUP BY doc_id),
g AS (SELECT d.doc_id, k FROM documents d, range(64) r(k))
SELECT g.doc_id, list(round(coalesce(b.n / l.len, 0.0), 6) ORDER BY g.k) AS embedding
FROM g LEFT JOIN b USING (doc_id, k) LEFT JOIN l USING (doc_id) GROUP BY g.doc_id""")
def q_hash_embed(spark, d):
    """Hashed bag-of-words vectors of the whole texts."""
    docs = T.read(spark, d, "documents").select("doc_id", "text")
    vectors = hash_embed(docs, "text", dim=64, id_col="doc_id")
    return vectors.select("doc_id", F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"))


ROUND_BATCH = 50
ROUND_BUDGET = 400
ROUND_CONFIG = dict(subpool_size=120, num_neighbours=20, num_anchors=5, anchor_strategy_minority="random",
                    anchor_strategy_majority="random", minority_classes=list(T.MINORITY), seed=42)


def _sql_rounds() -> str:
    """CTE chain of the loop: per round the model of the labelled rows, anchors, neighbours, subpool and batch."""
    c = ROUND_CONFIG
    ctes = ["l0 AS MATERIALIZED (SELECT uid, label, embedding, -1 AS labelling_round FROM labelled)"]
    for r in range(-(-(ROUND_BUDGET - T.TOTAL_BUDGET) // ROUND_BATCH)):
        lab = f"l{r}"
        ctes += [
            f"q{r} AS MATERIALIZED (SELECT * FROM emb WHERE uid NOT IN (SELECT uid FROM {lab}))",
            f"an{r} AS ({T.sql_top_n(lab, str(c['num_anchors']), c['seed'], by='label')})",
            f"pa{r} AS (SELECT a.uid AS a, p.uid, {T.sql_cos_dist('a.embedding', 'p.embedding')} AS dists FROM an{r} a CROSS JOIN q{r} p)",
            f"ca{r} AS (SELECT uid, dists FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY dists, uid) AS rn FROM pa{r}) "
            f"WHERE rn <= {c['num_neighbours']})",
            f"su{r} AS MATERIALIZED (SELECT uid FROM ca{r} GROUP BY uid ORDER BY 1.0 - avg(dists) DESC, uid LIMIT {c['subpool_size']})",
            f"sc{r} AS MATERIALIZED (SELECT uid, label, embedding, {sql_logits('embedding', lab)} AS logits FROM q{r} WHERE uid IN (SELECT uid FROM su{r}))",
            f"l{r + 1} AS MATERIALIZED (SELECT * FROM {lab} UNION ALL (SELECT uid, label, embedding, {r} FROM sc{r} "
            f"ORDER BY {sql_entropy()} DESC, uid LIMIT {ROUND_BATCH}))"]
    return ",\n".join(ctes) + f",\nlog AS MATERIALIZED (SELECT * FROM l{r + 1})"


def _rounds(spark, d):
    base = T.embeddings(spark, d)
    return run_rounds(base, T.labelled(spark, d), "anchored_entropy", ROUND_BUDGET, ROUND_BATCH, shared_path(spark, "rounds"),
                      ST.TwoStageConfig(**ROUND_CONFIG), mean_scorer(T.NUM_CLASSES, T.LOGIT_SCALE))


@register("active_rounds", f"""WITH {SQL_LABELLED_CTES},
{_sql_rounds()}
SELECT uid, CAST(labelling_round AS INTEGER) AS labelling_round FROM log""")
def q_active_rounds(spark, d):
    """Rounds of anchored entropy selection up to a budget, the model refitted each round, every round
    committed to the shared folder; the label log."""
    return _rounds(spark, d).select("uid", "labelling_round")


@register("active_rounds_log", f"""WITH {SQL_LABELLED_CTES},
{_sql_rounds()},
g AS (SELECT r.labelling_round, c.class_id FROM (SELECT DISTINCT labelling_round FROM log) r,
  (SELECT CAST(range AS INTEGER) AS class_id FROM range({T.NUM_CLASSES})) c),
n AS (SELECT labelling_round, label AS class_id, count(*) AS n FROM log GROUP BY ALL),
f AS (SELECT labelling_round, class_id, coalesce(n, 0) AS n FROM g LEFT JOIN n USING (labelling_round, class_id)),
u AS (SELECT *, sum(n) OVER (PARTITION BY class_id ORDER BY labelling_round) AS up FROM f)
SELECT CAST(labelling_round AS INTEGER) AS labelling_round, class_id, CAST(n AS BIGINT) AS count, CAST(up AS BIGINT) AS cumulative_count,
  CAST(sum(up) OVER (PARTITION BY labelling_round) AS BIGINT) AS labelled_size,
  CAST((SELECT count(*) FROM emb) - sum(up) OVER (PARTITION BY labelling_round) AS BIGINT) AS pool_size FROM u""")
def q_active_rounds_log(spark, d):
    """The loop's log: per round the labels of each class (zero for absent ones), labelled and pool size."""
    return round_log(_rounds(spark, d), T.embeddings(spark, d).count(), T.NUM_CLASSES)
