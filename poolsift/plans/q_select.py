"""Registered queries: sampling, labels, similarity, anchors, strategies.

Each ``q_<key>(spark, sf_dir)`` returns a DataFrame; ``ORACLE[key]`` is the
same result in DuckDB SQL over the supplied tables.  Doubles are rounded to
6 places on both sides.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import sql_gumbel, sql_order_key
from ..functions.vectors import cosine_distance
from ..operators import anchors as A
from ..operators import neighbours as NB
from ..operators import sampling as S
from ..operators import strategies as ST
from ..operators.similarity import knn_join, search_stats
from ..session import cut_lineage
from . import tables as T
from .tables import SQL_EMB, SQL_LABELLED_CTES, sql_cos_dist, sql_entropy, sql_logits, sql_top_n

QUERIES: dict = {}
ORACLE: dict = {}

ANCHOR_SEED = 43
NUM_ANCHORS = 5
K = 20
SUBPOOL = 120
BATCH = 25


def register(key, sql=None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return deco


def r6(c):
    return F.round(c, 6)


# --------------------------------------------------------- minimum slice --

def _slice_candidates(spark, d):
    lab = T.labelled(spark, d)
    pool = T.pool(spark, d, lab)
    anchors = A.anchors_random(lab, NUM_ANCHORS, seed=ANCHOR_SEED)
    return lab, pool, knn_join(anchors, pool, k=K)


SQL_SLICE_CTES = SQL_LABELLED_CTES + f""",
anchors AS ({sql_top_n("labelled", str(NUM_ANCHORS), ANCHOR_SEED, by="label")}),
pairs AS (SELECT a.uid AS search_query_uid, p.uid AS uid, {sql_cos_dist("a.embedding", "p.embedding")} AS dists
          FROM anchors a CROSS JOIN pool p),
cands AS (SELECT search_query_uid, uid, dists FROM (SELECT *, row_number() OVER (
          PARTITION BY search_query_uid ORDER BY dists, uid) AS rn FROM pairs) WHERE rn <= {K}),
sub AS (SELECT uid, 1.0 - avg(dists) AS scores FROM cands GROUP BY uid ORDER BY scores DESC, uid LIMIT {SUBPOOL})"""


def anchored_entropy_slice(spark, d):
    """Labelled set -> random anchors per class -> exact kNN -> anchor subpool -> entropy batch."""
    _, pool, cands = _slice_candidates(spark, d)
    sub = ST.anchor_subpool(cands, SUBPOOL)
    scored = T.with_logits(spark, d, pool.join(sub.select("uid"), "uid", "left_semi"))
    picked = ST.entropy_query(scored, BATCH)
    return picked.select("uid", r6("entropy").alias("entropy"))


SQL_ANCHORED_ENTROPY = f"""WITH {SQL_SLICE_CTES},
scored AS (SELECT uid, {sql_logits()} AS logits FROM pool WHERE uid IN (SELECT uid FROM sub))
SELECT uid, round({sql_entropy()}, 6) AS entropy FROM scored
ORDER BY {sql_entropy()} DESC, uid LIMIT {BATCH}"""

register("anchored_entropy", SQL_ANCHORED_ENTROPY)(anchored_entropy_slice)


@register("knn_join", f"""WITH {SQL_SLICE_CTES}
SELECT search_query_uid, uid, round(dists, 6) AS dists FROM cands""")
def q_knn_join(spark, d):
    _, _, cands = _slice_candidates(spark, d)
    return cands.select("search_query_uid", "uid", r6("dists").alias("dists"))


@register("anchor_subpool", f"""WITH {SQL_SLICE_CTES}
SELECT uid, round(scores, 6) AS scores FROM sub""")
def q_anchor_subpool(spark, d):
    _, _, cands = _slice_candidates(spark, d)
    return ST.anchor_subpool(cands, SUBPOOL).select("uid", r6("scores").alias("scores"))


@register("search_stats", f"""WITH {SQL_SLICE_CTES}
SELECT count(*) AS ids_retrieved, count(DISTINCT uid) AS unique_ids_retrieved,
       count(DISTINCT search_query_uid) AS num_search_queries FROM cands""")
def q_search_stats(spark, d):
    _, _, cands = _slice_candidates(spark, d)
    return search_stats(cands)


GUMBEL_SEED = 44


@register("gumbel_subpool", f"""WITH {SQL_SLICE_CTES.replace(f"ORDER BY scores DESC, uid LIMIT {SUBPOOL}", "")},
g AS (SELECT uid, scores, scores + {sql_gumbel(GUMBEL_SEED)} AS key FROM sub)
SELECT uid, round(scores, 6) AS scores FROM g ORDER BY key DESC, uid LIMIT {SUBPOOL // 2}""")
def q_gumbel_subpool(spark, d):
    _, _, cands = _slice_candidates(spark, d)
    return ST.anchor_subpool_sampled(cands, SUBPOOL // 2, seed=GUMBEL_SEED) \
        .select("uid", r6("scores").alias("scores"))


@register("anchoredsampling_entropy", f"""WITH {SQL_SLICE_CTES.replace(f"ORDER BY scores DESC, uid LIMIT {SUBPOOL}", "")},
g AS (SELECT uid FROM sub ORDER BY scores + {sql_gumbel(GUMBEL_SEED)} DESC, uid LIMIT {SUBPOOL}),
scored AS (SELECT uid, {sql_logits()} AS logits FROM pool WHERE uid IN (SELECT uid FROM g))
SELECT uid, round({sql_entropy()}, 6) AS entropy FROM scored ORDER BY {sql_entropy()} DESC, uid LIMIT {BATCH}""")
def q_anchoredsampling_entropy(spark, d):
    _, pool, cands = _slice_candidates(spark, d)
    sub = ST.anchor_subpool_sampled(cands, SUBPOOL, seed=GUMBEL_SEED)
    scored = T.with_logits(spark, d, pool.join(sub.select("uid"), "uid", "left_semi"))
    return ST.entropy_query(scored, BATCH).select("uid", r6("entropy").alias("entropy"))


@register("softmax_scores", f"""WITH {SQL_SLICE_CTES.replace(f"ORDER BY scores DESC, uid LIMIT {SUBPOOL}", "")},
m AS (SELECT max(scores) AS mx FROM sub),
z AS (SELECT sum(exp(scores - (SELECT mx FROM m))) AS zz FROM sub)
SELECT uid, round(exp(scores - (SELECT mx FROM m)) / (SELECT zz FROM z), 6) AS prob FROM sub""")
def q_softmax_scores(spark, d):
    _, _, cands = _slice_candidates(spark, d)
    scores = cands.groupBy("uid").agg((F.lit(1.0) - F.avg("dists")).alias("scores"))
    return S.softmax_column(scores, "scores", "prob").select("uid", r6("prob").alias("prob"))


# ------------------------------------------------------------- anchors --

def _sql_sqdist(a: str, b: str) -> str:
    return f"list_sum(list_transform({a}, lambda x, i: (x - {b}[i]) * (x - {b}[i])))"


def sql_kmeanspp(base: str, k: int, seed, by: str | None, vec_cols: list[str], sqdist_sql) -> str:
    """CTE chain reproducing ``kmeanspp_pick``: one pick CTE and one state CTE per step.

    ``base`` is a CTE with ``uid``, the vector columns and optionally ``by``.
    Returns CTE text ending in ``kpp_final(uid, pick_step[, by])``.
    """
    cols = ", ".join(vec_cols)
    byc = f"{by}, " if by else ""
    ctes = [f"kpp_s0 AS MATERIALIZED (SELECT {byc}uid, {cols}, CAST(NULL AS DOUBLE) AS d2, CAST(NULL AS INTEGER) AS pick_step "
            f"FROM {base})"]
    for s in range(k):
        g = sql_gumbel(f"{seed}:{s}")
        key = f"CASE WHEN d2 IS NULL THEN {g} WHEN d2 > 0 THEN ln(d2) + {g} ELSE {g} - 1e6 END"
        grp = f"GROUP BY {by}" if by else ""
        ctes.append(f"kpp_p{s} AS MATERIALIZED (SELECT {byc}arg_max(uid, {key}) AS pu FROM kpp_s{s} "
                    f"WHERE pick_step IS NULL {grp})")
        pv = ", ".join(f"c.{c} AS pc_{c}" for c in vec_cols)
        on = f"p.{by} = c.{by} AND " if by else ""
        ctes.append(f"kpp_c{s} AS (SELECT {'p.' + by + ', ' if by else ''}p.pu, {pv} FROM kpp_p{s} p "
                    f"JOIN kpp_s{s} c ON {on}c.uid = p.pu)")
        dn = sqdist_sql({c: f"s.{c}" for c in vec_cols}, {c: f"c.pc_{c}" for c in vec_cols})
        jon = f"ON s.{by} = c.{by}" if by else "ON TRUE"
        ctes.append(
            f"kpp_s{s + 1} AS MATERIALIZED (SELECT {'s.' + by + ', ' if by else ''}s.uid, "
            + ", ".join(f"s.{c}" for c in vec_cols)
            + f", CASE WHEN c.pu IS NULL THEN s.d2 ELSE least(coalesce(s.d2, {dn}), {dn}) END AS d2, "
            f"CASE WHEN s.pick_step IS NULL AND s.uid = c.pu THEN {s} ELSE s.pick_step END AS pick_step "
            f"FROM kpp_s{s} s LEFT JOIN kpp_c{s} c {jon})")
    ctes.append(f"kpp_final AS (SELECT {byc}uid, pick_step FROM kpp_s{k} WHERE pick_step IS NOT NULL)")
    return ",\n".join(ctes)


def _euclid(row, ctr):
    (c,) = row.keys()
    return _sql_sqdist(row[c], ctr[c])


def sql_lloyd(base: str, k: int, seed, iterations: int, by: str | None = None, name: str = "km") -> str:
    """CTE chain of ``kmeans_rows`` over ``base(uid, embedding[, by])``, ending in ``<name>_rows([by, ]uid)``.

    Iterations beyond the point where no centre moves change nothing.
    """
    g, on = (f"{by}, ", f"r.{by} = c.{by}") if by else ("", "TRUE")
    part, same = (f"PARTITION BY {by} ", f"USING ({by}, cluster)") if by else ("", "USING (cluster)")
    far = (f"f.{by} = k.{by} AND ") if by else ""
    kg = f"k.{by}, " if by else ""
    ctes = [f"{name}_c0 AS MATERIALIZED (SELECT {g}cluster, embedding AS c FROM (SELECT {g}embedding, row_number() OVER ({part}ORDER BY "
            f"{sql_order_key(seed)}, uid) - 1 AS cluster FROM {base}) WHERE cluster < {k})"]
    for t in range(iterations + 1):
        rg = f"r.{by}, " if by else ""
        ctes.append(f"{name}_a{t} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY d2, cluster) AS rn FROM ("
                    f"SELECT {rg}r.uid, r.embedding, c.cluster, {_sql_sqdist('r.embedding', 'c.c')} AS d2 "
                    f"FROM {base} r JOIN {name}_c{t} c ON {on})) WHERE rn = 1)")
        if t == iterations:
            break
        ctes.append(f"{name}_m{t} AS MATERIALIZED (SELECT {g}cluster, list(a ORDER BY pos) AS m FROM (SELECT {g}cluster, pos, avg(v) AS a FROM ("
                    f"SELECT {g}cluster, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM {name}_a{t}) "
                    f"GROUP BY {g}cluster, pos) GROUP BY {g}cluster)")
        ctes.append(f"{name}_e{t} AS MATERIALIZED (SELECT {g}cluster, row_number() OVER ({part}ORDER BY cluster) AS place FROM {name}_c{t} "
                    f"ANTI JOIN {name}_m{t} {same})")
        ctes.append(f"{name}_f{t} AS MATERIALIZED (SELECT {g}embedding AS v, row_number() OVER ({part}ORDER BY d2 DESC, uid) AS place "
                    f"FROM {name}_a{t} WHERE d2 > 0)")
        ctes.append(f"{name}_c{t + 1} AS MATERIALIZED (SELECT {kg}k.cluster, coalesce(m.m, f.v, k.c) AS c FROM {name}_c{t} k "
                    f"LEFT JOIN {name}_m{t} m {same} LEFT JOIN {name}_e{t} e {same} LEFT JOIN {name}_f{t} f ON {far}f.place = e.place)")
    ctes.append(f"{name}_b AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY {g}cluster ORDER BY d2, uid) = 1 THEN 0 ELSE 1 END AS later "
                f"FROM {name}_a{iterations})")
    ctes.append(f"{name}_rows AS (SELECT {g}uid FROM (SELECT {g}uid, row_number() OVER ({part}ORDER BY later, d2, uid) AS place FROM {name}_b) "
                f"WHERE place <= {k})")
    return ",\n".join(ctes)


KPP_SEED = 46
KM_SEED = 42
KM_ITERATIONS = 5


@register("anchors_random", f"""WITH {SQL_LABELLED_CTES}
SELECT uid, label FROM ({sql_top_n("labelled", str(NUM_ANCHORS), ANCHOR_SEED, by="label")})""")
def q_anchors_random(spark, d):
    return A.anchors_random(T.labelled(spark, d), NUM_ANCHORS, seed=ANCHOR_SEED).select("uid", "label")


@register("anchors_entropy", f"""WITH {SQL_LABELLED_CTES},
s AS (SELECT uid, label, {sql_logits()} AS logits FROM labelled),
r AS (SELECT uid, label, row_number() OVER (PARTITION BY label ORDER BY {sql_entropy()} DESC, uid) AS rn FROM s)
SELECT uid, label FROM r WHERE rn <= {NUM_ANCHORS}""")
def q_anchors_entropy(spark, d):
    lab = T.with_logits(spark, d, T.labelled(spark, d))
    return A.anchors_entropy(lab, NUM_ANCHORS).select("uid", "label")


@register("anchors_kmeanspp", f"""WITH kbase AS MATERIALIZED ({SQL_EMB}),
{sql_kmeanspp("kbase", NUM_ANCHORS, KPP_SEED, "label", ["embedding"], _euclid)}
SELECT uid, label FROM kpp_final""")
def q_anchors_kmeanspp(spark, d):
    """k-means++ anchors of every class; the whole table is the labelled set."""
    return A.anchors_kmeanspp(T.embeddings(spark, d), NUM_ANCHORS, seed=KPP_SEED).select("uid", "label")


@register("kmeanspp_pick", f"""WITH {SQL_LABELLED_CTES},
kbase AS MATERIALIZED (SELECT uid, embedding FROM pool),
{sql_kmeanspp("kbase", 12, KPP_SEED, None, ["embedding"], _euclid)}
SELECT uid, pick_step FROM kpp_final""")
def q_kmeanspp_pick(spark, d):
    """k-means++ over the whole pool."""
    base = T.pool(spark, d).select("uid", F.col("embedding").alias("vec"))
    return A.kmeanspp_pick(base, 12, seed=KPP_SEED).select("uid", "pick_step")


@register("anchors_all", f"""WITH {SQL_LABELLED_CTES}
SELECT uid, label FROM labelled""")
def q_anchors_all(spark, d):
    return A.anchors_all(T.labelled(spark, d)).select("uid", "label")


SEL_ANCHORS = 10


@register("anchor_select", f"""WITH {SQL_LABELLED_CTES},
sz AS (SELECT label, count(*) AS n FROM labelled GROUP BY label),
small AS (SELECT l.uid, l.label FROM labelled l JOIN sz USING (label) WHERE sz.n < {SEL_ANCHORS}),
big AS (SELECT l.* FROM labelled l JOIN sz USING (label) WHERE sz.n >= {SEL_ANCHORS}),
minr AS ({sql_top_n("(SELECT * FROM big WHERE label IN (0))", str(SEL_ANCHORS), ANCHOR_SEED, by="label")}),
s AS (SELECT uid, label, {sql_logits()} AS logits FROM big WHERE label NOT IN (0)),
maj AS (SELECT uid, label FROM (SELECT uid, label, row_number() OVER (PARTITION BY label
        ORDER BY {sql_entropy()} DESC, uid) AS rn FROM s) WHERE rn <= {SEL_ANCHORS})
SELECT uid, label FROM small UNION ALL SELECT uid, label FROM minr UNION ALL SELECT uid, label FROM maj""")
def q_anchor_select(spark, d):
    """Whole small classes; random anchors for minority class 0, entropy anchors otherwise."""
    lab = T.with_logits(spark, d, T.labelled(spark, d))
    return A.select_anchors(lab, SEL_ANCHORS, "random", "entropy", T.MINORITY, seed=ANCHOR_SEED) \
        .select("uid", "label")


@register("anchors_kmeans", f"""WITH kbase AS MATERIALIZED ({SQL_EMB}),
{sql_lloyd("kbase", NUM_ANCHORS, KM_SEED, KM_ITERATIONS, "label")}
SELECT uid, label FROM km_rows""")
def q_anchors_kmeans(spark, d):
    """k-means anchors of every class in one run; the whole table is the labelled set."""
    return A.anchors_kmeans(T.embeddings(spark, d), NUM_ANCHORS, seed=KM_SEED, max_iter=KM_ITERATIONS).select("uid", "label")


# ------------------------------------------------------------ strategies --

@register("entropy_query", f"""WITH {SQL_LABELLED_CTES},
s AS (SELECT uid, {sql_logits()} AS logits FROM pool)
SELECT uid, round({sql_entropy()}, 6) AS entropy FROM s ORDER BY {sql_entropy()} DESC, uid LIMIT {BATCH}""")
def q_entropy_query(spark, d):
    return ST.entropy_query(T.with_logits(spark, d, T.pool(spark, d)), BATCH).select("uid", r6("entropy").alias("entropy"))


def _sql_badge_factors(src: str) -> str:
    am = "(list_position(logits, list_max(logits)) - 1)"
    mx = "list_max(logits)"
    z = f"list_sum(list_transform(logits, lambda x: exp(x - {mx})))"
    g = f"list_transform(logits, lambda x, i: exp(x - {mx}) / {z} - CASE WHEN i - 1 = {am} THEN 1.0 ELSE 0.0 END)"
    return f"SELECT uid, {g} AS g, embedding AS h FROM (SELECT uid, embedding, {sql_logits()} AS logits FROM {src})"


def _sql_dot(a: str, b: str) -> str:
    return f"list_sum(list_transform({a}, lambda x, i: x * {b}[i]))"


def _badge_sql_dist(row, ctr):
    g, h, gc, hc = row["g"], row["h"], ctr["g"], ctr["h"]
    return (f"greatest({_sql_dot(g, g)} * {_sql_dot(h, h)} + {_sql_dot(gc, gc)} * {_sql_dot(hc, hc)} "
            f"- 2.0 * {_sql_dot(g, gc)} * {_sql_dot(h, hc)}, 0.0)")


@register("badge_gradient", f"""WITH {SQL_LABELLED_CTES},
f AS ({_sql_badge_factors("pool")})
SELECT uid, round(sqrt({_sql_dot("g", "g")} * {_sql_dot("h", "h")}), 6) AS grad_norm FROM f""")
def q_badge_gradient(spark, d):
    g = ST.badge_gradient_norm(T.with_logits(spark, d, T.pool(spark, d)))
    return g.select("uid", r6("grad_norm").alias("grad_norm"))


BADGE_Q = 10


@register("badge_query", f"""WITH {SQL_LABELLED_CTES},
f AS MATERIALIZED ({_sql_badge_factors("pool")}),
{sql_kmeanspp("f", BADGE_Q, KPP_SEED, None, ["g", "h"], _badge_sql_dist)}
SELECT uid FROM kpp_final""")
def q_badge_query(spark, d):
    """BADGE on the whole pool: k-means++ over gradient embeddings (as factors)."""
    return ST.badge_query(T.with_logits(spark, d, T.pool(spark, d)), BADGE_Q, seed=KPP_SEED).select("uid")


@register("kmeans_query", f"""WITH {SQL_LABELLED_CTES},
kbase AS MATERIALIZED (SELECT uid, embedding FROM pool),
{sql_lloyd("kbase", BATCH, KM_SEED, KM_ITERATIONS)}
SELECT uid FROM km_rows""")
def q_kmeans_query(spark, d):
    """k-means pick (rows nearest q centres) on the whole pool."""
    return ST.kmeans_query(T.pool(spark, d), BATCH, seed=KM_SEED, max_iter=KM_ITERATIONS).select("uid")


@register("tyrogue_query", f"""WITH {SQL_LABELLED_CTES},
kbase AS MATERIALIZED (SELECT uid, embedding FROM pool),
{sql_lloyd("kbase", 3 * (BATCH // 5), KM_SEED, KM_ITERATIONS)},
s AS (SELECT uid, {sql_logits()} AS logits FROM pool WHERE uid IN (SELECT uid FROM km_rows))
SELECT uid, round({sql_entropy()}, 6) AS entropy FROM s ORDER BY {sql_entropy()} DESC, uid LIMIT {BATCH // 5}""")
def q_tyrogue_query(spark, d):
    """Diversity pick by k-means on the whole pool, then the most uncertain of it."""
    pool = T.with_logits(spark, d, T.pool(spark, d))
    return ST.tyrogue_query(pool, BATCH // 5, seed=KM_SEED, max_iter=KM_ITERATIONS).select("uid", r6("entropy").alias("entropy"))


SEALS_K = 5
SEALS_SIZE = 150

SQL_SEALS_CTES = SQL_LABELLED_CTES + f""",
spairs AS (SELECT a.uid AS search_query_uid, p.uid AS uid, {sql_cos_dist("a.embedding", "p.embedding")} AS dists
          FROM labelled a CROSS JOIN pool p),
scands AS (SELECT search_query_uid, uid FROM (SELECT *, row_number() OVER (
          PARTITION BY search_query_uid ORDER BY dists, uid) AS rn FROM spairs) WHERE rn <= {SEALS_K}),
sids AS (SELECT DISTINCT uid FROM scands),
ssub AS ({sql_top_n("sids", str(SEALS_SIZE), 42)})"""


@register("seals_subpool", f"""WITH {SQL_SEALS_CTES}
SELECT uid FROM ssub""")
def q_seals_subpool(spark, d):
    lab = T.labelled(spark, d)
    return ST.seals_subpool(lab, T.pool(spark, d, lab), SEALS_K, SEALS_SIZE, seed=42).select("uid")


@register("seals_entropy", f"""WITH {SQL_SEALS_CTES},
s AS (SELECT uid, {sql_logits()} AS logits FROM pool WHERE uid IN (SELECT uid FROM ssub))
SELECT uid, round({sql_entropy()}, 6) AS entropy FROM s ORDER BY {sql_entropy()} DESC, uid LIMIT {BATCH}""")
def q_seals_entropy(spark, d):
    lab = T.labelled(spark, d)
    pool = T.pool(spark, d, lab)
    sub = ST.seals_subpool(lab, pool, SEALS_K, SEALS_SIZE, seed=42)
    scored = T.with_logits(spark, d, pool.join(sub, "uid", "left_semi"))
    return ST.entropy_query(scored, BATCH).select("uid", r6("entropy").alias("entropy"))


@register("randomsubset_entropy", f"""WITH {SQL_LABELLED_CTES},
sub AS ({sql_top_n("pool", str(SUBPOOL), "42:0")}),
s AS (SELECT uid, {sql_logits()} AS logits FROM sub)
SELECT uid, round({sql_entropy()}, 6) AS entropy FROM s ORDER BY {sql_entropy()} DESC, uid LIMIT {BATCH}""")
def q_randomsubset_entropy(spark, d):
    pool = T.pool(spark, d)
    sub = S.random_subset(pool, SUBPOOL, seed=42, round_=0)
    return ST.entropy_query(T.with_logits(spark, d, sub), BATCH).select("uid", r6("entropy").alias("entropy"))


LIST_K = 10
LIST_ROUNDS = 3


def _sql_rounds_of_labels() -> str:
    ctes = ["g0 AS (SELECT uid, embedding FROM labelled)"]
    for r in range(LIST_ROUNDS):
        ctes.append(f"r{r} AS MATERIALIZED (SELECT uid, embedding FROM emb WHERE uid NOT IN (SELECT uid FROM g{r}))")
        ctes.append(f"g{r + 1} AS MATERIALIZED (SELECT * FROM g{r} UNION ALL SELECT uid, embedding FROM ({sql_top_n(f'r{r}', str(BATCH), f'42:{r}')}))")
    return ",\n".join(ctes)


@register("neighbour_lists", f"""WITH {SQL_LABELLED_CTES},
{_sql_rounds_of_labels()},
npairs AS (SELECT a.uid AS search_query_uid, p.uid AS uid, {sql_cos_dist("a.embedding", "p.embedding")} AS dists
           FROM g{LIST_ROUNDS} a CROSS JOIN (SELECT * FROM emb WHERE uid NOT IN (SELECT uid FROM g{LIST_ROUNDS})) p)
SELECT search_query_uid, uid, round(dists, 6) AS dists FROM (SELECT *, row_number() OVER (
  PARTITION BY search_query_uid ORDER BY dists, uid) AS rn FROM npairs) WHERE rn <= {LIST_K}""")
def q_neighbour_lists(spark, d):
    """The nearest pool rows of every labelled row after rounds of random labels, kept up round by round."""
    base, lab = T.embeddings(spark, d).select("uid", "embedding"), T.labelled(spark, d).select("uid", "embedding")
    pool = base.join(lab.select("uid"), "uid", "left_anti")
    lists = NB.start_lists(lab, pool, LIST_K)
    for r in range(LIST_ROUNDS):
        new = cut_lineage(S.random_query(pool, BATCH, seed=f"42:{r}").select("uid", "embedding"))
        now = cut_lineage(lab.unionByName(new))
        pool = base.join(now.select("uid"), "uid", "left_anti")        # one join of the base table, whatever the round
        lists, lab = NB.advance_lists(lists, lab, new, pool, LIST_K), now
    return NB.nearest(lists, LIST_K).select("search_query_uid", "uid", r6("dists").alias("dists"))


@register("cosine_distance", f"""WITH e AS ({SQL_EMB}),
x AS (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM e),
c AS (SELECT label, list(m ORDER BY pos) AS centroid FROM (SELECT label, pos, avg(v) AS m FROM x GROUP BY label, pos)
      GROUP BY label)
SELECT e.uid, round({sql_cos_dist("e.embedding", "c.centroid")}, 6) AS dist_to_centroid
FROM e JOIN c USING (label)""")
def q_cosine_distance(spark, d):
    """Cosine distance of every embedding to its class centroid (centroids: one partial aggregate)."""
    e = T.embeddings(spark, d)
    x = e.select("label", F.posexplode("embedding").alias("pos", "v"))
    cent = (x.groupBy("label", "pos").agg(F.avg("v").alias("m"))
             .groupBy("label").agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("pm"))
             .select("label", F.transform("pm", lambda s: s["m"]).alias("centroid")))
    return e.join(cent, "label").select("uid", r6(cosine_distance("embedding", "centroid")).alias("dist_to_centroid"))


@register("registry_smoke")
def q_registry_smoke(spark, d):
    """Every registered strategy name run through the registry: the rows that each picks."""
    lab = T.with_logits(spark, d, T.labelled(spark, d))
    pool = T.with_logits(spark, d, T.pool(spark, d, lab))
    cfg = ST.TwoStageConfig(subpool_size=SUBPOOL, num_neighbours=K, num_anchors=NUM_ANCHORS,
                            anchor_strategy_minority="random", anchor_strategy_majority="random",
                            minority_classes=list(T.MINORITY), seed=42)
    from functools import reduce
    subpools: dict = {}
    picks = [ST.run_strategy(name, pool, lab, 5, cfg, round_=0, subpools=subpools).select(F.lit(name).alias("strategy"), F.col("uid").cast("long").alias("uid"))
             for name in ST.STRATEGY_NAMES]
    return reduce(lambda a, b: a.unionByName(b), picks)
