"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import shared_path
from . import (language, line_dedup, minhash, mixing, negatives, packing, quality, repair, sharding, suffixes, topk, url_rules,
               whitening)
from .common import table

QUERIES: dict = {}
ORACLE: dict = {}


def register(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return wrap


_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in url_rules.RULES)


@register("op4_url_filters", rf"""WITH u AS (
  SELECT row_number() OVER () AS rn, page_id,
    coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'),
             '{url_rules.UPPER}', '{url_rules.LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path FROM pages),
r(h, p, v) AS (VALUES {_RULE_ROWS}),
m AS (SELECT rn, h || p AS rule, v, row_number() OVER (PARTITION BY rn ORDER BY length(h || p) DESC, length(h) DESC) AS k
  FROM u JOIN r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM u LEFT JOIN (SELECT * FROM m WHERE k = 1) USING (rn)""")
def q_url_filters(spark, d):
    return url_rules.judge_urls(table(spark, d, "pages"), url_rules.default_rules(spark))


@register("op6_sharding")
def q_sharding(spark, d):
    return sharding.place(table(spark, d, "documents").select("doc_id"), ["doc_id"])


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


@register("op7_quality_rules", rf"""WITH t AS (
  SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
g AS (SELECT rn, i, list_slice(w, i, i + 4) AS five
  FROM (SELECT rn, w, unnest(range(1, len(w) - 3)) AS i FROM t WHERE len(w) >= 5)),
often AS (SELECT rn, i FROM (SELECT rn, i, count(*) OVER (PARTITION BY rn, five) AS n FROM g) WHERE n > 1),
rep AS (SELECT rn, count(DISTINCT pos) AS n FROM (SELECT rn, unnest(range(i, i + 5)) AS pos FROM often) GROUP BY rn),
l AS (SELECT rn, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup
  FROM (SELECT rn, unnest(string_split(text, chr(10))) AS line FROM t)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rn),
m AS (SELECT doc_id, len(w) AS n_words, coalesce(list_sum([length(x) for x in w]), 0)::BIGINT AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
    length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper
  FROM t LEFT JOIN l USING (rn) LEFT JOIN rep USING (rn))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_letters, n_upper, failed,
  (failed & {quality.mask(quality.BASE)}) <> 0 AS base_failed,
  (failed & {quality.mask(quality.POLICIES[quality.CURRENT])}) = 0 AS kept
FROM (SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
  + CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END
  + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 15 * n_words THEN 32 ELSE 0 END
  + CASE WHEN 100 * n_upper > 50 * n_letters THEN 64 ELSE 0 END)::BIGINT AS failed FROM m)""")
def q_quality_rules(spark, d):
    return quality.apply_policy(quality.ledger(table(spark, d, "documents")))


@register("op3_exact_topk", """WITH v AS (
  SELECT row_number() OVER () AS rn, vec_id, [floor(256 * c::DOUBLE) FOR c IN embedding] AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score,
    row_number() OVER (PARTITION BY q.rn ORDER BY list_inner_product(q.x, c.x) DESC, c.vec_id NULLS LAST) AS rank
  FROM v q JOIN v c ON q.rn <> c.rn AND len(q.x) = len(c.x) WHERE q.vec_id % 50 = 0) WHERE rank <= 5""")
def q_exact_topk(spark, d):
    return topk.search(table(spark, d, "embeddings"), F.col("__id") % 50 == 0, k=5)


_LAST = f"least(j + {line_dedup.MAX_LINES - 1}, len(w))"  # the farthest end of a chunk


@register("op8_line_dedup", f"""WITH t AS (
  SELECT DISTINCT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
ws AS (SELECT *, [i FOR i IN range(1, len(l) + 1) IF regexp_matches(l[i], '{line_dedup.WORD}')] AS w FROM t),
hs AS (SELECT *, [('0x' || substr(md5(l[i]), 1, 8))::BIGINT FOR i IN w] AS h FROM ws),
st AS (SELECT *, unnest(range(1, len(w))) AS j FROM hs),
ch AS (SELECT *, list_min([e FOR e IN range(j + 1, {_LAST} + 1)
  IF e = {_LAST} OR (h[e] + {line_dedup.MULTIPLIER} * h[e - 1]) % {line_dedup.DIVISOR} <> 0]) AS e FROM st),
ct AS (SELECT doc_id, text, range(w[j], w[e] + 1) AS spot, row_number() OVER (
  PARTITION BY array_to_string(l[w[j] : w[e]], chr(10)) ORDER BY doc_id NULLS LAST, j) AS k FROM ch),
o AS (SELECT doc_id, text, count(*) AS n_chunks, count(*) FILTER (k > 1) AS n_removed_chunks,
  list_distinct(flatten(list(spot) FILTER (k > 1))) AS gone FROM ct GROUP BY doc_id, text),
r AS (SELECT t.doc_id, t.text, coalesce(n_chunks, 0) AS n_chunks, coalesce(n_removed_chunks, 0) AS n_removed_chunks, len(l) AS n_lines,
  [l[i] FOR i IN range(1, len(l) + 1) IF NOT coalesce(list_contains(gone, i), false)] AS kept
  FROM t LEFT JOIN o ON t.doc_id IS NOT DISTINCT FROM o.doc_id AND t.text = o.text)
SELECT d.doc_id, n_lines, n_chunks, n_lines - len(kept) AS n_removed_lines, n_removed_chunks,
  sha256(coalesce(array_to_string(kept, chr(10)), '')) AS text_sha256
FROM documents d JOIN r ON d.doc_id IS NOT DISTINCT FROM r.doc_id AND coalesce(d.text, '') = r.text""")
def q_line_dedup(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "__lines.*", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


@register("op9_language_id")
def q_language_id(spark, d):
    return language.identify(table(spark, d, "documents"))


_SHINGLES = r"""s AS (SELECT rn, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) END AS g
  FROM (SELECT row_number() OVER () AS rn, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents))"""


@register("op10_minhash", rf"""WITH RECURSIVE {_SHINGLES},
c AS (SELECT min(doc_id) AS id, g, len(g) AS n FROM (SELECT doc_id, list_sort(g) AS g FROM s WHERE len(g) > 0) GROUP BY g),
e AS (SELECT id, n, unnest(g) AS x FROM c),
p AS (SELECT a.id AS u, b.id AS v, count(*) AS k, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b USING (x)
  WHERE a.id < b.id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL),
l AS (SELECT u, v FROM p WHERE 100 * k >= 80 * (na + nb - k)),
b AS (SELECT u, v FROM l UNION SELECT v, u FROM l UNION SELECT id, id FROM c),
r AS (SELECT u, v FROM b UNION SELECT r.u, b.v FROM r JOIN b ON r.v = b.u),
m AS (SELECT u AS id, min(v) AS component FROM r GROUP BY u)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, coalesce(m.component, s.doc_id) AS component_id,
  coalesce(m.component, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN c ON list_sort(s.g) = c.g LEFT JOIN m ON m.id = c.id""")
def q_minhash(spark, d):
    return minhash.near_duplicates(table(spark, d, "documents"))


@register("op2_packing")
def q_packing(spark, d):
    return packing.pack_documents(table(spark, d, "documents"))


@register("op5_mixing")
def q_mixing(spark, d):
    found = mixing.document_rates(table(spark, d, "documents"), table(spark, d, "labels"))
    return found.select(F.col("__id").alias("doc_id"), F.col("__tokens").alias("n_words"),
                        *[F.col("__p")[i].alias(f"p_{name}") for i, name in enumerate(mixing.DOMAINS)],
                        F.col("__rate").alias("rate"), F.col("__copies").alias("copies"))


@register("op1_suffix_dedup")
def q_suffix_dedup(spark, d):
    found = suffixes.repeated_spans(table(spark, d, "documents"))
    length = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + (x["end"] - x["start"]))
    return found.select("doc_id", "n_bytes", length.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


@register("op11_hard_negatives", """WITH v AS (
  SELECT row_number() OVER () AS rn, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * c::DOUBLE) FOR c IN embedding] AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0),
s AS (SELECT a.rn AS a, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.x, c.x)::BIGINT AS score
  FROM v a JOIN v c ON a.rn <> c.rn AND len(a.x) = len(c.x) WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id NULLS LAST) AS k FROM s WHERE same) WHERE k <= 5)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.a, p.k ORDER BY s.score DESC, s.vec_id NULLS LAST) AS rank
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score) WHERE rank <= 10""")
def q_hard_negatives(spark, d):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, d, "embeddings"), F.col("__id") % 100 == 0, label_col=label)


@register("op12_whitening")
def q_whitening(spark, d):
    return whitening.whiten(table(spark, d, "embeddings"))


@register("op13_repair")
def q_repair(spark, d):
    path = shared_path(spark, "repair")
    repair.write_shards(table(spark, d, "documents"), path)
    return repair.read_documents(spark, path)
