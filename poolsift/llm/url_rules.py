"""URL filters by hash-prefix lookup.

Each URL is expanded into (host suffix, path prefix) expressions, the
expressions are equi-joined with the rules on a short prefix of their SHA-256,
and the few hits are confirmed by the full digest before precedence picks one
rule.  Only label counts and path lengths that some rule has are expanded, so
the work per URL is bounded by the shapes of the rules, not by the URL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
BROADCAST_BYTES = 32 << 20
RULE_BYTES = 200     # of a rule beside its host and path: digest, key, verdict
PREFIX_HEX = 8   # 32 bits of the digest are joined on
RULE_SCHEMA = "host string, path string, verdict string"

# The rules of the registered query.
RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


def url_host(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


COPY_BLOCK = 4096


def default_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, RULE_SCHEMA)


def _labels(host: Column) -> Column:
    return F.size(F.split(host, r"\."))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
               default: str = "allow") -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict``.

    A rule fits its host and every subdomain when the path starts with the
    rule's path.  Among fitting rules the longest rule string wins; ties go to
    the longer host, then to ``block``, then to the larger string.  Without a
    rule the verdict is ``default``.  Null URLs have an empty host and path;
    null and repeated page ids are kept as they are; null rule hosts or paths
    never fit.  Columns beside the id and the URL are not read.
    """
    hosts = F.translate(F.col("host"), UPPER, LOWER)
    known = (rules.filter(F.col("host").isNotNull() & F.col("path").isNotNull())
             .select(hosts.alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict")))
    # the shapes that occur: at most one entry per label count and per path length
    shape = known.agg(F.collect_set(_labels(F.col("r_host"))).alias("l"), F.collect_set(F.length("r_path")).alias("p"),
                      F.sum(F.octet_length("r_host") + F.octet_length("r_path") + F.lit(RULE_BYTES)).alias("size")).first()
    labels, lengths = sorted(shape["l"]), sorted(shape["p"])
    digest = F.sha2(F.concat("r_host", "r_path"), 256)
    known = known.withColumn("r_digest", digest).withColumn("r_key", F.substring("r_digest", 1, PREFIX_HEX))
    if (shape["size"] or 0) <= BROADCAST_BYTES:
        known = F.broadcast(known)      # measured above; larger rule tables are shuffled by the join key

    base = pages.select(F.col(id_col).alias("page_id"), url_host(F.col(url_col)).alias("host"),
                        url_path(F.col(url_col)).alias("path"))
    parts = F.split(F.col("host"), r"\.")
    n = F.size(parts)
    suffixes = [F.when(n >= k, F.array_join(F.slice(parts, n - k + 1, F.lit(k)), ".")) for k in labels]
    prefixes = [F.when(F.length("path") >= m, F.substring("path", 1, m)) for m in lengths]
    expressions = [F.sha2(F.concat(s, p), 256) for s in suffixes for p in prefixes]
    # the empty entry stands for the page itself, so that pages without a hit stay
    rows = base.withColumn("digest", F.explode(F.concat(
        F.array(F.lit("")), F.array_compact(F.array(*expressions)) if expressions else F.array().cast("array<string>"))))
    hit = F.col("r_digest") == F.col("digest")
    rule = F.concat("r_host", "r_path")
    rank = F.when(hit, F.struct(F.length(rule).alias("n"), F.length("r_host").alias("h"),
                                (F.col("r_verdict") == "block").alias("b"), rule.alias("rule"),
                                F.col("r_verdict").alias("verdict")))
    return (rows.withColumn("r_key", F.substring("digest", 1, PREFIX_HEX)).join(known, "r_key", "left")
            .groupBy("page_id", "host", "path")
            .agg(F.max(rank).alias("best"), F.count_if(F.col("digest") == "").alias("copies"))
            # equal rows come back in blocks: no array holds more than a block's worth, however often a row occurs
            .withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {COPY_BLOCK}"))))
            .withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.expr(f"least({COPY_BLOCK}, copies - {COPY_BLOCK} * __block)"))))
            .select("page_id", "host", "path", F.col("best.rule").alias("rule"),
                    F.coalesce("best.verdict", F.lit(default)).alias("verdict")))
