"""A corpus pipeline of the operators in ``poolsift.llm``.

Quality rules reject documents, repeated line chunks are cut out, one document
of each near-duplicate group stays, sources are mixed to target weights, and the
result is packed into training sequences.  Each stage reads the stored table of
the one before it.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from poolsift.llm import line_dedup, minhash, mixing, packing, quality
from poolsift.llm.common import own_names, plain_names, ready, table
from poolsift.session import shared_path

SHINGLE_WORDS = 5
SIMILARITY_PERCENT = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a rule of the current policy go; null and empty texts have no words and go too."""
    ready(spark)
    return quality.keep_passing(docs)


def line_chunks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the line chunks that stand in an earlier document; a document that
    loses its last word that way goes.  ``n_chars`` follows the text.  Null texts stay null."""
    ready(spark)
    rows, new = plain_names(docs)
    text = new["text"]
    cut = line_dedup.dedup_lines(rows, new["doc_id"], text)
    wordless = ~F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    kept = cut.filter(~(wordless & (F.col("__lines.n_removed_chunks") > 0)))
    if "n_chars" in new:
        kept = kept.withColumn(new["n_chars"], F.length(text).cast("long"))
    return own_names(kept, new)


def _sortable(rows: DataFrame) -> Column:
    """All columns as a key; kinds without an order as their text."""
    odd = ("map<", "variant")
    return F.struct(*[F.col(c).cast("string") if any(x in kind for x in odd) else F.col(c) for c, kind in rows.dtypes])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id.

    A document is an id with its text: of rows that repeat both, the one that sorts first by
    its other columns stays; unlike texts under one id are judged apart.  Texts
    without words are in no group.  Null ids are in no group and stay.
    """
    ready(spark)
    rows, new = plain_names(docs)
    i, text = new["doc_id"], new["text"]
    found = minhash.row_groups(rows, SHINGLE_WORDS, SIMILARITY_PERCENT, i, text, one_per_id=False)
    own = F.struct("doc_id", "text_hash")
    stay = found.filter(F.col("doc_id").isNotNull() & (F.col("first").isNull() | (F.col("first") == own))) \
        .select("doc_id", "text_hash").distinct()
    # a row that is repeated very often shrinks to one row in every task before it is shuffled
    others = rows.drop(i, text)
    first = F.min_by(F.struct(*rows.columns), _sortable(others)) if others.columns else F.first(F.struct(*rows.columns))
    one = rows.filter(F.col(i).isNotNull()).groupBy(
        F.col(i).cast("long").alias("doc_id"), minhash.text_hash(F.col(text).cast("string")).alias("text_hash")).agg(first.alias("row"))
    kept = one.join(stay, ["doc_id", "text_hash"], "left_semi").select("row.*")
    return own_names(kept.unionByName(rows.filter(F.col(i).isNull())), new)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are thinned out or repeated to the target weights of the label domains;
    no document that the classifier finds clean is lost.  Null texts have the classifier's prior;
    rows that repeat id and text are repeated alike."""
    ready(spark)
    rows, new = plain_names(docs)
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", new["doc_id"])
    return own_names(mixing.repeated(mixing.mix(rows, labels, id_col=new["doc_id"], text_col=new["text"])), new)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens at most; a null text is its end id alone."""
    ready(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_chunks),
    ("MinHash near-dedup", near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_windows),
]
# SQL has neither the trained classifier nor the tokenizer; tests hold every stage against a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = shared_path(spark, f"stage{i + 1}")
            out.write.parquet(path)
            out = spark.read.parquet(path)
        docs = out
    return docs
