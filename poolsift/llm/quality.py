"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger stores the measurements
and one bit per failed rule.  A policy is a versioned mask over the bits, so a
new policy, or the question what each rule costs, never reads a text again.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import own_names, plain_names, ready, slices, utf8, whitespace_table

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
MEASURES = StructType([StructField(c, LongType()) for c in (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper")])

# The rules in bit order: name -> failed?  Integer arithmetic only, so that no rule depends on rounding.
RULES = {
    "few_words": lambda m: m("n_words") < 10,
    "repeat_words": lambda m: 100 * m("n_repeat_words") > 20 * m("n_words"),
    "symbols": lambda m: 10 * m("n_symbols") > 3 * m("n_words"),
    "dup_lines": lambda m: 100 * m("n_dup_lines") > 30 * m("n_lines"),
    "short_words": lambda m: m("word_chars") < 2 * m("n_words"),
    "long_words": lambda m: m("word_chars") > 15 * m("n_words"),
    "upper_case": lambda m: 100 * m("n_upper") > 50 * m("n_letters"),
}
BASE = ("few_words", "repeat_words")
# version -> the rules that it enforces
POLICIES = {
    1: BASE,
    2: (*BASE, "symbols", "dup_lines"),
    3: tuple(RULES),
}
CURRENT = 3


def mask(names) -> int:
    order = list(RULES)
    return sum(1 << order.index(n) for n in names)


def _measure(batch: pa.RecordBatch) -> pa.RecordBatch:
    space = whitespace_table()
    data, off = utf8(batch.column("__text"))

    def per_doc(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[off[1:]] - total[off[:-1]]

    blob = data.tobytes()
    texts = [blob[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
    words = [t.split() for t in texts]      # bytes.split() parts at 0x20 and 0x09-0x0D
    counts = np.array([len(w) for w in words], dtype=np.int64)
    is_char = (data & 0xC0) != 0x80         # first byte of each code point
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    upper = (data >= 65) & (data <= 90)
    lower = (data >= 97) & (data <= 122)
    lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
    columns = [counts, per_doc(is_char & ~space[data]), per_doc(symbol[data]),
               [len(x) - len(set(x)) for x in lines], _repeat_words(words, counts), [len(x) for x in lines],
               per_doc(upper | lower), per_doc(upper)]
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c, dtype=np.int64)) for c in columns], names=MEASURES.names)


def _repeat_words(words: list, counts: np.ndarray) -> np.ndarray:
    """Words that lie in a window of five words found twice or more in the same text.

    Words are numbered, then windows of two, four and five words, each by exact
    equality; windows never span two texts.
    """
    total = int(counts.sum())
    covered = np.zeros(total + 1, dtype=np.int64)
    start = np.concatenate([[0], np.cumsum(counts)])
    if total >= WINDOW:
        flat = np.empty(total, dtype=object)
        flat[:] = [w for ws in words for w in ws]
        one = pd.factorize(flat)[0].astype(np.int64)
        doc = np.repeat(np.arange(len(counts)), counts)

        def joined(a, b, shift):
            m = len(a) - shift
            return pd.factorize(a[:m] * (int(b.max()) + 1) + b[shift:shift + m])[0].astype(np.int64)

        two = joined(one, one, 1)
        four = joined(two, two, 2)
        m = total - WINDOW + 1
        five = pd.factorize(four[:m] * (int(one.max()) + 1) + one[WINDOW - 1:])[0].astype(np.int64)
        inside = doc[:m] == doc[WINDOW - 1:]
        key = pd.factorize(five * len(counts) + doc[:m])[0]
        often = np.bincount(key[inside], minlength=int(key.max()) + 1)
        at = np.nonzero(inside & (often[key] > 1))[0]
        np.add.at(covered, at, 1)
        np.add.at(covered, at + WINDOW, -1)
    flags = np.concatenate([[0], np.cumsum(np.cumsum(covered[:total]) > 0)])
    return flags[start[1:]] - flags[start[:-1]]


def _measured(docs: DataFrame, text: Column, keep: list) -> DataFrame:
    """The kept columns and ``__m``, the struct of measurements."""
    ready(docs.sparkSession)
    rows = docs.select(F.coalesce(text.cast("string"), F.lit("")).alias("__text"), *keep)
    schema = rows.drop("__text").schema.add("__m", MEASURES)

    def run(batches):
        for b in batches:
            for part in slices(b):
                m = _measure(part)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.StructArray.from_arrays(m.columns, m.schema.names)],
                                                 names=[*part.schema.names[1:], "__m"])

    return rows.mapInArrow(run, schema)


def _with_bits(measured: DataFrame) -> DataFrame:
    bits = F.lit(0).cast("long")
    for i, failed in enumerate(RULES.values()):
        bits = bits.bitwiseOR(F.when(failed(lambda c: F.col(f"__m.{c}")), F.lit(1 << i).cast("long"))
                              .otherwise(F.lit(0).cast("long")))
    return measured.withColumn("__m", F.col("__m").withField("failed", bits))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the measurements and ``failed`` (bit i: rule i of ``RULES`` failed), one row per input row.

    A null text counts as empty: no words, so ``few_words`` fails and no other
    rule does.  Null and repeated ids pass through; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("c0"))
    return _with_bits(_measured(rows, F.col("c0"), ["doc_id"])).select("doc_id", "__m.*")


def passes(policy: int = CURRENT, bits: str = "failed") -> Column:
    return F.col(bits).bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long")) == 0


def apply_policy(book: DataFrame, policy: int = CURRENT) -> DataFrame:
    return book.withColumn("base_failed", ~passes(1)).withColumn("kept", passes(policy))


def ablations(book: DataFrame, policy: int = CURRENT) -> DataFrame:
    """Per rule of the policy: rows that fail it, rows that only it rejects, and the
    rows kept without it, from counts per distinct bit pattern (at most 2^rules rows)."""
    enforced = mask(POLICIES[policy])
    patterns = (book.groupBy(F.col("failed").bitwiseAND(F.lit(enforced).cast("long")).alias("bits"))
                .agg(F.count(F.lit(1)).alias("n")))
    order = list(RULES)
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << order.index(r)).cast("long").alias("bit"))
                      for r in POLICIES[policy]])
    rows = patterns.withColumn("r", F.explode(rules)).select("bits", "n", "r.rule", "r.bit")
    fails = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return rows.groupBy("rule").agg(
        F.sum(F.when(fails, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not("bit")) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"))


def keep_passing(docs: DataFrame, policy: int = CURRENT, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass the policy, with all their columns, without a shuffle."""
    rows, new = plain_names(docs)
    book = _with_bits(_measured(rows, F.col(new[text_col]), rows.columns))
    return own_names(book.filter(passes(policy, "__m.failed")), new)
