"""Line deduplication over content-defined chunks of lines, in DataFrame functions only.

Lines with a word are hashed.  A chunk starts at every such line and goes on to
the first boundary that a rolling hash over the last two line hashes chooses, so
all of a chunk is settled by its own lines: a passage is cut alike wherever it
stands.  Chunks overlap.  A line goes if a chunk that holds it also stands
earlier.  Hashes only find candidates: nothing is removed unless its bytes equal
those of the occurrence that comes first.

Documents cross the network once: the candidate lists and the lists of removals
meet the same exchange of whole rows.  The search itself shuffles (key, chunk
number, hash) rows and the bytes of candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import own_names, plain_names, ready

MULTIPLIER = 1_000_003
DIVISOR = 8           # a chunk goes on past a line only if the rolling hash there is divisible by this
MIN_LINES = 2         # lines with a word in a chunk, and in the rolling hash
MAX_LINES = 8         # a chunk ends here at the latest: chunks of a text hold its bytes eight times at most
WORD = r"[^\x20\x09-\x0D]"
KEYS = ["__null", "__id", "__text_hash"]


def _let(value: Column, body) -> Column:
    """``body`` applied to a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _let_row(body) -> Column:
    return F.element_at(F.transform("__row", body), 1)


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")


def _chunks(lines: Column) -> Column:
    """One chunk (j, start, n) for each line with a word but the last: its number among these, its place and
    its length in lines; blank lines inside it belong to it.  The work is linear in the lines."""
    def of_worded(at: Column) -> Column:
        m = F.size(at)

        def of_hashes(hashes: Column) -> Column:
            def is_end(e: Column) -> Column:
                return (e == m) | ((F.get(hashes, e - 1) + F.lit(MULTIPLIER) * F.get(hashes, e - 2)) % DIVISOR != 0)

            def of_ends(ends: Column) -> Column:
                # all starts between two boundaries share the second one
                def up_to(k: Column) -> Column:
                    end = F.get(ends, k)

                    def one(j: Column) -> Column:
                        last = F.get(at, j + F.least(end - j, F.lit(MAX_LINES)) - 1)
                        return F.struct(j.alias("j"), F.get(at, j).alias("start"), (last - F.get(at, j) + 1).alias("n"))

                    return F.transform(F.sequence(F.coalesce(F.get(ends, k - 1), F.lit(1)) - 1, end - MIN_LINES), one)

                return F.flatten(F.transform(F.sequence(F.lit(0), F.size(ends) - 1), up_to))

            return _let(F.filter(F.sequence(F.lit(MIN_LINES), m), is_end), of_ends)

        found = _let(F.transform(at, lambda i: _line_hash(F.get(lines, i))), of_hashes)
        return F.when(m >= MIN_LINES, found).otherwise(F.array().cast("array<struct<j:int,start:int,n:int>>"))

    return _let(F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.get(lines, i).rlike(WORD)), of_worded)


def _with_chunks(text: Column, body) -> Column:
    """``body(lines, chunks)`` of a text."""
    return _let(F.split(text, "\n", -1), lambda lines: _let(_chunks(lines), lambda c: body(lines, c)))


def _chunk_text(lines: Column, chunk: Column) -> Column:
    return F.array_join(F.slice(lines, chunk["start"] + 1, chunk["n"]), "\n")


def _keys(id_col: str, text_col: str) -> list[Column]:
    i = F.col(id_col).cast("long")
    return [i.isNull().alias("__null"), F.coalesce(i, F.lit(0)).alias("__id"), F.xxhash64(_text(F.col(text_col))).alias("__text_hash")]


def _text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Keys and ``__row``, the whole row as the one item of an array: no join prunes it, so all share one exchange."""
    return docs.select(*_keys(id_col, text_col), F.array(F.struct(*docs.columns)).alias("__row"))


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document that loses chunks: its keys and ``__removed``, the chunk numbers."""
    ready(docs.sparkSession)
    found = _with_chunks(F.col("__text"), lambda lines, chunks: F.transform(
        chunks, lambda c: F.struct(c["j"].alias("j"), F.xxhash64(_chunk_text(lines, c)).alias("h"))))
    keyed = docs.select(*_keys(id_col, text_col), _text(F.col(text_col)).alias("__text"))
    rows = keyed.select(*KEYS, F.explode(found).alias("c")).select(*KEYS, "c.j", "c.h")
    # a written table of hashes, so that the join with it can split a hot hash over tasks
    repeated = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h").checkpoint()
    candidates = rows.join(repeated, "h", "left_semi")

    # bytes of the candidates, and of nothing else, are grouped by hash
    lists = candidates.groupBy(*KEYS).agg(F.collect_set("j").alias("__maybe"))
    texts = _let_row(lambda row: _with_chunks(_text(row[text_col]), lambda lines, chunks: F.transform(
        F.array_sort("__maybe"), lambda j: F.struct(j.alias("j"), _chunk_text(lines, F.get(chunks, j)).alias("t")))))
    held = (_keyed(docs, id_col, text_col).join(lists, KEYS).select(*KEYS, F.explode(texts).alias("c"))
            .select(*KEYS, "c.j", "c.t", F.xxhash64("c.t").alias("h")))
    groups = held.groupBy("h").agg(F.min(F.struct(*KEYS, "j")).alias("first"), F.min("t").alias("a"), F.max("t").alias("b"))
    # every occurrence goes but the first; a hash whose texts differ (a collision) removes nothing
    odd = groups.filter(F.col("a") != F.col("b")).select("h")
    first = groups.filter(F.col("a") == F.col("b")).select("first.*")
    return (candidates.join(odd, "h", "left_anti").join(first, [*KEYS, "j"], "left_anti")
            .groupBy(*KEYS).agg(F.collect_set("j").alias("__removed")))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the lines of repeated chunks, plus the struct ``__lines``
    (``n_lines``, ``n_chunks``, ``n_removed_lines``, ``n_removed_chunks``).

    A chunk is repeated if one of equal bytes stands in a document of smaller id (null
    ids come last) or before it in its own.  Chunks are judged on the input, and overlaps
    count; the earliest of all equal lines always stays.  Blank lines outside chunks stay.
    A null text stays null; it and an empty text are one empty line.  Rows that repeat both
    id and text are one document: all of them keep or lose the same lines.  All other columns
    pass through; a column called ``__lines`` is replaced.
    """
    docs, new = plain_names(docs)
    id_col, text_col = new[id_col], new[text_col]
    joined = _keyed(docs, id_col, text_col).join(removals(docs, id_col, text_col), KEYS, "left")

    def result(whole: Column, lines: Column, chunks: Column) -> Column:
        removed = F.coalesce("__removed", F.array().cast("array<int>"))
        covered = F.flatten(F.transform(removed, lambda j: _let(
            F.get(chunks, j), lambda c: F.sequence(c["start"], c["start"] + c["n"] - 1))))
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), covered)
        rest = _let(kept, lambda left: F.struct(
            F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n").alias("text"),
            (F.size(lines) - F.size(left)).cast("long").alias("n_removed_lines")))
        return _let(rest, lambda r: F.struct(
            F.when(F.col("__removed").isNull(), whole).otherwise(r["text"]).alias("text"),
            F.struct(F.size(lines).cast("long").alias("n_lines"), F.size(chunks).cast("long").alias("n_chunks"),
                     r["n_removed_lines"], F.size(removed).cast("long").alias("n_removed_chunks")).alias("counts")))

    out = joined.select(F.element_at("__row", 1).alias("__row"), _let_row(
        lambda row: _let(_text(row[text_col]), lambda t: _with_chunks(t, lambda *found: result(t, *found)))).alias("__out"))
    text = F.when(F.col(text_col).isNull(), F.lit(None)).otherwise(F.col("__out.text"))
    return own_names(out.select("__row.*", "__out").withColumns({"__lines": F.col("__out.counts"), text_col: text}), new, "__lines")
