"""Near-duplicate components by fast similarity sketching, banding and exact verification.

Sketch: rounds of hashed bin placement fill every coordinate (``shingles.sketches``).
Texts with equal shingle sets are one class.  Bands of ``BAND_ROWS`` coordinates make
buckets of classes; inside a bucket, classes whose sketches agree in a share of
``PICK`` or more are tied, which gives families: no pair worth a look lies in two
families, and texts that only share boilerplate make none.  Inside a family full shingle
sets decide.  Pairs are never written out: buckets and families yield spanning
forests.  Buckets and families above a block's size are dealt out as pairs of blocks,
so no task ever holds more than two blocks.

Chance of missing one pair of similarity 0.8: (1 - 0.8^5)^40 = 1e-7 for the bands,
5e-6 for the pick by sketch (Chernoff bound at 0.65); both fall fast above 0.8.
Classes and shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, ready, shuffle_parts, slices, utf8
from .connected import components
from .shingles import band_keys, digests, shingle_sets, sketches

BAND_ROWS = 5
PICK = 0.65            # share of equal coordinates from which a pair is verified
BUCKET_BLOCK = 2048
FAMILY_BLOCK = 512


def text_hash(text: Column) -> Column:
    return F.xxhash64(text.isNull(), text)


def shingle_table(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text_hash, n_shingles, digest, bands, sketch`` per input row; the last three are null for an empty set."""
    ready(docs.sparkSession)
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), text_hash(text).alias("__hash"), F.coalesce(text, F.lit("")).alias("__text"))

    def run(batches):
        for b in batches:
            for part in slices(b):
                g, bounds = shingle_sets(*utf8(part.column("__text")), width)
                size = np.diff(bounds)
                empty = size == 0
                sketch = sketches(g, bounds)
                keys = band_keys(sketch, BAND_ROWS)
                short = (sketch & np.uint64(0xFFFF)).astype(np.uint16)
                offsets = np.arange(len(size) + 1, dtype=np.int32) * keys.shape[1]
                bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel()), mask=pa.array(empty))
                yield pa.RecordBatch.from_arrays(
                    [part.column("__id"), part.column("__hash"), pa.array(size.astype(np.int64)),
                     pa.array([None if e else d for d, e in zip(digests(g, bounds), empty)], pa.binary()), bands,
                     pa.array([None if e else s.tobytes() for s, e in zip(short, empty)], pa.binary())],
                    names=["doc_id", "text_hash", "n_shingles", "digest", "bands", "sketch"])

    return rows.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, digest binary, bands array<long>, sketch binary")


def _dealt(rows: DataFrame, member: str, block_rows: int) -> DataFrame:
    """Adds ``i, j, side``: a group of n members (``n`` on every row) goes to all pairs of its blocks."""
    blocks = F.ceil(F.col("n") / F.lit(block_rows)).cast("int")
    placed = rows.withColumn("mine", F.pmod(F.xxhash64(member), blocks).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return placed.withColumns({"i": F.least("mine", "other"), "j": F.greatest("mine", "other"),
                               "side": F.when(F.col("mine") == F.greatest("mine", "other"), 1).otherwise(0)}).drop("mine", "other", "n")


def agreeing(pairs: DataFrame) -> DataFrame:
    """``u, v`` of the pairs whose sketches (``a``, ``b``) agree in a share of ``PICK``."""
    def run(batches):
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(b.num_rows, -1) for c in ("a", "b"))
                near = pa.array((x == y).mean(1) >= PICK)
                yield pa.RecordBatch.from_arrays([b.column(c).filter(near) for c in ("u", "v")], names=["u", "v"])

    return pairs.select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def tied(nodes: np.ndarray, sketch: np.ndarray, side: np.ndarray, group: np.ndarray) -> list:
    """Pairs of nodes whose sketches agree in a share of ``PICK``; with what ``group`` joins
    already, they connect all members that any such pair connects.

    ``side``: as in ``links_among``.  Members of one group are not compared, so nothing is left
    to do for the largest group but to be compared with.
    """
    two = len(np.unique(side)) > 1
    _, group, sizes = np.unique(group, return_inverse=True, return_counts=True)
    out = []
    for x in np.nonzero(group != sizes.argmax())[0].tolist():
        other = np.nonzero((group != group[x]) & (side != side[x]))[0] if two else np.nonzero(group != group[x])[0]
        hit = other[(sketch[other] == sketch[x]).mean(1) >= PICK]
        if len(hit):
            # one member of each group met is enough
            met, first = np.unique(group[hit], return_index=True)
            out += [(int(nodes[x]), v) for v in nodes[hit[first]].tolist()]
            group[np.isin(group, met)] = group[x]
    return out


def _across(rows: DataFrame) -> DataFrame:
    """Adds ``kind, i, j, side``: where the members of a bucket are compared across their groups.

    ``top`` is the bucket's largest group.  Its ``n_top`` members meet the ``n_rest`` others (kind 0), which meet
    each other too (kind 1), in pairs of blocks; members of the largest group never meet
    each other, so a large group with few others costs about one row per member.
    """
    def blocks(n):
        return F.ceil(F.col(n) / F.lit(BUCKET_BLOCK)).cast("int")

    def place(kind, i, j, side):
        return F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))

    top, rest = blocks("n_top"), blocks("n_rest")
    own = F.xxhash64("node")
    in_top, in_rest = F.pmod(own, top), F.pmod(own, rest)
    of_top = F.transform(F.sequence(F.lit(0), rest - 1), lambda j: place(0, in_top, j, F.lit(0)))
    of_rest = F.concat(
        F.transform(F.sequence(F.lit(0), top - 1), lambda i: place(0, i, in_rest, F.lit(1))),
        F.transform(F.sequence(F.lit(0), rest - 1), lambda j: place(
            1, F.least(in_rest, j.cast("long")), F.greatest(in_rest, j.cast("long")), (in_rest >= j).cast("int"))))
    return rows.withColumn("p", F.explode(F.when(F.col("group") == F.col("top"), of_top).otherwise(of_rest))) \
        .select("key", "node", "group", "p.*")


def _families(classes: DataFrame, parts: int) -> DataFrame:
    """``node, component``: classes tied in some bucket.

    A class is first compared with the smallest member of each of its buckets, which joins most of a
    large group of near copies at the cost of one pass.  Only buckets that still hold
    several components are compared in full, and there only across components.
    """
    rows = classes.select("node", F.explode("bands").alias("key"))
    # written tables, so that the joins below can split a large bucket over tasks
    hubs = rows.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("top")).filter("hub < top").select("key", "hub").checkpoint()
    members = rows.join(hubs, "key")
    sketch = classes.select("node", "sketch")
    pairs = members.filter("node <> hub").select(F.col("node").alias("u"), F.col("hub").alias("v")).distinct()
    near = agreeing(pairs.join(sketch.toDF("u", "a"), "u").join(sketch.toDF("v", "b"), "v"))
    joined = components(near).checkpoint()

    grouped = members.select("node", "key").join(joined, "node", "left").select("node", "key", F.coalesce("component", "node").alias("group"))
    sizes = grouped.groupBy("key", "group").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.groupBy("key").agg(F.max(F.struct("n", "group")).alias("top"), F.sum("n").alias("n")) \
        .select("key", "top.group", F.col("top.n").alias("n_top"), (F.col("n") - F.col("top.n")).alias("n_rest")).filter("n_rest > 0") \
        .withColumnRenamed("group", "top").checkpoint()
    met = _across(grouped.join(mixed, "key")).join(sketch, "node")

    def run(batches):
        key, held = None, []

        def out():
            nodes, side, group = (np.array([h[k] for h in held], np.int64) for k in (0, 2, 3))
            found = tied(nodes, np.frombuffer(b"".join(h[1] for h in held), np.uint16).reshape(len(held), -1), side, group)
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["u", "v"])

        for b in batches:
            for k, kind, i, j, *row in zip(*(b.column(c).to_pylist() for c in ("key", "kind", "i", "j", "node", "sketch", "side", "group"))):
                if (k, kind, i, j) != key:
                    if len(held) > 1:
                        yield out()
                    key, held = (k, kind, i, j), []
                held.append(row)
        if len(held) > 1:
            yield out()

    across = met.repartition(parts, "key", "kind", "i", "j").sortWithinPartitions("key", "kind", "i", "j", "node").mapInArrow(run, "u long, v long")
    return components(across.unionByName(joined.select(F.col("node").alias("u"), F.col("component").alias("v"))))


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x


def links_among(ids: np.ndarray, g: np.ndarray, bounds: np.ndarray, side: np.ndarray, percent: int) -> list:
    """A spanning forest, as (larger id, smaller id), of the linked pairs among some texts.

    ``side``: pairs of two texts that both are on side 0 or both on side 1 are left
    to another call if both sides are present.
    """
    n = len(ids)
    sketch = (sketches(g, bounds) & np.uint64(0xFFFF)).astype(np.uint16)
    size = np.diff(bounds)
    forest, out = _Forest(n), []
    two = len(np.unique(side)) > 1
    for x in range(1, n):
        if not size[x]:
            continue
        small, large = np.minimum(size[:x], size[x]), np.maximum(size[:x], size[x])
        might = 100 * small >= percent * large
        if two:
            might &= side[:x] != side[x]
        who = np.nonzero(might & (size[:x] > 0))[0]
        if not len(who):
            continue
        alike = (sketch[who] == sketch[x]).mean(1)
        picked = who[alike >= PICK]
        mine = g[bounds[x]:bounds[x + 1]]
        for y in picked[np.argsort(-alike[alike >= PICK], kind="stable")].tolist():
            a, b = forest.root(x), forest.root(y)
            if a == b and ids[x] != ids[y]:
                continue
            other = g[bounds[y]:bounds[y + 1]]
            at = np.searchsorted(other, mine)
            common = int((other[np.minimum(at, len(other) - 1)] == mine).sum())
            if 100 * common >= percent * (len(mine) + len(other) - common):
                forest.up[max(a, b)] = min(a, b)
                out.append((int(max(ids[x], ids[y])), int(min(ids[x], ids[y]))))
    return out


def _family_links(rows: DataFrame, width: int, percent: int, parts: int) -> DataFrame:
    """``rows``: family, i, j, side, __id, __text; every (family, i, j) is one comparison."""
    def linked(groups):
        """Sets of many families in one pass, then family by family."""
        data = [t.encode() for rows_ in groups for _, _, t in rows_]
        off = np.concatenate([[0], np.cumsum([len(t) for t in data])]).astype(np.int64)
        g, bounds = shingle_sets(np.frombuffer(b"".join(data), np.uint8), off, width)
        found, lo = [], 0
        for rows_ in groups:
            hi = lo + len(rows_)
            own = bounds[lo:hi + 1]
            found += links_among(np.array([i for _, i, _ in rows_], np.int64), g[own[0]:own[-1]], own - own[0],
                                 np.array([s for s, _, _ in rows_]), percent)
            lo = hi
        return pa.RecordBatch.from_arrays([pa.array([u for u, _ in found], pa.int64()), pa.array([v for _, v in found], pa.int64())],
                                          names=["u", "v"])

    def run(batches):
        key, groups, size = None, [], 0
        for b in batches:
            for f, i, j, side, d, t in zip(*(b.column(c).to_pylist() for c in ("family", "i", "j", "side", "__id", "__text"))):
                if (f, i, j) != key:
                    if size > SLICE_BYTES:
                        yield linked(groups)
                        groups, size = [], 0
                    key = (f, i, j)
                    groups.append([])
                groups[-1].append((side, d, t))
                size += len(t)
        if groups:
            yield linked(groups)

    return (rows.repartition(parts, "family", "i", "j").sortWithinPartitions("family", "i", "j", "side", "__id")
            .mapInArrow(run, "u long, v long"))


def row_groups(docs: DataFrame, width: int = 2, percent: int = 80, id_col: str = "doc_id", text_col: str = "text",
               one_per_id: bool = True) -> DataFrame:
    """``doc_id, text_hash, n_shingles, first`` per input row.

    ``first`` is the smallest (doc_id, text_hash) that the row's text reaches over links, itself
    included; null for a null id and for a text without words.  With ``one_per_id``
    the texts of one id are tied to each other, otherwise each is judged on its own.
    """
    spark = ready(docs.sparkSession)
    parts = shuffle_parts(spark)
    sets = shingle_table(docs, width, id_col, text_col).checkpoint()
    node = F.xxhash64("digest").alias("node")
    named = sets.filter(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    classes = named.groupBy("digest").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.first("bands").alias("bands"),
                                          F.first("sketch").alias("sketch")).withColumn("node", node).checkpoint()
    families = _families(classes, parts).checkpoint()

    # one text of each class; a family's size decides into how many blocks its members are dealt
    sizes = families.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    members = (families.join(sizes, "component").join(classes.select("node", "first"), "node").select(
        F.col("component").alias("family"), "n", F.col("node").alias("__id"), F.col("first.doc_id").alias("__doc"),
        F.col("first.text_hash").alias("__hash")).checkpoint())
    # (written, so that the join below can split a row that is repeated very often)
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).cast("long").alias("__doc"), text_hash(text).alias("__hash"), text.alias("__text")) \
        .filter(F.col("__text").isNotNull())
    one = texts.join(members, ["__doc", "__hash"]).groupBy("family", "n", "__id").agg(F.first("__text").alias("__text"))
    found = _family_links(_dealt(one, "__id", FAMILY_BLOCK), width, percent, parts)
    if one_per_id:
        # an id with several texts ties their classes
        several = named.groupBy("doc_id").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).filter("a <> b").select("doc_id", "a")
        found = found.unionByName(named.join(several, "doc_id").select(node.alias("u"), F.xxhash64("a").alias("v")))
    joined = components(found).checkpoint()
    # classes in reach of others get the smallest first of their component
    linked = joined.join(classes.select("node", "first"), "node")
    least = linked.groupBy("component").agg(F.min("first").alias("least"))
    reach = linked.join(least, "component").select("node", "least")
    labels = classes.select("digest", "node", "first").join(reach, "node", "left").select("digest", F.coalesce("least", "first").alias("first"))
    return sets.select("doc_id", "text_hash", "n_shingles", "digest").join(labels, "digest", "left").select(
        "doc_id", "text_hash", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("first")).alias("first"))


def near_duplicates(docs: DataFrame, width: int = 2, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per input row.

    A-Z are lower-cased; words are runs other than 0x20 and 0x09-0x0D.  Texts
    whose sets of ``width``-word shingles have 100 * |common| >= percent * |all| are
    linked; ``component_id`` is the smallest id in reach.  Empty and null texts
    have no shingles and are linked with nothing.  Rows that share an id are one
    document: they are linked with each other and with whatever either links to,
    except that empty rows add nothing.  A null id has no component and is kept.
    An empty table gives no rows; other columns are not read.
    """
    rows = row_groups(docs, width, percent, id_col, text_col)
    out = rows.select("doc_id", "n_shingles", F.coalesce("first.doc_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))
