"""Exact inner-product top-k by ball-tree branch and bound per shard.

Shards are cut by space (the reference direction nearest to a row) and bounded in size;
a task holds one shard's ball tree and lets blocks of queries through it, visiting
nodes in the order of their inner-product upper bound.  Every block first searches one
shard of its own cell; the k-th scores found there go with the block, so that the
trees are cut with them from the start, and the block is only sent to shards whose
root can beat one of them.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ready, shuffle_parts
from .negatives import REFERENCES, angles_to, reference_directions, references, whole

SHARD_ROWS = 4096           # on average over the cells; a hot cell's shards may be REFERENCES times as large
SLOTS = 32                  # over which the join of blocks and shards is spread
BLOCK_ROWS = 256
LEAF_ROWS = 64
EXACT = float(1 << 52)      # below, sums of products are exact in float64
RESULT = "q long, query_id long, vec_id long, score long"
NO_ID = int(np.iinfo(np.int64).max)
NULL_ID = NO_ID - 1         # stands for a null id inside tasks: behind all others
LOWEST = int(np.iinfo(np.int64).min)


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products; scores beyond a long are cut to its ends."""
    top = (np.abs(q).max(initial=0) * np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if top < EXACT:
        return (q @ x.T).astype(np.int64)
    whole = np.array([[sum(int(a) * int(b) for a, b in zip(r, s)) for s in x] for r in q], dtype=object).reshape(len(q), len(x))
    lo, hi = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    return np.vectorize(lambda v: min(max(v, lo), hi), otypes=[np.int64])(whole) if whole.size else whole.astype(np.int64)


class BallTree:
    """Nodes as (centre, radius, smallest id, rows or children); leaves hold up to LEAF_ROWS rows.

    ``places`` tell rows of one id apart."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, places: np.ndarray):
        self.ids, self.x, self.places, self.nodes = ids, x, places, []
        if len(ids):
            self._split(np.arange(len(ids)))

    def _split(self, rows: np.ndarray) -> int:
        centre = self.x[rows].mean(0)
        away = np.linalg.norm(self.x[rows] - centre, axis=1)
        me = len(self.nodes)
        self.nodes.append(None)
        kids = None
        if len(rows) > LEAF_ROWS:
            # two far-apart rows; halves by which of them is nearer (equal rows split evenly)
            a = self.x[rows[np.argmax(away)]]
            b = self.x[rows[np.argmax(np.linalg.norm(self.x[rows] - a, axis=1))]]
            order = np.argsort(self.x[rows] @ (b - a), kind="stable")
            half = len(rows) // 2
            kids = (self._split(rows[order[:half]]), self._split(rows[order[half:]]))
        self.nodes[me] = (centre, float(away.max(initial=0.0)), int(self.ids[rows].min()), rows if kids is None else None, kids)
        return me

    def search(self, own_places: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray, floor_id: np.ndarray):
        """Per query the rows that are among the k best here and better than (floor, floor_id)."""
        n = len(own_places)
        best = np.full((n, k), LOWEST, np.int64)
        who = np.full((n, k), NO_ID, np.int64)
        last, last_id = floor.copy(), floor_id.copy()      # the k-th score so far, shared or found here
        norm = np.linalg.norm(q, axis=1)

        def bound(node):
            c, r = node[0], node[1]
            b = q @ c + norm * r
            return b + 1e-9 * (np.abs(q) @ np.abs(c) + norm * r) + 1e-6

        def alive(b, node):
            return (b > last) | ((b >= last) & (node[2] < last_id))

        heap = []

        def push(at):
            b = bound(self.nodes[at])
            live = alive(b, self.nodes[at])
            if live.any():
                heapq.heappush(heap, (-float(b[live].max()), at, b))

        if self.nodes and n:
            push(0)
        while heap:
            _, at, b = heapq.heappop(heap)
            node = self.nodes[at]
            live = np.nonzero(alive(b, node))[0]
            if not len(live):
                continue
            if node[4] is not None:
                for kid in node[4]:
                    push(kid)
                continue
            ids = self.ids[node[3]]
            score = _products(q[live], self.x[node[3]])
            own = self.places[node[3]][None, :] == own_places[live][:, None]
            better = ~own & ((score > last[live][:, None]) | ((score == last[live][:, None]) & (ids[None, :] < last_id[live][:, None])))
            s = np.hstack([best[live], np.where(better, score, LOWEST)])
            w = np.hstack([who[live], np.where(better, ids[None, :], NO_ID)])
            order = np.lexsort((w, ~s), axis=1)[:, :k]       # ~s falls as s rises, without overflow
            best[live], who[live] = np.take_along_axis(s, order, 1), np.take_along_axis(w, order, 1)
            full = who[live][:, -1] != NO_ID
            rows = live[full]
            last[rows], last_id[rows] = best[rows, -1], who[rows, -1]
        return best, who


def participants(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``__id, __vec`` of the rows that take part: all but those with a null vector
    or a null or non-finite component."""
    finite = F.forall("__vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("__id"),
                          F.transform(F.col(vec_col), lambda v: v.cast("double")).alias("__vec"))
    return rows.filter(F.col("__vec").isNotNull() & F.coalesce(finite, F.lit(False)))


def _placed(rows: DataFrame, of: dict, scale: float, spread: int) -> DataFrame:
    """Adds the row's place in the table, its vector length and its shard (``spread`` shards per cell)."""
    def run(batches):
        for b in batches:
            vecs = b.column("__vec").to_pylist()
            dims = np.array([len(v) for v in vecs], np.int32)
            cell = np.zeros(len(vecs), np.int32)
            for dim in np.unique(dims).tolist():
                at = np.nonzero(dims == dim)[0]
                x = whole(np.array([vecs[i] for i in at], float).reshape(len(at), dim), scale)
                cell[at] = angles_to(x, np.linalg.norm(x, axis=1), references(of, dim)).argmin(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(dims), pa.array(cell)], names=[*b.schema.names, "dim", "cell"])

    numbered = rows.select("__id", "__vec", F.monotonically_increasing_id().alias("__row"))
    found = numbered.mapInArrow(run, "__id long, __vec array<double>, __row long, dim int, cell int")
    return found.withColumn("shard", (F.col("cell") * F.lit(spread) + F.pmod(F.xxhash64("__row"), F.lit(spread))).cast("long"))


def _ball(x: np.ndarray) -> tuple[np.ndarray, float]:
    centre = x.mean(0)
    return centre, float(np.linalg.norm(x - centre, axis=1).max(initial=0.0))


def _roots(placed: DataFrame, scale: float, parts: int) -> DataFrame:
    """``dim, cell, shard, centre, radius`` of every shard's root."""
    def run(batches):
        key, held = None, []

        def out():
            centre, radius = _ball(whole(np.array(held, float).reshape(len(held), key[0]), scale))
            return pa.RecordBatch.from_pylist([{"dim": key[0], "cell": key[1], "shard": key[2], "centre": centre.tolist(), "radius": radius}], schema=ROOT)

        for b in batches:
            for dim, cell, shard, v in zip(*(b.column(c).to_pylist() for c in ("dim", "cell", "shard", "__vec"))):
                if held and (dim, cell, shard) != key:
                    yield out()
                    held = []
                key = (dim, cell, shard)
                held.append(v)
        if held:
            yield out()

    return (placed.select("dim", "cell", "shard", "__vec").repartition(parts, "dim", "shard").sortWithinPartitions("dim", "shard")
            .mapInArrow(run, "dim int, cell int, shard long, centre array<double>, radius double"))


ROOT = pa.schema([("dim", pa.int32()), ("cell", pa.int32()), ("shard", pa.int64()), ("centre", pa.list_(pa.float64())), ("radius", pa.float64())])
BLOCK = pa.schema([("dim", pa.int32()), ("cell", pa.int32()), ("block", pa.int64()), ("centre", pa.list_(pa.float64())), ("radius", pa.float64()),
                   ("floor", pa.float64()), ("data", pa.binary())])


def _blocks(queries: DataFrame, scale: float, parts: int) -> DataFrame:
    """Queries (``__row, __id, __vec, dim, cell, s, w``) as blobs of up to BLOCK_ROWS rows of one cell, with
    the ball around them; s and w are the k-th score so far and its id."""
    keyed = queries.select("dim", "cell", F.pmod(F.xxhash64("__row"), F.lit(parts)).alias("sub"), "__row", "__id", "__vec",
                           F.coalesce("s", F.lit(LOWEST)).alias("s"), F.coalesce("w", F.lit(NO_ID)).alias("w"))

    def run(batches):
        from pyspark import TaskContext

        block, key, held = TaskContext.get().partitionId() << 32, None, []

        def out():
            x = whole(np.array([r[2] for r in held], float).reshape(len(held), key[0]), scale)
            longs = np.array([[r[0] for r in held], [NULL_ID if r[1] is None else r[1] for r in held], [r[3] for r in held],
                              [r[4] for r in held]], np.int64)
            centre, radius = _ball(x)
            return pa.RecordBatch.from_pylist([{
                "dim": key[0], "cell": key[1], "block": block, "centre": centre.tolist(), "radius": radius, "floor": float(longs[2].min()),
                "data": longs.tobytes() + x.tobytes()}], schema=BLOCK)

        for b in batches:
            for dim, cell, *row in zip(*(b.column(c).to_pylist() for c in ("dim", "cell", "__row", "__id", "__vec", "s", "w"))):
                if held and ((dim, cell) != key or len(held) == BLOCK_ROWS):
                    yield out()
                    block, held = block + 1, []
                key = (dim, cell)
                held.append(row)
        if held:
            yield out()

    return (keyed.repartition(parts, "dim", "cell", "sub").sortWithinPartitions("dim", "cell", "sub", "__row")
            .mapInArrow(run, "dim int, cell int, block long, centre array<double>, radius double, floor double, data binary"))


def visits(roots: DataFrame, blocks: DataFrame) -> DataFrame:
    """``dim, shard, block``: the shards but its home whose root may hold a score that beats a k-th score of the block.

    With queries in a ball (c, r) and rows in a ball (d, t), no inner product exceeds c.d + |c| t + |d| r + r t.
    """
    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)

    a = blocks.select("dim", "block", "home", "floor", F.col("centre").alias("c"), F.col("radius").alias("r"),
                      F.sqrt(dot("centre", "centre")).alias("cn"), F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))).alias("slot"))
    b = roots.select("dim", "shard", F.col("centre").alias("d"), F.col("radius").alias("t"), F.sqrt(dot("centre", "centre")).alias("dn"),
                     F.pmod("shard", F.lit(SLOTS)).cast("int").alias("slot"))
    most = dot("c", "d") + F.col("cn") * F.col("t") + F.col("dn") * F.col("r") + F.col("r") * F.col("t")
    size = (F.col("cn") + F.col("r")) * (F.col("dn") + F.col("t"))
    return a.join(b, ["dim", "slot"]).filter(F.col("shard") != F.col("home")).filter(F.least(most + size * 1e-9 + 1.0, F.lit(float(1 << 63))) >= F.col("floor")) \
        .select("dim", "shard", "block")


def _search(placed: DataFrame, blocks: DataFrame, pairs: DataFrame, k: int, scale: float, parts: int) -> DataFrame:
    """Every block through the trees of the shards that it visits."""
    null = {c: F.lit(None).cast(t).alias(c) for c, t in (("__row", "long"), ("__id", "long"), ("__vec", "array<double>"), ("data", "binary"))}
    wanted = placed.join(pairs.select("dim", "shard").distinct(), ["dim", "shard"], "left_semi")
    own = wanted.select("dim", "shard", F.lit(0).alias("kind"), "__row", "__id", "__vec", null["data"])
    guests = pairs.join(blocks.select("block", "data"), "block").select(
        "dim", "shard", F.lit(1).alias("kind"), F.col("block").alias("__row"), null["__id"], null["__vec"], "data")

    def run(batches):
        key, held, tree = None, [], None
        for b in batches:
            for dim, shard, kind, row, i, v, data in zip(*(b.column(c).to_pylist() for c in ("dim", "shard", "kind", "__row", "__id", "__vec", "data"))):
                if (dim, shard) != key:
                    key, held, tree = (dim, shard), [], None
                if kind == 0:
                    held.append((NULL_ID if i is None else i, row, v))
                    continue
                if tree is None:
                    x = whole(np.array([h[2] for h in held], np.float64).reshape(len(held), dim), scale)
                    tree = BallTree(np.array([h[0] for h in held], np.int64), x, np.array([h[1] for h in held], np.int64))
                    held = []
                n = len(data) // (8 * (4 + dim))
                places, ids, floor, floor_id = np.frombuffer(data, np.int64, 4 * n).reshape(4, n)
                s, w = tree.search(places, np.frombuffer(data, np.float64, n * dim, 32 * n).reshape(n, dim), k, floor, floor_id)
                got = w != NO_ID
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(places, k)[got.ravel()]), _with_nulls(np.repeat(ids, k)[got.ravel()]), _with_nulls(w[got]), pa.array(s[got])],
                    names=["q", "query_id", "vec_id", "score"])

    return (own.unionByName(guests).repartition(parts, "dim", "shard").sortWithinPartitions("dim", "shard", "kind", "__row")
            .mapInArrow(run, RESULT))


def _with_nulls(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NULL_ID)


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("q").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def search(vectors: DataFrame, query_filter, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
           scale: float = 256.0) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k rows with the largest integer inner
    product with each query row, ties to the smaller id (null ids last), all rows if there are fewer.

    Components become floor(scale * x).  ``query_filter`` is a condition on
    ``__id``; a null id never meets it, but its row is a candidate.  Rows of other vector lengths
    than the query's are no candidates; a query's own row is none.  Rows that repeat an
    id are rows of their own, as queries and as candidates.  What takes part is told in ``participants``.
    """
    spark = ready(vectors.sparkSession)
    rows = participants(vectors, id_col, vec_col)
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(query_filter).alias("q")).first()
    spread = max(1, math.ceil(size["n"] / (REFERENCES * SHARD_ROWS)))
    parts = max(shuffle_parts(spark), 2 * REFERENCES * spread)
    groups = max(1, math.ceil(size["q"] / (REFERENCES * BLOCK_ROWS)))
    placed = _placed(rows, reference_directions(rows, scale), scale, spread).checkpoint()
    roots = _roots(placed, scale, parts).checkpoint()
    queries = placed.filter(query_filter & F.col("__id").isNotNull()).select("__row", "__id", "__vec", "dim", "cell")
    fresh = _blocks(queries.withColumns({"s": F.lit(None).cast("long"), "w": F.lit(None).cast("long")}), scale, groups).checkpoint()
    homes = roots.groupBy("dim", "cell").agg(F.min("shard").alias("home"))
    home = fresh.select("dim", "cell", "block").join(homes, ["dim", "cell"]).select("dim", F.col("home").alias("shard"), "block")
    first = _best(_search(placed, fresh, home, k, scale, parts), k).checkpoint()
    # the k-th score of each query goes with its block to every other shard that may beat it
    kth = first.filter(F.col("rank") == k).select(F.col("q").alias("__row"), F.col("score").alias("s"), F.coalesce("vec_id", F.lit(NULL_ID)).alias("w"))
    again = _blocks(queries.join(kth, "__row", "left"), scale, groups).join(homes, ["dim", "cell"]).checkpoint()
    found = _best(first.drop("rank").unionByName(_search(placed, again, visits(roots, again), k, scale, parts)), k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
