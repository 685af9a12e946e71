"""Connected components of a distributed edge list: contraction inside tasks, alternating stars between them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


EDGES_A_TASK = 1_000_000
HELD_NODES = 2_000_000       # edges that one task holds as arrays; beyond, they are contracted, and passed on if that leaves over half


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the edges but the smallest of its component, and that smallest node."""
    node, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[:len(u)], at[len(u):]
    up = np.arange(len(node))
    while len(a):
        # a and b are roots: the larger one is hung under the smallest it meets, then all paths are flattened
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up, flat := up[up]):
            up = flat
        a, b = up[a], up[b]
        apart = a != b
        a, b = a[apart], b[apart]
    below = np.nonzero(up != np.arange(len(node)))[0]
    return node[below], node[up[below]]


def _contracted(edges: DataFrame) -> DataFrame:
    """The same components with fewer edges: each task links the nodes of its edges to the smallest in reach."""
    def run(batches):
        held, n = [], 0

        def linked():
            return forest(*(np.concatenate([np.empty(0, np.int64), *(h[k] for h in held)]) for k in (0, 1)))

        def out(pair):
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in pair], names=["u", "v"])

        for b in batches:
            held.append(tuple(b.column(c).to_numpy(zero_copy_only=False) for c in ("u", "v")))
            n += b.num_rows
            if n > HELD_NODES:
                held = [linked()]
                n = len(held[0][0])
                if n > HELD_NODES // 2:
                    yield out(held[0])
                    held, n = [], 0
        yield out(linked())

    return edges.select("u", "v").mapInArrow(run, "u long, v long")


def _to_smallest(edges: DataFrame, larger_only: bool, tasks: int) -> DataFrame:
    """Links each node's neighbours to the smallest of them and itself.

    ``larger_only`` (large star): all neighbours count, those above the node are
    linked anew.  Otherwise (small star): only neighbours below the node count.
    """
    if larger_only:
        edges = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    # a written table, so that the join below can split a hub's edges over tasks
    smallest = edges.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks).checkpoint()
    if larger_only:
        joined = edges.filter("v > u").join(smallest, "u")
        out = joined.select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    else:
        out = edges.join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .unionByName(smallest.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of ``edges`` (``u``, ``v``); the component is its smallest node.

    Loops and nulls in edges are ignored, repeated edges count once; a node that
    only has a loop gets no row.  Every round first contracts the edges inside the
    tasks that hold them.  When one task holds all that is left, that is the result;
    star steps follow only when contraction no longer halves what is left.  Raises if the rounds do
    not suffice (they grow with the logarithm of the longest path).
    """
    # (written first: a task that made the edges in Python and contracted them too would take two workers)
    edges = edges.filter("u <> v").select("u", "v").checkpoint()
    # a small graph is worked on by few tasks, however many partitions the session shuffles into
    n = edges.coalesce(edges.sparkSession.sparkContext.defaultParallelism).count()
    for _ in range(most_rounds):
        tasks = max(1, -(-n // EDGES_A_TASK))
        edges = _contracted(edges.coalesce(tasks)).checkpoint()
        if tasks == 1:
            break
        before = _print_of(edges)
        left = before[0]
        if left > max(EDGES_A_TASK, n // 2):
            edges = _to_smallest(_to_smallest(edges, True, tasks), False, tasks).coalesce(tasks).checkpoint()
            # equal counts and sums of two hashes: the edge list no longer changes
            after = _print_of(edges)
            if after == before:
                break
            left = after[0]
        n = left
    else:
        raise RuntimeError("components: the graph did not settle")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(nodes.select(F.col("component").alias("node"), "component").distinct())


def _print_of(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.sum(F.hash("v", "u").cast("long"))).first()
