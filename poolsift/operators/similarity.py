"""Nearest-neighbour search of query vectors in a large pool.

Exact kNN (``knn_join``): the query block (anchors, labelled rows: tens to a
few thousand rows) is size-checked and broadcast; the pool is never
shuffled.  Each pool partition runs a numpy matmul per Arrow batch
(``mapInArrow``: vectors go from the Arrow buffer to a 2-D array with no
per-row Python objects) and keeps only its local top-k per query, so the
only shuffle carries ``partitions x queries x k`` rows.  A final ``row_number() <= k`` per query
(with a salted intermediate level when there are many partitions) gives the
global answer.  Query sets over the broadcast budget (vectors and the workers'
top-k state together) are processed in hash-split chunks, each one exact.

One rule for odd vectors everywhere: a NULL vector never matches and finds
nothing; a vector of norm zero has cosine distance 1 to every other.

Approximate kNN (``build_ivf`` / ``ivf_knn``): MLlib KMeans cells (on unit
vectors for cosine), fitted on all rows; the cell table is written once
partitioned by cell (``write_ivf``) and each query only scores the pool rows
of its ``n_probe`` nearest cells.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import as_doubles
from ..session import cut_lineage
from .sampling import hash_top_n

CANDIDATE_SCHEMA = "search_query_uid long, uid long, dists double"
DEFAULT_BROADCAST_BYTES = 64 << 20
# elements of one distance block (queries x pool rows) held at a time
BLOCK_ELEMENTS = 4_000_000


def _distances(Q: np.ndarray, P: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        pn = np.linalg.norm(P, axis=1)
        pn[pn == 0] = 1.0
        return 1.0 - Q @ (P / pn[:, None]).T
    if metric == "ip":
        return 1.0 - Q @ P.T
    if metric == "l2":  # squared euclidean, as an HNSW "l2" space reports
        q2 = (Q * Q).sum(axis=1)[:, None]
        p2 = (P * P).sum(axis=1)[None, :]
        return np.maximum(q2 + p2 - 2.0 * (Q @ P.T), 0.0)
    raise ValueError(f"unknown metric {metric}")


def _topk_rows(D: np.ndarray, U: np.ndarray, k: int):
    """Per row, the k smallest (distance, uid) pairs; exact under ties."""
    m = D.shape[1]
    if m <= k:
        order = np.lexsort((U, D), axis=1)
        return np.take_along_axis(D, order, 1), np.take_along_axis(U, order, 1)
    part = np.argpartition(D, k - 1, axis=1)[:, :k]
    Dk = np.take_along_axis(D, part, 1)
    Uk = np.take_along_axis(U, part, 1)
    thr = Dk.max(axis=1)
    # rows whose k-th distance is tied with a row left out (duplicate vectors):
    # order only the candidates at or below the threshold by (distance, uid)
    for i in np.nonzero((D <= thr[:, None]).sum(axis=1) > k)[0]:
        cand = np.nonzero(D[i] <= thr[i])[0]
        order = cand[np.lexsort((U[i, cand], D[i, cand]))[:k]]
        Dk[i], Uk[i] = D[i, order], U[i, order]
    return Dk, Uk


def _matrix(col: pa.Array) -> np.ndarray:
    """list<double> Arrow column -> (rows, dim) float64 array without Python objects."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    n = len(col)
    if n == 0:
        return np.empty((0, 0))
    offsets = col.offsets.to_numpy()
    lengths = np.diff(offsets)
    if col.null_count == 0 and (lengths == lengths[0]).all():
        values = col.values.slice(offsets[0], offsets[-1] - offsets[0]).to_numpy(zero_copy_only=False)
        return values.astype(np.float64, copy=False).reshape(n, int(lengths[0]))
    return np.vstack([np.asarray(v, dtype=np.float64) for v in col.to_pylist()])


def _local_topk(bc, k: int, metric: str, probe=None):
    """mapInArrow body: running top-k per query over one pool partition.

    With ``probe`` (IVF), each block is split by cell and only the queries
    that probe a cell are scored against its rows.
    """

    def run(batches):
        qids, Q = bc.value
        probes = probe.value if probe is not None else None
        nq = len(qids)
        best_d = np.full((nq, k), np.inf)
        best_u = np.full((nq, k), np.iinfo(np.int64).max, dtype=np.int64)
        step = max(1, BLOCK_ELEMENTS // max(nq, 1))

        def merge(qi, D, u):
            U = np.broadcast_to(u, D.shape)
            d, uu = _topk_rows(np.hstack([best_d[qi], D]), np.hstack([best_u[qi], U]), k)
            best_d[qi], best_u[qi] = d, uu

        for rb in batches:
            if rb.num_rows == 0:
                continue
            P_all = _matrix(rb.column("vec"))
            u_all = rb.column("uid").to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
            c_all = rb.column("cell").to_numpy(zero_copy_only=False) if probes is not None else None
            for lo in range(0, rb.num_rows, step):
                P, u = P_all[lo:lo + step], u_all[lo:lo + step]
                if probes is None:
                    merge(slice(None), _distances(Q, P, metric), u)
                    continue
                cells = c_all[lo:lo + step]
                for c in np.unique(cells):
                    qi = np.nonzero(probes[:, c])[0]
                    if len(qi):
                        rows = cells == c
                        merge(qi, _distances(Q[qi], P[rows], metric), u[rows])
        keep = np.isfinite(best_d)
        if not keep.any():
            return
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(qids, k)[keep.ravel()], pa.int64()), pa.array(best_u[keep], pa.int64()),
             pa.array(best_d[keep], pa.float64())], names=["search_query_uid", "uid", "dists"])

    return run


def _query_block(queries: DataFrame, id_col: str, vec_col: str, metric: str):
    rows = queries.select(F.col(id_col).cast("long").alias("qid"), as_doubles(vec_col).alias("vec")).collect()
    qids = np.array([r["qid"] for r in rows], dtype=np.int64)
    Q = np.array([r["vec"] for r in rows], dtype=np.float64)
    if metric == "cosine" and len(rows):
        qn = np.linalg.norm(Q, axis=1)
        qn[qn == 0] = 1.0
        Q = Q / qn[:, None]
    return qids, Q


def _within(qids: np.ndarray, Q: np.ndarray, per_query: int, most: int):
    """The block in parts that keep to the budget, should a chunk have come out larger."""
    rows = max(1, most // per_query)
    for lo in range(0, len(qids), rows):
        yield qids[lo:lo + rows], Q[lo:lo + rows]


def _global_topk(cands: DataFrame, k: int, fan_in: int, n_parts: int) -> DataFrame:
    order = [F.col("dists"), F.col("uid")]
    if n_parts > fan_in:
        # two-level tree: no single task sees more than ~fan_in x k rows per query
        salt = F.pmod(F.xxhash64("uid"), F.lit(int(math.ceil(math.sqrt(n_parts)))))
        w1 = Window.partitionBy("search_query_uid", "__salt").orderBy(*order)
        cands = (cands.withColumn("__salt", salt).withColumn("__r", F.row_number().over(w1))
                      .filter(F.col("__r") <= k).drop("__salt", "__r"))
    w = Window.partitionBy("search_query_uid").orderBy(*order)
    return cands.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= k).drop("__r")


def _released(found: DataFrame, *sent) -> DataFrame:
    """The answer of one chunk of queries, written before the next chunk is fetched; what was broadcast for it goes."""
    found = cut_lineage(found)
    for bc in sent:
        bc.unpersist()
    return found


def knn_join(queries: DataFrame, pool: DataFrame, k: int = 50, metric: str = "cosine",
             id_col: str = "uid", vec_col: str = "embedding", max_search_size: int | None = None,
             seed=42, max_broadcast_bytes: int = DEFAULT_BROADCAST_BYTES, fan_in: int = 64) -> DataFrame:
    """Exact k nearest pool rows per query -> (search_query_uid, uid, dists)."""
    spark = pool.sparkSession
    pool_sel = pool.select(F.col(id_col).cast("long").alias("uid"), F.col(vec_col).alias("vec")).filter(F.col("vec").isNotNull())
    if max_search_size is not None:
        pool_sel = hash_top_n(pool_sel, int(max_search_size), uid="uid", seed=seed)
    # the query block is small by contract: materialise it once, size it, then fetch it
    qdf = queries.select(F.col(id_col).cast("long").alias(id_col), F.col(vec_col)).filter(F.col(vec_col).isNotNull()) \
        .persist(StorageLevel.MEMORY_AND_DISK)
    try:
        stats = qdf.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vec_col)).alias("d")).first()
        n_q, dim = int(stats["n"]), int(stats["d"] or 0)
        if n_q == 0:
            return spark.createDataFrame([], CANDIDATE_SCHEMA)
        # a query costs its vector and, in every worker, k distances and ids
        per_query = 8 * max(dim, 1) + 16 * k
        n_chunks = max(1, math.ceil(n_q * per_query / max_broadcast_bytes))
        # cluster parallelism stands in for the pool's partition count (no extra job)
        n_parts = spark.sparkContext.defaultParallelism
        results = []
        for c in range(n_chunks):
            chunk = qdf if n_chunks == 1 else \
                qdf.filter(F.pmod(F.xxhash64(F.col(id_col)), F.lit(n_chunks)) == c)
            for qids, Q in _within(*_query_block(chunk, id_col, vec_col, metric), per_query, max_broadcast_bytes):
                bc = spark.sparkContext.broadcast((qids, Q))
                found = _global_topk(pool_sel.mapInArrow(_local_topk(bc, k, metric), CANDIDATE_SCHEMA), k, fan_in, n_parts)
                results.append(_released(found, bc) if n_chunks > 1 else found)
    finally:
        qdf.unpersist()
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out


def search_stats(candidates: DataFrame) -> DataFrame:
    """Rows retrieved, distinct ids retrieved, distinct queries (one row)."""
    return candidates.agg(F.count(F.lit(1)).alias("ids_retrieved"),
                          F.count_distinct("uid").alias("unique_ids_retrieved"),
                          F.count_distinct("search_query_uid").alias("num_search_queries"))


# ---------------------------------------------------------------- IVF ----

def build_ivf(pool: DataFrame, n_cells: int = 16, seed: int = 42, id_col: str = "uid",
              vec_col: str = "embedding", metric: str = "cosine", max_iter: int = 20):
    """Coarse quantiser (MLlib KMeans on unit vectors) and the cell-assigned pool.

    The quantiser is fitted on all rows with a vector; every one is then assigned in one pass.

    Returns ``(cells, centers, meta)``: ``cells`` is ``uid, vec, cell``
    (write it partitioned by ``cell`` to reuse it across runs), ``centers``
    a (n_cells x dim) numpy array (the small model), ``meta`` a one-row
    DataFrame describing the index.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    length = F.sqrt(F.aggregate(as_doubles(vec_col), F.lit(0.0), lambda s, y: s + y * y))
    unit = F.transform(as_doubles(vec_col), lambda x: F.when(length > 0, x / length).otherwise(x))
    pool = pool.filter(F.col(vec_col).isNotNull())
    base = pool.select(F.col(id_col).cast("long").alias("uid"), as_doubles(vec_col).alias("vec"),
                       array_to_vector(unit if metric == "cosine" else as_doubles(vec_col)).alias("features"))
    train = cut_lineage(base.select("features"))   # the iterations re-read it, not the plan of the pool
    model = KMeans(k=n_cells, seed=seed, maxIter=max_iter, featuresCol="features",
                   predictionCol="cell").fit(train)
    centers = np.array([c for c in model.clusterCenters()], dtype=np.float64)
    # assign every pool row in one Arrow pass: nearest centre (squared euclidean on the
    # training features, first index on ties, as KMeansModel.predict) by one matmul per batch
    bc = pool.sparkSession.sparkContext.broadcast(centers)
    unit_rows = metric == "cosine"

    def assign(batches):
        C = bc.value
        c2 = (C * C).sum(axis=1)
        for rb in batches:
            if rb.num_rows == 0:
                continue
            X = _matrix(rb.column("vec"))
            if unit_rows:
                xn = np.linalg.norm(X, axis=1)
                xn[xn == 0] = 1.0
                X = X / xn[:, None]
            cell = np.argmin(c2[None, :] - 2.0 * (X @ C.T), axis=1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([rb.column("uid"), rb.column("vec"), pa.array(cell, pa.int64())],
                                             names=["uid", "vec", "cell"])

    cells = base.select("uid", "vec").mapInArrow(assign, "uid long, vec array<double>, cell long")
    spark = pool.sparkSession
    meta = spark.createDataFrame(
        [(int(n_cells), int(centers.shape[1]), metric, int(seed), int(max_iter))],
        "n_cells int, dim int, metric string, seed int, max_iter int")
    return cells, centers, meta


def write_ivf(cells: DataFrame, centers: np.ndarray, meta: DataFrame, path: str) -> str:
    """Persist the index: the cell table partitioned by ``cell`` (so a probe reads
    only its cells' directories), the centres and the metadata row."""
    spark = cells.sparkSession
    cells.write.mode("errorifexists").partitionBy("cell").parquet(f"{path}/cells")
    rows = [(int(i), [float(x) for x in c]) for i, c in enumerate(centers)]
    spark.createDataFrame(rows, "cell long, center array<double>").coalesce(1).write.parquet(f"{path}/centers")
    meta.coalesce(1).write.parquet(f"{path}/meta")
    return path


def load_ivf(spark, path: str):
    """Read an index written by ``write_ivf``: (cells, centers, meta)."""
    cen = sorted(spark.read.parquet(f"{path}/centers").collect(), key=lambda r: r["cell"])
    centers = np.array([r["center"] for r in cen], dtype=np.float64)
    return spark.read.parquet(f"{path}/cells"), centers, spark.read.parquet(f"{path}/meta")


def ivf_knn(queries: DataFrame, cells: DataFrame, centers: np.ndarray, k: int = 50, n_probe: int = 4,
            metric: str | None = None, id_col: str = "uid", vec_col: str = "embedding",
            max_broadcast_bytes: int = DEFAULT_BROADCAST_BYTES, meta: DataFrame | None = None) -> DataFrame:
    """Approximate kNN: each query scores only rows of its ``n_probe`` nearest cells.

    Cells are ranked with the metric of the search, which is the one in the
    index's ``meta`` row unless given (cosine without either).

    The query block is measured and broadcast in hash-split chunks under the
    byte budget (as in ``knn_join``); the probe table is queries x cells booleans.
    """
    spark = cells.sparkSession
    sc = spark.sparkContext
    if metric is None:
        metric = meta.first()["metric"] if meta is not None else "cosine"
    qdf = queries.select(F.col(id_col).cast("long").alias(id_col), F.col(vec_col)).filter(F.col(vec_col).isNotNull()) \
        .persist(StorageLevel.MEMORY_AND_DISK)
    try:
        stats = qdf.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vec_col)).alias("d")).first()
        n_q, dim = int(stats["n"]), int(stats["d"] or 0)
        if n_q == 0:
            return spark.createDataFrame([], CANDIDATE_SCHEMA)
        per_query = 8 * max(dim, 1) + len(centers) + 16 * k
        n_chunks = max(1, math.ceil(n_q * per_query / max_broadcast_bytes))
        results = []
        for c in range(n_chunks):
            chunk = qdf if n_chunks == 1 else qdf.filter(F.pmod(F.xxhash64(F.col(id_col)), F.lit(n_chunks)) == c)
            for qids, Q in _within(*_query_block(chunk, id_col, vec_col, metric), per_query, max_broadcast_bytes):
                near = np.argsort(_distances(Q, centers, metric), axis=1, kind="stable")[:, :min(n_probe, len(centers))]
                probes = np.zeros((len(qids), len(centers)), dtype=bool)
                np.put_along_axis(probes, near, True, axis=1)
                bc, pb = sc.broadcast((qids, Q)), sc.broadcast(probes)
                wanted = sorted({int(x) for x in near.ravel()})
                pool_sel = cells.filter(F.col("cell").isin(wanted)).select("uid", "vec", "cell")
                found = _global_topk(pool_sel.mapInArrow(_local_topk(bc, k, metric, probe=pb), CANDIDATE_SCHEMA), k, 64, sc.defaultParallelism)
                results.append(_released(found, bc, pb) if n_chunks > 1 else found)
    finally:
        qdf.unpersist()
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out


def recall_at_k(approx: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of exact neighbours the approximate search also returned (one row)."""
    found = approx.select("search_query_uid", "uid").withColumn("__hit", F.lit(1))
    marked = exact.join(found, ["search_query_uid", "uid"], "left")
    return marked.agg((F.sum(F.coalesce("__hit", F.lit(0))) / F.count(F.lit(1))).alias("recall"),
                      F.sum(F.coalesce("__hit", F.lit(0))).alias("hits"),
                      F.count(F.lit(1)).alias("total"))
