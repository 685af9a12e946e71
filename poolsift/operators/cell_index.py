"""A persisted vector index of cells with upkeep, and filtered search in bound order.

A cell holds the rows nearest to its centre; its radius is the distance of the farthest
one.  For a query, the distance to the centre less the radius bounds the distance to all
rows of the cell from below, so cells are probed in the order of these bounds.

The index is a folder that driver and executors share::

    segments/version=<v>/cell=<c>/    rows (uid, vec) written by version v
    deletes/version=<v>/              uids that version v took out of earlier segments
    manifest/version=<v>/             one row per cell: centre, radius, rows, segments, deletes

Every change writes its rows first and a new manifest last; Spark's ``_SUCCESS`` file
commits it.  Readers name a version and see its segments only, whatever is written
meanwhile; a change that died before its manifest is overwritten by the next one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import as_doubles
from ..session import committed, cut_lineage
from .anchors import lloyd
from .sampling import hash_top_n
from .similarity import (CANDIDATE_SCHEMA, DEFAULT_BROADCAST_BYTES, _global_topk, _local_topk, _matrix, _query_block,
                         _within, build_ivf)

MARGIN = 1e-9                 # by which bounds are widened against rounding
MANIFEST = ("cell long, center array<double>, radius double, n long, segments array<int>, deletes array<int>, metric string")


def _unit(x: np.ndarray, metric: str) -> np.ndarray:
    if metric != "cosine":
        return x
    n = np.linalg.norm(x, axis=1)
    return x / np.where(n > 0, n, 1.0)[:, None]


class CellIndex:
    """Cells of one folder at one version; changes return the index at the next version."""

    def __init__(self, spark: SparkSession, folder: str, version: int | None = None):
        self.spark, self.folder = spark, folder.rstrip("/")
        if version is None:
            version = -1
            while committed(spark, self._path("manifest", version + 1)):
                version += 1
        if version < 0 or not committed(spark, self._path("manifest", version)):
            raise ValueError(f"{self.folder} has no such version of an index")
        self.version = version
        # one row per cell: the model of the index
        self.cells = {r["cell"]: r for r in spark.read.parquet(self._path("manifest", version)).collect()}
        self.metric = next(iter(self.cells.values()))["metric"] if self.cells else "cosine"

    def _path(self, kind: str, version: int) -> str:
        return f"{self.folder}/{kind}/version={version}"

    # ------------------------------------------------------------ writing

    @classmethod
    def create(cls, rows: DataFrame, folder: str, n_cells: int = 16, metric: str = "cosine", seed: int = 42, uid: str = "uid",
               vec: str = "embedding") -> CellIndex:
        """k-means cells of all rows; rows with a null vector are left out.  Refuses a folder that holds an index."""
        spark = rows.sparkSession
        folder = folder.rstrip("/")
        if metric not in ("cosine", "l2"):
            raise ValueError(f"no distance bounds for metric {metric}")
        if committed(spark, f"{folder}/manifest/version=0"):
            raise ValueError(f"{folder} holds an index")
        cells, centres, _ = build_ivf(rows, n_cells, seed, uid, vec, metric)
        cells.write.mode("overwrite").partitionBy("cell").parquet(f"{folder}/segments/version=0")
        empty = {i: dict(cell=i, center=[float(x) for x in c], radius=0.0, n=0, segments=[], deletes=[], metric=metric)
                 for i, c in enumerate(centres)}
        return cls._commit(spark, folder, 0, cls._grown(spark, folder, 0, empty, metric))

    @staticmethod
    def _grown(spark, folder: str, version: int, cells: dict, metric: str) -> dict:
        """The cells with counts and radii of the segment that a version wrote."""
        centres = {c: np.array(r["center"]) for c, r in cells.items()}

        def far(batches):
            most: dict = {}
            for b in batches:
                x = _unit(_matrix(b.column("vec")), metric) if b.num_rows else np.empty((0, 0))
                at = b.column("cell").to_numpy(zero_copy_only=False)
                for c in np.unique(at).tolist():
                    d = np.linalg.norm(x[at == c] - centres[c], axis=1)
                    n, r = most.get(c, (0, 0.0))
                    most[c] = (n + len(d), max(r, float(d.max())))
            yield pa.RecordBatch.from_arrays([pa.array(list(most), pa.int64()), pa.array([v[0] for v in most.values()], pa.int64()),
                                              pa.array([v[1] for v in most.values()], pa.float64())], names=["cell", "n", "radius"])

        written = spark.read.parquet(f"{folder}/segments/version={version}").select("vec", F.col("cell").cast("long").alias("cell"))
        sizes = written.mapInArrow(far, "cell long, n long, radius double").groupBy("cell").agg(
            F.sum("n").alias("n"), F.max("radius").alias("radius")).collect()
        for r in sizes:
            c = cells[r["cell"]]
            cells[r["cell"]] = {**c, "n": c["n"] + r["n"], "radius": max(c["radius"], r["radius"]), "segments": [*c["segments"], version]}
        return cells

    @classmethod
    def _commit(cls, spark, folder: str, version: int, cells: dict) -> CellIndex:
        rows = [tuple(c[k.split()[0]] for k in MANIFEST.split(", ")) for c in cells.values()]
        spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest/version={version}")
        return cls(spark, folder, version)

    def _state(self) -> dict:
        return {c: r.asDict() for c, r in self.cells.items()}

    def append(self, rows: DataFrame, uid: str = "uid", vec: str = "embedding") -> CellIndex:
        """Rows with new ids go to their nearest cells; centres stay, radii and counts grow."""
        ids = sorted(self.cells)
        centres, metric = np.array([self.cells[c]["center"] for c in ids]), self.metric
        numbers = np.array(ids, np.int64)

        def assign(batches):
            for b in batches:
                if b.num_rows:
                    x = _unit(_matrix(b.column("vec")), metric)
                    near = ((centres * centres).sum(1)[None, :] - 2.0 * (x @ centres.T)).argmin(1)
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(numbers[near])], names=["uid", "vec", "cell"])

        new = rows.select(F.col(uid).cast("long").alias("uid"), as_doubles(vec).alias("vec")).filter(F.col("vec").isNotNull())
        v = self.version + 1
        new.mapInArrow(assign, "uid long, vec array<double>, cell long").write.mode("overwrite").partitionBy("cell") \
            .parquet(self._path("segments", v))
        if not new.limit(1).count():
            return self._commit(self.spark, self.folder, v, self._state())
        return self._commit(self.spark, self.folder, v, self._grown(self.spark, self.folder, v, self._state(), metric))

    def delete(self, ids: DataFrame, uid: str = "uid") -> CellIndex:
        """Takes rows out by id; ids that the index lacks change nothing.  A deleted id may be appended again."""
        v = self.version + 1
        ids.select(F.col(uid).cast("long").alias("uid")).distinct().write.mode("overwrite").parquet(self._path("deletes", v))
        gone = self.spark.read.parquet(self._path("deletes", v))
        lost = self.rows().join(gone, "uid", "left_semi").groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()
        lost = {r["cell"]: r["n"] for r in lost}
        cells = {c: {**r, "n": r["n"] - lost.get(c, 0), "deletes": [*r["deletes"], v]} for c, r in self._state().items()}
        return self._commit(self.spark, self.folder, v, cells)

    def split(self, most_rows: int, seed: int = 42) -> CellIndex:
        """Every cell of more than ``most_rows`` rows becomes two, by k-means of its rows."""
        large = sorted(c for c, r in self.cells.items() if r["n"] > most_rows)
        if not large:
            return self
        v, metric, first = self.version + 1, self.metric, max(self.cells) + 1
        rows = cut_lineage(self.rows(large))
        halves = lloyd(rows, 2, by=["cell"], seed=seed)
        place = F.create_map(*[x for i, c in enumerate(large) for x in (F.lit(c).cast("long"), F.lit(i))])
        number = F.lit(first) + 2 * F.try_element_at(place, F.col("cell")) + F.col("cluster")
        moved = cut_lineage(rows.join(halves, ["cell", "uid"]).select("uid", "vec", number.cast("long").alias("cell")))
        moved.write.mode("overwrite").partitionBy("cell").parquet(self._path("segments", v))
        unit = moved.select("cell", F.posexplode("vec").alias("pos", "x")) if metric != "cosine" else moved.select("cell", F.posexplode(
            F.transform("vec", lambda x: x / F.greatest(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, y: s + y * y)), F.lit(1e-300)))).alias("pos", "x"))
        means: dict = {}
        for r in unit.groupBy("cell", "pos").agg(F.avg("x").alias("m")).collect():       # two centres for each cell that is split
            means.setdefault(r["cell"], {})[r["pos"]] = r["m"]
        state = {c: r for c, r in self._state().items() if c not in large}
        deletes = self.cells[large[0]]["deletes"]
        fresh = {c: dict(cell=c, center=[m[i] for i in range(len(m))], radius=0.0, n=0, segments=[], deletes=list(deletes), metric=metric)
                 for c, m in means.items()}
        return self._commit(self.spark, self.folder, v, self._grown(self.spark, self.folder, v, {**state, **fresh}, metric))

    # ------------------------------------------------------------ reading

    def rows(self, cells: list | None = None) -> DataFrame:
        """``uid, vec, cell`` of some cells (or all) at this version; other cells' folders are not read."""
        wanted = [self.cells[c] for c in (sorted(self.cells) if cells is None else cells)]
        out = None
        for v in sorted({s for r in wanted for s in r["segments"]}):
            here = [r["cell"] for r in wanted if v in r["segments"]]
            part = self.spark.read.parquet(self._path("segments", v)).filter(F.col("cell").isin(here)) \
                .select("uid", "vec", F.col("cell").cast("long").alias("cell"))
            later = sorted({d for r in wanted for d in r["deletes"] if d > v})
            if later:
                part = part.join(self.spark.read.parquet(*[self._path("deletes", d) for d in later]).select("uid").distinct(), "uid", "left_anti")
            out = part if out is None else out.unionByName(part)
        return out if out is not None else self.spark.createDataFrame([], "uid long, vec array<double>, cell long")

    def _bounds(self, q: np.ndarray) -> tuple[list, np.ndarray, np.ndarray]:
        """Cells and, per query, a lower bound of the distance to all of a cell's rows, and the cells'
        order by it (of equal bounds, as where a query lies inside several cells, the nearer centre first)."""
        ids = sorted(self.cells)
        centres = np.array([self.cells[c]["center"] for c in ids])
        radius = np.array([self.cells[c]["radius"] for c in ids])
        q = _unit(q, self.metric)
        away = np.sqrt(np.maximum((q * q).sum(1)[:, None] + (centres * centres).sum(1)[None, :] - 2.0 * (q @ centres.T), 0.0))
        # (a zero vector has cosine distance 1, which lies above every such bound)
        gap = np.maximum(away - radius[None, :] - MARGIN, 0.0)
        bound = gap * gap * (0.5 if self.metric == "cosine" else 1.0) - MARGIN
        return ids, bound, np.lexsort((away, bound), axis=1)

    def _probe(self, q: tuple, ids: list, probes: np.ndarray, k: int, mask: DataFrame | None) -> DataFrame:
        table = np.zeros((len(q[0]), max(ids) + 1), bool)
        table[:, ids] = probes
        sc = self.spark.sparkContext
        rows = self.rows([c for c, p in zip(ids, probes.any(0)) if p])
        if mask is not None:
            rows = rows.join(mask, "uid", "left_anti")
        found = rows.select("uid", "vec", "cell").mapInArrow(
            _local_topk(sc.broadcast(q), k, self.metric, probe=sc.broadcast(table)), CANDIDATE_SCHEMA)
        return cut_lineage(_global_topk(found, k, 64, sc.defaultParallelism))

    def search(self, queries: DataFrame, k: int = 50, mask: DataFrame | None = None, n_probe: int | None = None, uid: str = "uid",
               vec: str = "embedding", max_broadcast_bytes: int = DEFAULT_BROADCAST_BYTES, probed: list | None = None) -> DataFrame:
        """The k nearest allowed rows of each query: ``search_query_uid, uid, dists``; always min(k, allowed) rows.

        ``mask``: ids that are not allowed (labelled rows).  A query first probes cells in
        bound order until they hold k allowed rows.  Then, without ``n_probe``, it
        probes every further cell whose bound does not exceed its k-th distance,
        which makes the answer exact; with ``n_probe`` only those among its first ``n_probe`` cells
        (``probes_for`` finds the number for a recall).  ``probed`` collects cells probed per query.
        Null query vectors find nothing.
        """
        spark = self.spark
        mask = None if mask is None else cut_lineage(mask.select(F.col(uid).cast("long").alias("uid")).distinct())
        allowed = {c: r["n"] for c, r in self.cells.items()}
        if mask is not None:
            for r in self.rows().join(mask, "uid", "left_semi").groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():
                allowed[r["cell"]] -= r["n"]
        asked = cut_lineage(queries.select(F.col(uid).cast("long").alias(uid), as_doubles(vec).alias(vec)).filter(F.col(vec).isNotNull()))
        size = asked.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vec)).alias("d")).first()
        per_query = 8 * (size["d"] or 1) + len(self.cells) + 16 * k
        chunks = max(1, -(-(size["n"] or 0) * per_query // max_broadcast_bytes))
        out = spark.createDataFrame([], CANDIDATE_SCHEMA)
        if not size["n"] or not self.cells:
            return out
        # one block of queries after the other: each is answered and written before the next is sent out
        for c in range(chunks):
            part = asked if chunks == 1 else asked.filter(F.pmod(F.xxhash64(uid), F.lit(chunks)) == c)
            for block in _within(*_query_block(part, uid, vec, self.metric), per_query, max_broadcast_bytes):
                if len(block[0]):
                    out = out.unionByName(self._answer(block, k, allowed, mask, n_probe, probed))
        return out

    def _answer(self, block, k, allowed, mask, n_probe, probed) -> DataFrame:
        qids, q = block
        ids, bound, order = self._bounds(q)
        held = np.array([allowed[c] for c in ids])
        # in bound order: cells before which fewer than k allowed rows lie
        before = np.cumsum(held[order], axis=1) - held[order]
        first = np.zeros(bound.shape, bool)
        np.put_along_axis(first, order, before < k, axis=1)
        first &= held[None, :] > 0
        found = self._probe(block, ids, first, k, mask)
        kth = {r["search_query_uid"]: r["d"] for r in found.groupBy("search_query_uid").agg(
            F.max("dists").alias("d"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k).collect()}
        last = np.array([kth.get(int(i), np.inf) for i in qids])
        more = (bound <= last[:, None]) & ~first & (held[None, :] > 0)
        if n_probe is not None:
            near = np.zeros(bound.shape, bool)
            np.put_along_axis(near, order[:, :n_probe], True, axis=1)
            more &= near
        if probed is not None:
            probed += (first | more).sum(1).tolist()
        if more.any():
            found = found.unionByName(self._probe(block, ids, more, k, mask))
            found = cut_lineage(_global_topk(found, k, 64, 1))
        return found

    def probes_for(self, recall: float, k: int = 50, sample: int = 256, seed: int = 42) -> int:
        """How many cells in bound order hold ``recall`` of the true neighbours, on a bounded sample of rows as queries."""
        rows = cut_lineage(hash_top_n(self.rows().select("uid", F.col("vec").alias("embedding")), sample, uid="uid", seed=seed))
        # (a row is its own nearest neighbour, which says nothing about other queries)
        true = self.search(rows, k + 1).filter(F.col("uid") != F.col("search_query_uid"))
        cell_of = self.rows().select("uid", "cell")
        where = true.join(cell_of, "uid").groupBy("search_query_uid", "cell").agg(F.count(F.lit(1)).alias("n")).collect()
        qids, q = _query_block(rows, "uid", "embedding", self.metric)
        ids, _, order = self._bounds(q)
        rank = np.argsort(order, axis=1, kind="stable")
        at, col = {int(u): i for i, u in enumerate(qids)}, {c: i for i, c in enumerate(ids)}
        hits = np.zeros(len(ids), np.int64)
        for r in where:
            hits[rank[at[r["search_query_uid"]], col[r["cell"]]]] += r["n"]
        share = np.cumsum(hits) / max(1, hits.sum())
        return int(min(np.searchsorted(share, recall) + 1, len(ids))) if len(ids) else 0

