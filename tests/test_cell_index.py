"""The cell index against plain search: masks, probes, upkeep, versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from poolsift.operators.cell_index import CellIndex
from poolsift.session import shared_path

SCHEMA = "uid long, embedding array<double>"


def clustered(n, dim, seed, start=0, spread=0.15):
    rng = np.random.default_rng(seed)
    v = np.eye(dim)[rng.integers(0, dim, n)] + rng.normal(0, spread, (n, dim))
    return [(start + i, [float(x) for x in r]) for i, r in enumerate(v)]


def plain(queries, rows, k, metric="cosine"):
    out = []
    for q, v in queries:
        v = np.array(v)
        def dist(w):
            w = np.array(w)
            if metric == "l2":
                return float(((v - w) ** 2).sum())
            n = np.linalg.norm(v) * np.linalg.norm(w)
            return 1.0 - float(v @ w) / n if n else 1.0
        out += [(q, u) for _, u in sorted((round(dist(w), 10), u) for u, w in rows)[:k]]
    return sorted(out)


def pairs(found):
    return sorted((r.search_query_uid, r.uid) for r in found.collect())


@pytest.fixture(scope="module")
def data(spark):
    rows, queries = clustered(600, 6, 1), clustered(25, 6, 2, start=10_000)
    index = CellIndex.create(spark.createDataFrame(rows, SCHEMA).repartition(3), shared_path(spark, "cells"), n_cells=12)
    return rows, queries, index


def test_certain_search_is_exact_and_probes_few_cells(spark, data):
    rows, queries, index = data
    probed = []
    got = index.search(spark.createDataFrame(queries, SCHEMA), 5, probed=probed)
    assert pairs(got) == plain(queries, rows, 5)
    assert np.mean(probed) < len(index.cells) - 2
    chunked = index.search(spark.createDataFrame(queries, SCHEMA), 5, max_broadcast_bytes=1000)
    assert pairs(chunked) == pairs(got)


def test_masked_rows_never_show_and_k_rows_always_do(spark, data):
    rows, queries, index = data
    q = queries[:6]
    near = plain(q, rows, 80)
    masked = {u for _, u in near}                            # the whole neighbourhood of each query is labelled
    mask = spark.createDataFrame([(u,) for u in masked], "uid long")
    left = [r for r in rows if r[0] not in masked]
    qdf = spark.createDataFrame(q, SCHEMA)
    assert pairs(index.search(qdf, 7, mask=mask)) == plain(q, left, 7)
    few = index.search(qdf, 7, mask=mask, n_probe=1)
    assert few.count() == 6 * 7 and not {r.uid for r in few.collect()} & masked
    most = spark.createDataFrame([(u,) for u, _ in rows[3:]], "uid long")
    assert index.search(qdf, 7, mask=most, n_probe=1).count() == 6 * 3      # min(k, allowed)


def test_recall_aim_is_met(spark, data):
    rows, queries, index = data
    n = index.probes_for(0.95, 5, sample=120)
    got = pairs(index.search(spark.createDataFrame(queries, SCHEMA), 5, n_probe=n))
    want = plain(queries, rows, 5)
    assert len(got) == len(want) and len(set(got) & set(want)) / len(want) >= 0.9
    assert index.probes_for(1.0, 5, sample=50) <= len(index.cells)


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_upkeep_equals_a_rebuild(spark, metric):
    first, more, queries = clustered(300, 5, 3), clustered(200, 5, 4, start=1000, spread=0.5), clustered(10, 5, 5, start=5000)
    more += [(1990, [0.0] * 5), (1991, None)]
    folder = shared_path(spark, "cells")
    built = CellIndex.create(spark.createDataFrame(first, SCHEMA), folder, n_cells=5, metric=metric)
    with pytest.raises(ValueError):
        CellIndex.create(spark.createDataFrame(first, SCHEMA), folder, n_cells=5, metric=metric)
    grown = built.append(spark.createDataFrame(more, SCHEMA))
    halves = grown.split(80)
    assert len(halves.cells) > len(grown.cells)
    gone = [(u,) for u, _ in first[::3]] + [(424242,)]
    cut = halves.delete(spark.createDataFrame(gone, "uid long"))
    back = cut.append(spark.createDataFrame(first[:3], SCHEMA).filter("uid = 0"))       # a deleted id comes again
    assert back.append(spark.createDataFrame([], SCHEMA)).version == back.version + 1
    rows = {u: v for u, v in first + more if v is not None}
    qdf = spark.createDataFrame(queries, SCHEMA)
    assert pairs(grown.search(qdf, 6)) == plain(queries, rows.items(), 6, metric)
    assert pairs(halves.search(qdf, 6)) == plain(queries, rows.items(), 6, metric)
    kept = {u: v for u, v in rows.items() if (u,) not in gone}
    assert pairs(cut.search(qdf, 6)) == plain(queries, kept.items(), 6, metric)
    kept[0] = rows[0]
    assert pairs(back.search(qdf, 6)) == plain(queries, kept.items(), 6, metric)
    for i in (built, grown, halves, cut, back):
        assert sum(r["n"] for r in i.cells.values()) == i.rows().count()
    # an older version still answers as it did; the newest is found again
    assert pairs(CellIndex(spark, folder, 0).search(qdf, 6)) == plain(queries, first, 6, metric)
    assert CellIndex(spark, folder).version == back.version + 1


def test_a_change_without_its_manifest_did_not_happen(spark, data):
    rows = clustered(60, 4, 8)
    folder = shared_path(spark, "cells")
    index = CellIndex.create(spark.createDataFrame(rows, SCHEMA), folder, n_cells=3)
    spark.createDataFrame([(9999, [1.0, 0.0, 0.0, 0.0], 0)], "uid long, vec array<double>, cell long") \
        .write.partitionBy("cell").parquet(f"{folder}/segments/version=1")
    assert CellIndex(spark, folder).version == 0 and CellIndex(spark, folder).rows().count() == 60
    assert CellIndex(spark, folder).append(spark.createDataFrame(clustered(5, 4, 9, start=100), SCHEMA)).rows().count() == 65


def test_plan_reads_only_the_probed_cells(spark, data):
    _, _, index = data
    plan = index.rows([0, 3])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "cell#" in plan.split("PartitionFilters")[1][:80]
    assert index.search(spark.createDataFrame([], SCHEMA), 3).count() == 0
    assert index.search(spark.createDataFrame([(1, None)], SCHEMA), 3).count() == 0
