import numpy as np
from pyspark.sql import functions as F

from poolsift.operators import strategies as ST
from poolsift.operators.rounds import active_rounds, embed_batches, hash_embed
from poolsift.operators.sampling import initial_budget
from poolsift.operators.similarity import knn_join


def _emb(spark, n=300, dim=8, seed=3, classes=3, parts=4):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim))
    rows = [(i, int(i % classes), [float(x) for x in v[i]]) for i in range(n)]
    return spark.createDataFrame(rows, "uid long, label int, embedding array<double>").repartition(parts)


def test_active_rounds_invariants(spark):
    base = _emb(spark)
    init = initial_budget(base, "label", 3, 30, [0], seed=1)
    cfg = ST.TwoStageConfig(subpool_size=60, num_neighbours=10, num_anchors=4,
                            anchor_strategy_minority="random", anchor_strategy_majority="entropy",
                            minority_classes=[0], seed=5)
    log = active_rounds(base, init, "anchored_entropy", rounds=2, batch=7, cfg=cfg).collect()
    by_round = {}
    for r in log:
        by_round.setdefault(r["labelling_round"], []).append(r["uid"])
    assert sorted(by_round) == [-1, 0, 1]
    assert len(by_round[-1]) == 30 and len(by_round[0]) == 7 and len(by_round[1]) == 7
    all_ids = [u for ids in by_round.values() for u in ids]
    assert len(all_ids) == len(set(all_ids))          # a row is never labelled twice


def test_subpools_inside_pool_and_sized(spark):
    base = _emb(spark)
    lab = base.filter(F.col("uid") < 40)
    pool = base.filter(F.col("uid") >= 40)
    pool_ids = {r["uid"] for r in pool.collect()}
    cfg = ST.TwoStageConfig(subpool_size=50, num_neighbours=8, num_anchors=3,
                            anchor_strategy_minority="random", anchor_strategy_majority="random", seed=2)
    for stage in ST.STAGES:
        sub = {r["uid"] for r in ST.subpool(stage, pool, lab, cfg, round_=0).collect()}
        assert sub <= pool_ids and 0 < len(sub) <= 50, stage


def test_results_independent_of_partitioning(spark):
    base = _emb(spark, parts=1)
    q = base.filter(F.col("uid") < 5)
    pool = base.filter(F.col("uid") >= 5)
    ref = sorted((r[0], r[1], round(r[2], 9)) for r in knn_join(q, pool, k=6).collect())
    for parts in (3, 17):
        shuffled = pool.orderBy(F.rand(parts)).repartition(parts)
        got = sorted((r[0], r[1], round(r[2], 9)) for r in knn_join(q, shuffled, k=6).collect())
        assert got == ref
        sub = [r["uid"] for r in ST.anchor_subpool(knn_join(q, shuffled, k=6), 10).collect()]
        assert sub == [r["uid"] for r in ST.anchor_subpool(knn_join(q, pool, k=6), 10).collect()]


def test_encoders_unit_norm(spark):
    docs = spark.createDataFrame([(1, "a b c a"), (2, "x y"), (3, "long text " * 50)], "uid long, text string")
    h = hash_embed(docs, "text", dim=16).collect()
    assert all(abs(np.linalg.norm(r["embedding"]) - 1) < 1e-9 for r in h)

    def encode(texts):
        return np.array([[len(t), 1.0] for t in texts], dtype=float)

    e = {r["uid"]: r["embedding"] for r in embed_batches(docs, "text", encode, 2).collect()}
    assert e[2] == [3.0, 1.0] and len(e) == 3
