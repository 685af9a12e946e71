import numpy as np
from pyspark.sql import functions as F

from poolsift.operators import anchors as A
from poolsift.operators import strategies as ST
from poolsift.operators.similarity import build_ivf, ivf_knn, knn_join, recall_at_k


def _vectors(spark, n, dim, seed, start=0, labels=2):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim))
    rows = [(start + i, int(i % labels), [float(x) for x in v[i]]) for i in range(n)]
    return spark.createDataFrame(rows, "uid long, label int, embedding array<double>"), v


def test_knn_join_matches_brute_force(spark):
    pool, P = _vectors(spark, 400, 8, 1)
    q, Q = _vectors(spark, 6, 8, 2, start=10_000)
    got = knn_join(q, pool.repartition(5), k=7).collect()
    Pn = P / np.linalg.norm(P, axis=1)[:, None]
    Qn = Q / np.linalg.norm(Q, axis=1)[:, None]
    D = 1 - Qn @ Pn.T
    for i in range(6):
        exp = [(round(D[i, j], 9), j) for j in np.lexsort((np.arange(400), D[i]))[:7]]
        mine = sorted((round(r["dists"], 9), r["uid"]) for r in got if r["search_query_uid"] == 10_000 + i)
        assert mine == exp


def test_knn_join_chunked_equals_single(spark):
    pool, _ = _vectors(spark, 300, 8, 3)
    q, _ = _vectors(spark, 20, 8, 4, start=5000)
    def rows(df):
        return sorted((r[0], r[1], round(r[2], 9)) for r in df.collect())
    one = rows(knn_join(q, pool, k=5))
    many = rows(knn_join(q, pool, k=5, max_broadcast_bytes=8 * 8 * 5))
    assert one == many


def test_ivf_recall(spark):
    pool, _ = _vectors(spark, 600, 8, 5)
    q, _ = _vectors(spark, 10, 8, 6, start=9000)
    cells, centers, meta = build_ivf(pool, n_cells=4, seed=1)
    approx = ivf_knn(q, cells, centers, k=10, n_probe=4)  # probing every cell is exact
    exact = knn_join(q, pool, k=10)
    assert recall_at_k(approx, exact).first()["recall"] == 1.0
    assert meta.first()["dim"] == 8


def test_anchor_subpool_hand_cases(spark):
    c = spark.createDataFrame([(1, 10, 0.1), (2, 10, 0.5), (1, 20, 0.2)], "search_query_uid long, uid long, dists double")
    assert [r["uid"] for r in ST.anchor_subpool(c, 1).collect()] == [20]
    c3 = spark.createDataFrame([(1, 1, 0.1), (1, 2, 0.2), (1, 3, 0.3)], "search_query_uid long, uid long, dists double")
    assert ST.anchor_subpool(c3, 10).count() == 3


def test_entropy_query_hand_case(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [5.0, 0.0])], "uid long, logits array<double>")
    scores = {r["uid"]: round(r["entropy"], 6) for r in ST.entropy_scores(df).collect()}
    assert scores == {1: 0.693147, 2: 0.040180}
    assert [r["uid"] for r in ST.entropy_query(df, 1).collect()] == [1]


def test_anchor_select_small_sets(spark):
    tiny = spark.createDataFrame([(i, 0, [0.0]) for i in range(4)], "uid long, label int, embedding array<double>")
    assert A.select_anchors(tiny, 10).count() == 4
    rows = [(i, 0, [float(i)]) for i in range(3)] + [(100 + i, 1, [float(i)]) for i in range(20)]
    lab = spark.createDataFrame(rows, "uid long, label int, embedding array<double>")
    out = A.select_anchors(lab, 5, "random", "random")
    counts = {r["label"]: r["count"] for r in out.groupBy("label").count().collect()}
    assert counts == {0: 3, 1: 5}
    assert A.select_anchors(lab, 5, "all", "kmeans_pp_sampling", [0]).groupBy("label").count().count() == 2


def test_kmeanspp_distinct_and_whole_small_groups(spark):
    df, _ = _vectors(spark, 60, 4, 7, labels=3)
    base = df.select("uid", "label", F.col("embedding").alias("vec"))
    picks = A.kmeanspp_pick(base, 5, seed=1, by=["label"]).collect()
    assert len(picks) == 15 and len({r["uid"] for r in picks}) == 15
    small = base.filter(F.col("uid") < 6)
    assert A.kmeanspp_pick(small, 5, seed=1, by=["label"]).count() == 6


def test_badge_distance_matches_materialised(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 0.5], [0.3, -0.2]), (2, [0.2, 0.1, 3.0], [1.0, 0.5])],
                               "uid long, logits array<double>, embedding array<double>")
    f = ST.badge_factors(df).collect()
    g1, h1, g2, h2 = (np.array(f[0]["g"]), np.array(f[0]["h"]), np.array(f[1]["g"]), np.array(f[1]["h"]))
    exp = np.sum((np.outer(g1, h1) - np.outer(g2, h2)) ** 2)
    pair = spark.createDataFrame([(f[0]["g"], f[0]["h"], f[1]["g"], f[1]["h"])], "g array<double>, h array<double>, "
                                 "gc array<double>, hc array<double>")
    got = pair.select(ST.badge_sqdist([F.col("g"), F.col("h")], [F.col("gc"), F.col("hc")]).alias("d")).first()["d"]
    assert abs(got - exp) < 1e-9


def test_registry_names():
    assert len(ST.STRATEGY_NAMES) == 25 and "anchored_entropy" in ST.STRATEGY_NAMES


def test_knn_join_exact_ties_broken_by_uid(spark):
    # duplicated vectors give exactly equal distances; order must be (dist, uid)
    rng = np.random.default_rng(11)
    base = rng.normal(size=(30, 6))
    P = np.vstack([base] * 7)
    uids = rng.permutation(len(P)) + 100
    rows = [(int(uids[i]), 0, [float(x) for x in P[i]]) for i in range(len(P))]
    pool = spark.createDataFrame(rows, "uid long, label int, embedding array<double>").repartition(3)
    q, Q = _vectors(spark, 4, 6, 12, start=50_000)
    got = knn_join(q, pool, k=12).collect()
    Pn = P / np.linalg.norm(P, axis=1)[:, None]
    Qn = Q / np.linalg.norm(Q, axis=1)[:, None]
    D = 1 - Qn @ Pn.T
    for i in range(4):
        order = np.lexsort((uids, np.round(D[i], 12)))[:12]
        exp = [int(uids[j]) for j in order]
        mine = [r["uid"] for r in sorted((r for r in got if r["search_query_uid"] == 50_000 + i),
                                         key=lambda r: (round(r["dists"], 12), r["uid"]))]
        assert mine == exp


def test_ivf_chunked_equals_single(spark):
    pool, _ = _vectors(spark, 400, 8, 21)
    q, _ = _vectors(spark, 12, 8, 22, start=7000)
    cells, centers, _ = build_ivf(pool, n_cells=4, seed=3)

    def rows(df):
        return sorted((r[0], r[1], round(r[2], 9)) for r in df.collect())
    one = rows(ivf_knn(q, cells, centers, k=5, n_probe=2))
    many = rows(ivf_knn(q, cells, centers, k=5, n_probe=2, max_broadcast_bytes=8 * 8 * 3))
    assert one == many and len(one) == 60


def test_knn_max_search_size(spark):
    from poolsift.operators.sampling import hash_top_n
    pool, _ = _vectors(spark, 300, 6, 31)
    q, _ = _vectors(spark, 3, 6, 32, start=9000)
    capped = knn_join(q, pool, k=4, max_search_size=50, seed=5).collect()
    allowed = {r["uid"] for r in hash_top_n(pool, 50, seed=5).collect()}
    assert len(capped) == 12 and {r["uid"] for r in capped} <= allowed
    # same as searching the sampled pool directly
    direct = sorted((r[0], r[1]) for r in knn_join(q, pool.join(hash_top_n(pool, 50, seed=5).select("uid"), "uid",
                                                                      "left_semi"), k=4).collect())
    assert sorted((r[0], r[1]) for r in capped) == direct


def test_odd_vectors_follow_one_rule(spark):
    from poolsift.functions.vectors import cosine_distance
    pool = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [0.0, 1.0])], "uid long, embedding array<double>")
    q = spark.createDataFrame([(10, [1.0, 0.0]), (11, None), (12, [0.0, 0.0])], "uid long, embedding array<double>")
    got = {(r.search_query_uid, r.uid): r.dists for r in knn_join(q, pool, k=5).collect()}
    assert got == {(10, 1): 0.0, (10, 2): 1.0, (10, 4): 1.0, (12, 1): 1.0, (12, 2): 1.0, (12, 4): 1.0}
    pairs = pool.alias("a").join(q.alias("b")).select("a.uid", F.col("b.uid").alias("q"), cosine_distance("a.embedding", "b.embedding").alias("d"))
    assert all(r.d == got.get((r.q, r.uid)) for r in pairs.collect())
    cells, centers, meta = build_ivf(pool, n_cells=2, seed=1)
    assert ivf_knn(q, cells, centers, k=5, n_probe=2, meta=meta).count() == 6


def test_ivf_probes_with_the_metric_of_the_search(spark):
    import numpy as np
    rng = np.random.default_rng(0)
    at = np.array([[1.0, 1.0], [10.0, 10.0], [1.0, -1.0], [10.0, -10.0]])
    x = np.repeat(at, 60, axis=0) + rng.normal(0, 0.2, (240, 2))
    pool = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "uid long, embedding array<double>")
    q = pool.filter("uid % 10 = 0")
    for metric in ("l2", "cosine", "ip"):
        cells, centers, meta = build_ivf(pool, n_cells=4, seed=3, metric=metric)
        approx = ivf_knn(q, cells, centers, k=10, n_probe=1 if metric == "l2" else 2, meta=meta)
        assert recall_at_k(approx, knn_join(q, pool, k=10, metric=metric)).first()["recall"] > 0.9


def test_kmeans_rows_always_returns_k_rows(spark):
    from poolsift.operators.anchors import kmeans_rows
    df = spark.createDataFrame([(i, [float(i % 2), 0.0]) for i in range(30)], "uid long, vec array<double>")
    assert len({r.uid for r in kmeans_rows(df, 5, seed=1).collect()}) == 5
    assert kmeans_rows(df.limit(3), 5, seed=1).count() == 3
