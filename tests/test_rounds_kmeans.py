"""Round loop to a budget with restart, batched k-means++ picks, k-means of all groups in one run."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from poolsift.operators import anchors as A
from poolsift.operators import neighbours as NB
from poolsift.operators import strategies as ST
from poolsift.operators.rounds import RoundStore, round_log, run_rounds
from poolsift.operators.scorers import class_means, mean_scorer, with_mean_logits
from poolsift.session import shared_path


def vectors(spark, n, dim, seed, labels=3, repeats=0):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim)) + 3 * np.eye(dim)[rng.integers(0, dim, n)]
    v[n - repeats:] = v[0]
    rows = [(i, int(i % labels), [float(x) for x in v[i]]) for i in range(n)]
    return spark.createDataFrame(rows, "uid long, label int, embedding array<double>").repartition(3), v


# -------------------------------------------------------------- k-means++

def gumbel(seed, uid):
    return -math.log(-math.log((int(hashlib.md5(f"{seed}:{uid}".encode()).hexdigest()[:8], 16) + 0.5) / 2 ** 32))


def plain_kmeanspp(rows, k, seed, dist):
    """One pass per pick: (uid, vector) rows."""
    d2 = {u: None for u, _ in rows}
    vec, picks = dict(rows), []
    while len(picks) < min(k, len(rows)):
        s = len(picks)

        def key(u):
            g = gumbel(f"{seed}:{s}", u)
            return g if d2[u] is None else math.log(d2[u]) + g if d2[u] > 0 else g - 1e6

        best = max((u for u in d2 if u not in picks), key=lambda u: (key(u), -u))
        picks.append(best)
        for u in d2:
            new = dist(vec[u], vec[best])
            d2[u] = new if d2[u] is None else min(d2[u], new)
    return picks


def euclid(a, b):
    return float(((a - b) ** 2).sum())


@pytest.mark.parametrize("ahead,kept", [(32, 32), (6, 3), (1, 1)])
def test_batched_picks_equal_one_pass_per_pick(spark, monkeypatch, ahead, kept):
    monkeypatch.setattr(A, "LOOK_AHEAD", ahead)
    monkeypatch.setattr(A, "CANDIDATES", kept)
    df, v = vectors(spark, 160, 4, 3, repeats=40)
    base = df.withColumnRenamed("embedding", "vec")
    passes = []
    got = A.kmeanspp_pick(base, 40, seed=9, passes=passes).orderBy("pick_step").collect()
    assert [r.uid for r in got] == plain_kmeanspp([(i, v[i]) for i in range(160)], 40, 9, euclid)
    assert sum(passes) == 40 and (ahead > 1 or len(passes) == 40)
    by = A.kmeanspp_pick(base.withColumn("label", F.when(F.col("uid") < 150, F.col("label"))), 7, seed=5, by=["label"]).collect()
    for c in (0, 1, 2, None):
        rows = [(i, v[i]) for i in range(160) if (i % 3 if i < 150 else None) == c]
        assert [r.uid for r in sorted(by, key=lambda r: r.pick_step) if r.label == c] == plain_kmeanspp(rows, 7, 5, euclid)


def test_many_picks_take_few_passes(spark):
    df, _ = vectors(spark, 2500, 16, 4)
    passes = []
    got = A.kmeanspp_pick(df.withColumnRenamed("embedding", "vec"), 500, seed=1, passes=passes).collect()
    assert len({r.uid for r in got}) == 500 and sum(passes) == 500 and len(passes) < 50


def test_portions_of_groups_and_odd_rows(spark, monkeypatch):
    df, v = vectors(spark, 60, 3, 6, labels=4)
    base = df.withColumnRenamed("embedding", "vec")
    whole = sorted(tuple(r) for r in A.kmeanspp_pick(base, 3, seed=2, by=["label"]).collect())
    clusters = sorted(tuple(r) for r in A.kmeans_rows(base, 3, seed=2, by=["label"], max_iter=2).collect())
    monkeypatch.setattr(A, "STATE_BYTES", 20_000)          # two portions
    assert sorted(tuple(r) for r in A.kmeanspp_pick(base, 3, seed=2, by=["label"]).collect()) == whole
    monkeypatch.setattr(A, "STATE_BYTES", 700)
    assert sorted(tuple(r) for r in A.kmeans_rows(base, 3, seed=2, by=["label"], max_iter=2).collect()) == clusters
    odd = base.unionByName(spark.createDataFrame([(500, 1, None)], "uid long, label int, vec array<double>"))
    assert 500 not in {r.uid for r in A.kmeanspp_pick(odd, 50, seed=2, by=["label"]).collect()}
    assert A.kmeanspp_pick(base.limit(0), 3).count() == 0 and A.kmeans_rows(base.limit(0), 3).count() == 0
    assert A.kmeanspp_pick(base.limit(0), 3, by=["label"]).count() == 0 and A.kmeans_rows(base.limit(0), 3, by=["label"]).count() == 0


def test_badge_picks_equal_the_outer_products(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(0, 2, 3)], [float(x) for x in rng.normal(size=4)]) for i in range(60)]
    df = spark.createDataFrame(rows, "uid long, logits array<double>, embedding array<double>")
    f = [(r.uid, np.outer(r.g, r.h).ravel()) for r in ST.badge_factors(df).collect()]
    got = {r.uid for r in ST.badge_query(df, 8, seed=3).collect()}
    assert got == set(plain_kmeanspp(f, 8, 3, euclid))


# ----------------------------------------------------------------- k-means

def plain_lloyd(rows, k, seed, iterations):
    """(uid, vector) rows: cluster and squared distance per uid."""
    first = sorted(rows, key=lambda r: (hashlib.md5(f"{seed}:{r[0]}".encode()).hexdigest(), r[0]))[:k]
    c = np.array([v for _, v in first])
    uids, x = np.array([u for u, _ in rows]), np.array([v for _, v in rows])

    def assign():
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        return d.argmin(1), d.min(1)

    for _ in range(iterations):
        at, d = assign()
        new = c.copy()
        far = iter(sorted((-d[i], uids[i], i) for i in range(len(x)) if d[i] > 0))
        for j in range(len(c)):
            if (at == j).any():
                new[j] = x[at == j].mean(0)
            else:
                row = next(far, None)
                new[j] = c[j] if row is None else x[row[2]]
        c = new
    at, d = assign()
    return dict(zip(uids.tolist(), zip(at.tolist(), d.tolist())))


@pytest.mark.parametrize("repeats", [0, 100])
def test_lloyd_equals_a_plain_loop(spark, repeats):
    df, v = vectors(spark, 150, 3, 8, repeats=repeats)          # many equal rows leave centres empty
    base = df.withColumnRenamed("embedding", "vec")
    got = {r.uid: (r.cluster, r.d2) for r in A.lloyd(base, 12, seed=4, max_iter=6).collect()}
    want = plain_lloyd([(i, v[i]) for i in range(150)], 12, 4, 6)
    assert {u: c for u, (c, _) in got.items()} == {u: c for u, (c, _) in want.items()}
    assert all(abs(got[u][1] - want[u][1]) < 1e-9 for u in got)
    by = {r.uid: r.cluster for r in A.lloyd(base, 5, by=["label"], seed=4, max_iter=6).collect()}
    for c in range(3):
        want = plain_lloyd([(i, v[i]) for i in range(c, 150, 3)], 5, 4, 6)
        assert {u: by[u] for u in want} == {u: c for u, (c, _) in want.items()}


def test_kmeans_rows_are_distinct_and_fill_up(spark):
    df, _ = vectors(spark, 40, 2, 1, repeats=35)
    rows = A.kmeans_rows(df.withColumnRenamed("embedding", "vec"), 20, seed=1).collect()
    assert len({r.uid for r in rows}) == 20
    small = A.anchors_kmeans(df.filter("uid < 6"), 5, seed=1).collect()
    assert len(small) == 6
    per_class = A.anchors_kmeans(df, 4, seed=1).groupBy("label").count().collect()
    assert {r["count"] for r in per_class} == {4}


# -------------------------------------------------------------- round loop

CONFIG = dict(subpool_size=40, num_neighbours=8, num_anchors=3, anchor_strategy_minority="random", anchor_strategy_majority="random",
              minority_classes=[0], seed=42)


def loop(spark, folder, budget=70, strategy="anchored_entropy", **more):
    df, _ = vectors(spark, 200, 5, 11)
    return run_rounds(df, df.filter("uid < 20"), strategy, budget, 15, folder, ST.TwoStageConfig(**CONFIG), mean_scorer(3, 4.0), **more)


def as_set(log):
    return sorted((r.labelling_round, r.uid, r.label) for r in log.collect())


def test_loop_stops_at_its_budget_and_repeats(spark):
    log = as_set(loop(spark, shared_path(spark, "loop")))
    counts = {r: sum(x[0] == r for x in log) for r in {x[0] for x in log}}
    assert counts == {-1: 20, 0: 15, 1: 15, 2: 15, 3: 5} and len({x[1] for x in log}) == 70
    assert log == as_set(loop(spark, shared_path(spark, "loop")))


def test_killed_loop_resumes_behind_its_last_commit(spark):
    whole = as_set(loop(spark, shared_path(spark, "loop")))
    folder = shared_path(spark, "loop")

    class Killed(Exception):
        pass

    def kill(after):
        if after == 1:
            raise Killed

    with pytest.raises(Killed):
        loop(spark, folder, after_write=kill)
    store = RoundStore(spark, folder)
    assert store.last() == 1
    # a round that was written but not committed did not happen
    spark.createDataFrame([(999, 0, [0.0] * 5, 2)], "uid long, label int, embedding array<double>, labelling_round int") \
        .write.parquet(f"{folder}/picks/round=2")
    begun = []
    assert as_set(loop(spark, folder, after_write=begun.append)) == whole and begun == [1, 2]
    # a finished loop does no more rounds; a larger budget goes on; other settings are refused
    begun.clear()
    assert as_set(loop(spark, folder, after_write=begun.append)) == whole and not begun
    more = as_set(loop(spark, folder, budget=85))
    assert len(more) == 85 and more[:70] == whole
    with pytest.raises(ValueError):
        loop(spark, folder, strategy="entropy")


def test_loop_ends_with_the_pool_and_logs_every_class(spark):
    log = loop(spark, shared_path(spark, "loop"), budget=1000, strategy="random")
    assert log.count() == 200
    rows = {(r.labelling_round, r.class_id): r for r in round_log(log, 200, 4).collect()}
    last = max(r for r, _ in rows)
    assert rows[last, 0].labelled_size == 200 and rows[last, 0].pool_size == 0
    assert all(rows[r, 3]["count"] == 0 for r in range(-1, last + 1)) and rows[-1, 0].labelled_size == 20
    assert sum(rows[r, 1]["count"] for r in range(-1, last + 1)) == rows[last, 1].cumulative_count


def test_mean_logits_read_whole_vectors(spark):
    df, v = vectors(spark, 30, 5, 2)
    means = class_means(df, 4)
    assert np.allclose(means[1], v[1::3].mean(0)) and means[3] == [0.0] * 5
    got = {r.uid: r.logits for r in with_mean_logits(df, means, 2.0).collect()}
    assert np.allclose(got[7], 2.0 * np.array(means) @ v[7])


# --------------------------------------------------------- neighbour lists

def test_lists_kept_up_equal_a_full_search(spark, monkeypatch):
    df, v = vectors(spark, 220, 4, 21)
    rows = df.select("uid", "embedding")
    asked = []
    plain = NB.knn_join
    monkeypatch.setattr(NB, "knn_join", lambda q, *a, **b: asked.append({r.uid for r in q.select("uid").collect()}) or plain(q, *a, **b))
    lab, pool = rows.filter("uid < 12"), rows.filter("uid >= 12")
    lists, k, spare = NB.start_lists(lab, pool, 6, 4), 6, 4
    for r in range(3):
        before = {x.uid for x in lab.collect()}
        # rows near labelled row 0 are labelled, so that its list runs short
        near = [x.uid for x in NB.nearest(lists, 100).filter("search_query_uid = 0").orderBy("dists", "uid").limit(5).collect()]
        new = rows.filter(F.col("uid").isin(near)).checkpoint()
        pool = pool.filter(~F.col("uid").isin(near))
        lists = NB.advance_lists(lists, lab, new, pool, k, spare)
        assert set(near) <= asked[-1] and len(asked[-1] - set(near)) < len(before) / 2
        lab = lab.unionByName(new)
        want = plain(lab, pool, k).collect()
        got = NB.nearest(lists, k).collect()
        assert sorted((x.search_query_uid, x.uid) for x in got) == sorted((x.search_query_uid, x.uid) for x in want)
    assert 0 in set().union(*asked[1:])                        # its list did run short and was searched for again
    assert not {x.uid for x in lists.collect()} & {x.uid for x in lab.collect()}


def test_lists_of_a_pool_that_runs_out(spark):
    df, _ = vectors(spark, 12, 3, 2)
    rows = df.select("uid", "embedding")
    lists = NB.start_lists(rows.filter("uid < 4"), rows.filter("uid >= 4"), 5, 2)
    lists = NB.advance_lists(lists, rows.filter("uid < 4"), rows.filter("uid between 4 and 8"), rows.filter("uid > 8"), 5, 2)
    assert lists.count() == 9 * 3
    lists = NB.advance_lists(lists, rows.filter("uid <= 8"), rows.filter("uid > 8"), rows.filter("uid > 100"), 5, 2)
    assert lists.count() == 0
