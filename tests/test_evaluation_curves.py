from pyspark.sql import functions as F

from poolsift.operators import curves as C
from poolsift.operators import evaluation as EV
from poolsift.operators import report as RP


def _scored(spark, labels, preds, k=2):
    rows = [(i, l, [1.0 if j == p else 0.0 for j in range(k)]) for i, (l, p) in enumerate(zip(labels, preds))]
    return spark.createDataFrame(rows, "uid long, label int, logits array<double>")


def test_metrics_hand_case(spark):
    s = _scored(spark, [0, 0, 1, 1], [0, 1, 1, 1], k=3)
    per = {r["class_id"]: r for r in EV.metrics_perclass(s, 3).collect()}
    assert per[0]["precision"] == 1 and per[0]["recall"] == 0.5 and round(per[0]["f1"], 6) == 0.666667
    assert per[0]["specificity"] == 1
    assert round(per[1]["precision"], 6) == 0.666667 and per[1]["recall"] == 1 and round(per[1]["f1"], 6) == 0.8
    assert per[1]["specificity"] == 0.5
    assert per[2]["f1"] == 0 and per[2]["specificity"] == 1
    micro = EV.metrics_micro(s, 3).first()
    assert micro["accuracy_micro"] == 0.75 and round(micro["specificity_micro"], 6) == 0.875
    assert round(EV.metrics_macro_f1(s, 3).first()["f1_macro"], 6) == 0.733333


def test_micro_specificity_two_classes(spark):
    s = _scored(spark, [0, 0, 1, 1], [0, 1, 1, 1], k=2)
    assert EV.metrics_micro(s, 2).first()["specificity_micro"] == 0.75


def test_calibration_hand_case(spark):
    import math
    def logits_for(conf):  # two classes with top-class probability conf
        return [math.log(conf / (1 - conf)), 0.0]
    rows = [(0, 0, logits_for(0.95)), (1, 1, logits_for(0.95)), (2, 0, logits_for(0.55))]
    df = spark.createDataFrame(rows, "uid long, label int, logits array<double>")
    c = EV.calibration(df).first()
    assert round(c["ece"], 6) == 0.45 and round(c["mce"], 6) == 0.45 and round(c["rmsce"], 6) == 0.45


def _curve(spark, vals, run="r"):
    return spark.createDataFrame([(run, "t", i, float(v)) for i, v in enumerate(vals)],
                                 "run string, tag string, step int, value double")


def test_running_auc_and_minutes(spark):
    auc = [r["auc"] for r in C.running_auc(_curve(spark, [1, 2, 4]), ["run", "tag"]).orderBy("step").collect()]
    assert auc == [0.0, 1.5, 4.5]
    mins = [r["minutes"] for r in C.running_minutes(_curve(spark, [60, 30]), ["run", "tag"]).orderBy("step").collect()]
    assert mins == [1.0, 1.5]


def test_early_stop_and_best_step(spark):
    e = EV.early_stop_step(_curve(spark, [.5, .6, .6, .55, .9]), ["run", "tag"], patience=2, min_delta=1e-5).first()
    assert e["stop_index"] == 3 and e["best_value"] == 0.6
    b = EV.best_step(_curve(spark, [.5, .9, .9, .2]), ["run", "tag"]).first()
    assert b["best_step"] == 1


def test_cumulative_share_dense(spark):
    df = spark.createDataFrame([("r", -1, 0, 95), ("r", -1, 1, 5), ("r", 0, 0, 25)],
                               "run string, rnd int, cls int, n long")
    cum = C.cumulative_counts(df, ["run", "cls"], "rnd")
    got = sorted((r["rnd"], r["cls"], r["cum_n"]) for r in cum.collect())
    assert got == [(-1, 0, 95), (-1, 1, 5), (0, 0, 120)]
    share = C.share_of_total(cum, ["run", "rnd"]).filter(F.col("rnd") == 0).collect()
    assert [r["total"] for r in share] == [120] and len(share) == 1
    dense = C.carry_forward_grid(cum, "run", "rnd", "cls")
    d0 = C.share_of_total(dense, ["run", "rnd"]).filter((F.col("rnd") == 0) & (F.col("cls") == 1)).first()
    assert d0["total"] == 125 and round(d0["p"], 6) == 0.04


def test_median_iqr_and_gmean(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4)], "g string, value double")
    q = RP.group_quartiles(df, ["g"]).first()
    assert q["median"] == 2.5 and q["iqr"] == 1.5
    g = spark.createDataFrame([("x", .25), ("x", 1.0), ("y", 0.0), ("y", .5)], "k string, p double")
    res = {r["k"]: r["gm"] for r in g.groupBy("k").agg(RP.geometric_mean("p").alias("gm")).collect()}
    assert round(res["x"], 6) == 0.5 and res["y"] == 0.0


def test_budget_match_hand_case(spark):
    rows = [("d", s, m) for s, m in (("anchored_entropy", 10), ("seals_entropy", 7), ("noop_entropy", 3),
                                     ("noop_random", 9))]
    df = spark.createDataFrame(rows, "dataset_name string, strategy_name string, step int")
    got = {r["strategy_name"]: r["min_max_step"] for r in C.budget_match(df, ["dataset_name"]).collect()}
    assert got == {"anchored_entropy": 7, "seals_entropy": 7, "noop_entropy": 3, "noop_random": 7}


def test_outer_indicator_and_class_stats(spark):
    a = spark.createDataFrame([("a",), ("b",)], "k string")
    b = spark.createDataFrame([("b",), ("c",)], "k string")
    got = {r["k"]: r["_merge"] for r in RP.outer_indicator(a, b, ["k"]).collect()}
    assert got == {"a": "left_only", "b": "both", "c": "right_only"}
    lab = spark.createDataFrame([(0,), (0,), (1,)], "labels int")
    st = {r["labels"]: (r["count"], round(r["perc"], 6)) for r in RP.class_stats(lab, "labels", total=True).collect()}
    assert st == {0: (2, 0.666667), 1: (1, 0.333333), None: (3, 1.0)}


def test_design_grid_and_missing(spark):
    df = spark.createDataFrame([(1, "a", "d1"), (2, "b", "d2")], "u long, t string, d string")
    grid = RP.design_grid(df, ["u", "t", "d"], large_axis="u")
    assert grid.count() == 8
    assert RP.missing_combinations(grid, df, ["u", "t", "d"]).count() == 6
    holed = df.unionByName(spark.createDataFrame([(3, None, "d1")], df.schema))
    assert RP.design_grid(holed, ["u", "t", "d"], large_axis="u").count() == 18


def test_exact_quantiles_match_percentile(spark):
    import random
    random.seed(3)
    rows = [(g, float(random.choice([random.random(), 2.0, 2.0, 1e6 if i == 0 else random.lognormvariate(0, 2)])))
            for g, n in ((0, 1), (1, 2), (2, 9), (3, 3000)) for i in range(n)]
    df = spark.createDataFrame(rows, "g int, v double").repartition(5)
    qs = [0.25, 0.5, 0.75]
    mine = {r["g"]: (r["q_0"], r["q_1"], r["q_2"]) for r in RP.exact_quantiles(df, ["g"], "v", qs).collect()}
    ref = {r["g"]: tuple(r["p"]) for r in
           df.groupBy("g").agg(F.percentile("v", F.array(*[F.lit(q) for q in qs])).alias("p")).collect()}
    coarse = {r["g"]: (r["q_0"], r["q_1"], r["q_2"]) for r in RP.exact_quantiles(df, ["g"], "v", qs, accuracy=100).collect()}
    for g in ref:
        for got in (mine, coarse):
            assert all(abs(a - b) <= 1e-9 * max(1.0, abs(b)) for a, b in zip(got[g], ref[g]))


def test_quartiles_keep_null_keys_and_empty_groups(spark):
    rows = [(None, float(v)) for v in range(5)] + [("empty", None), ("empty", None), ("one", 3.0)]
    rows += [("hot", float(v % 1000)) for v in range(20_000)]
    df = spark.createDataFrame(rows, "g string, value double").repartition(3)
    got = {r["g"]: (r["median"], r["iqr"]) for r in RP.group_quartiles(df, ["g"]).collect()}
    assert got == {None: (2.0, 2.0), "empty": (None, None), "one": (3.0, 0.0), "hot": (499.5, 499.5)}


def test_running_sums_equal_running_lists_over_many_blocks(spark, monkeypatch):
    import random

    import numpy as np
    monkeypatch.setattr(C, "BLOCK_STEPS", 7)
    rng = random.Random(5)
    rows = [(r, t, s * 3, rng.random()) for r in ("a", None) for t in ("test/x", "timer/y") for s in range(40)]
    df = spark.createDataFrame(rows, "run string, tag string, step int, value double").repartition(4)
    want = {}
    for r, t, s, _ in rows:
        v = [x[3] for x in rows if x[0] == r and x[1] == t and x[2] <= s]
        want[r, t, s] = sum(v) / 60 if "timer" in t else float(np.trapezoid(v)) if len(v) > 1 else 0.0
    got = {(x.run, x.tag, x.step): x.value for x in C.curve_metrics(df).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    auc = {(x.run, x.step): x.auc for x in C.running_auc(df.filter("tag = 'test/x'"), ["run", "tag"]).collect()}
    assert all(abs(auc[r, s] - want[r, "test/x", s]) < 1e-9 for r, s in auc) and len(auc) == 80
    top = C.group_max(df, ["run"], "step", "m").collect()
    assert len(top) == len(rows) and {x.m for x in top} == {117}
