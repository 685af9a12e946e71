"""Physical-plan properties the scale design relies on."""

import contextlib
import io

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def _plan(spark, key):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        E.queries()[key](spark, SF).explain("formatted")
    return buf.getvalue()


def test_knn_plan_local_then_global_topk(spark):
    plan = _plan(spark, "knn_join")
    assert "MapInArrow" in plan
    assert plan.count("WindowGroupLimit") >= 2          # partial before the exchange, final after
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in plan   # label column pruned
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_sampling_plans_have_no_cross_joins(spark):
    for key in ("stratified_sample", "downsample_majority", "initial_budget", "design_grid", "missing_runs"):
        plan = _plan(spark, key)
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, key


def test_text_column_never_read_by_sampling(spark):
    plan = _plan(spark, "stratified_sample")
    assert "text" not in [f.split(":")[0] for line in plan.splitlines() if line.startswith("ReadSchema")
                          for f in line[len("ReadSchema: struct<"):-1].split(",")]
