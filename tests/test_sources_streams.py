import os

from pyspark.sql import functions as F

from poolsift.session import local_path, shared_path
from poolsift.sources import readers as RD
from poolsift.sources import sinks as SK
from poolsift.streaming import streams as SM


def test_ragged_configs_flatten_without_a_schema(spark):
    root = local_path(shared_path(spark, "configs"))
    bodies = {"r1": '{"seed": 1, "model": {"name": "bert", "seed": 10}, "args": [1, 2]}',
              "r2": '{"seed": 2, "model": {"name": "bert", "lr": 0.5}, "strategy": {"args": {"k": "5"}}, "odd key.x": true}',
              "r3": '{"seed": "three", "empty": {}}', "r4": "not json"}
    for run, body in bodies.items():
        os.makedirs(f"{root}/main/{run}", exist_ok=True)
        with open(f"{root}/main/{run}/hparams.json", "w") as fh:
            fh.write(body)
    df = RD.read_configs(spark, root)
    rows = {r["filename"].rsplit("/", 1)[1]: r.asDict() for r in df.collect()}
    assert set(df.columns) == {"filename", "seed", "model.name", "model.seed", "model.lr", "args", "strategy.args.k", "odd key.x", "empty"}
    assert rows["r1"]["model.seed"] == 10 and rows["r1"]["args"] == "[1,2]" and rows["r1"]["model.lr"] is None
    assert float(rows["r2"]["model.lr"]) == 0.5 and rows["r2"]["strategy.args.k"] == "5" and rows["r2"]["odd key.x"] is True
    assert rows["r1"]["seed"] == "1" and rows["r3"]["seed"] == '"three"'          # values of two kinds: JSON text
    assert all(v is None for k, v in rows["r4"].items() if k != "filename")
    assert RD.flatten_variant(df.select(F.lit("[1]").alias("j"), "filename"), "j", ["filename"]).columns == ["filename"]


def test_latin1_lines(spark):
    root = local_path(shared_path(spark, "latin1"))
    os.makedirs(root)
    with open(f"{root}/labels.txt", "wb") as fh:
        fh.write("café\nnaïve, \"quoted\"\n".encode("latin-1"))
    got = [r["labels"] for r in RD.read_latin1_lines(spark, root).collect()]
    assert got == ["café", 'naïve, "quoted"']


def test_jsonl_blank_lines_and_filename(spark):
    root = local_path(shared_path(spark, "jsonl"))
    os.makedirs(f"{root}/run1")
    with open(f"{root}/run1/subpool_ids.jsonl", "w") as fh:
        fh.write('{"subpool_ids": [1, 2], "labelling_round": 0}\n\n{"subpool_ids": [3], "labelling_round": 1}\n')
    df = RD.read_jsonl(spark, root + "/run1", "subpool_ids array<int>, labelling_round int", filename=True)
    assert df.count() == 2
    assert df.select(RD.run_dir("filename").alias("d")).first()["d"].endswith("/run1")


def test_dataset_sink_refuses_overwrite(spark):
    df = spark.createDataFrame([(1, "train"), (2, "test")], "uid long, split string")
    path = SK.write_dataset(df, shared_path(spark, "ds"))
    try:
        SK.write_dataset(df, path)
        raise AssertionError("expected a refusal")
    except Exception as e:
        assert "already exists" in str(e).lower() or "path_already_exists" in str(e).lower()
    assert RD.scan_split(spark, path, "train").count() == 1


def test_stream_counts_equal_batch(spark):
    src = shared_path(spark, "stream-src")
    rows = [(i % 7, i % 3, "A" if i % 2 else "R") for i in range(500)]
    df = spark.createDataFrame(rows, "run long, rnd int, labels string")
    df.write.parquet(src)
    sink, ckpt = shared_path(spark, "sink"), shared_path(spark, "ckpt")
    keys = ["run", "rnd", "labels"]
    SM.stream_counts(spark, src, df.schema, keys, sink, ckpt)
    # a second file arrives: the stream resumes from its checkpoint and updates the counts
    more = spark.createDataFrame([(1, 1, "A"), (99, 0, "N")], "run long, rnd int, labels string")
    more.write.mode("append").parquet(src)
    SM.stream_counts(spark, src, df.schema, keys, sink, ckpt)
    df = df.unionByName(more)
    got = sorted(tuple(r) for r in SM.read_counts(spark, sink, keys).select(*keys, "n").collect())
    exp = sorted(tuple(r) for r in df.groupBy("run", "rnd", "labels").agg(F.count(F.lit(1)).alias("n")).collect())
    assert got == exp


def test_compacted_counts_stay_and_old_epochs_go(spark):
    src = shared_path(spark, "stream-src")
    schema = "run long, labels string"
    sink, ckpt = shared_path(spark, "sink"), shared_path(spark, "ckpt")
    rows = []
    for turn in range(4):
        new = [(turn % 2, "A"), (turn, "R")]
        rows += new
        spark.createDataFrame(new, schema).write.mode("append").parquet(src)
        SM.stream_counts(spark, src, spark.createDataFrame([], schema).schema, ["run", "labels"], sink, ckpt)
        if turn in (1, 2):
            SM.compact_counts(spark, sink, ["run", "labels"])
    want = sorted(tuple(r) for r in spark.createDataFrame(rows, schema).groupBy("run", "labels").count().collect())
    assert sorted(tuple(r) for r in SM.read_counts(spark, sink, ["run", "labels"]).select("run", "labels", "n").collect()) == want
    assert len([p for p in os.listdir(local_path(sink)) if p.startswith("epoch=")]) == 1
    # a compaction that died before its commit changes nothing
    os.makedirs(f"{local_path(sink)}-compact/upto=99")
    assert sorted(tuple(r) for r in SM.read_counts(spark, sink, ["run", "labels"]).select("run", "labels", "n").collect()) == want
    SM.compact_counts(spark, sink, ["run", "labels"])
    assert sorted(tuple(r) for r in SM.read_counts(spark, sink, ["run", "labels"]).select("run", "labels", "n").collect()) == want


def test_stream_dedupe_forgets_ids_behind_the_watermark(spark):
    import time
    src = local_path(shared_path(spark, "rounds-src"))
    os.makedirs(src)
    sink, ckpt = shared_path(spark, "rounds-sink"), shared_path(spark, "rounds-ckpt")
    held = []
    for day in range(5):
        with open(f"{src}/{day}.json", "w") as fh:
            fh.write('{"run": 1, "labelling_round": %d, "subpool_ids": %s}\n' % (day, list(range(100))) * 2)
        os.utime(f"{src}/{day}.json", (time.time() - 86400 * (10 - day),) * 2)
        held.append(SM.stream_round_ids(spark, src, sink, ckpt, delay="1 hour")["state_rows"])
    got = spark.read.parquet(sink)
    assert got.count() == 500 and got.distinct().count() == 500
    assert max(held) <= 200, held            # the ids of earlier days are forgotten


def test_registry_contract():
    import __spark_entry__ as E
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 100


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.columns == ["uid", "entropy"] and df.count() == 25


def test_round_sinks_idempotent(spark):
    ids = spark.createDataFrame([(i,) for i in range(2500)], "uid long")
    path = shared_path(spark, "rounds")
    for r in (0, 1, 1):                     # round 1 written twice (a retried round)
        SK.append_round_ids(ids.filter(F.col("uid") % 2 == r), path, r, max_len=1000)
    back = RD.read_jsonl(spark, path, "subpool_ids array<long>, labelling_round int")
    rows = back.select("labelling_round", F.explode("subpool_ids").alias("uid"))
    counts = {r["labelling_round"]: r["count"] for r in rows.groupBy("labelling_round").count().collect()}
    assert counts == {0: 1250, 1: 1250}
    assert back.filter(F.size("subpool_ids") > 1000).count() == 0
    scored = spark.createDataFrame([(i, [0.1 * i, 0.2]) for i in range(5)], "uid long, logits array<double>")
    lpath = shared_path(spark, "logits")
    for r in (0, 0, 3):
        SK.append_logits(scored, lpath, r, num_classes=2)
    assert spark.read.parquet(lpath).groupBy("round").count().orderBy("round").collect()[0]["count"] == 5


def test_stream_round_ids_dedupes_across_batches(spark):
    src = local_path(shared_path(spark, "rounds-src"))
    os.makedirs(src)
    with open(f"{src}/a.json", "w") as fh:
        fh.write('{"run": 1, "labelling_round": 0, "subpool_ids": [1, 2, 2]}\n')
    sink, ckpt = shared_path(spark, "rounds-sink"), shared_path(spark, "rounds-ckpt")
    SM.stream_round_ids(spark, src, sink, ckpt)
    with open(f"{src}/b.json", "w") as fh:   # re-delivered ids plus a new one
        fh.write('{"run": 1, "labelling_round": 0, "subpool_ids": [2, 3]}\n')
    SM.stream_round_ids(spark, src, sink, ckpt)
    got = sorted(r["uid"] for r in spark.read.parquet(sink).collect())
    assert got == [1, 2, 3]


def test_stream_window_watermark_drops_late_rows(spark):
    import datetime as dt
    schema = "ts timestamp, value double"
    src = shared_path(spark, "win-src")
    day = dt.datetime(2024, 1, 1)
    first = [(day + dt.timedelta(days=d, hours=h), 1.0) for d in range(3) for h in (1, 5)]
    spark.createDataFrame(first, schema).write.parquet(src)
    sink, ckpt = shared_path(spark, "win-sink"), shared_path(spark, "win-ckpt")
    SM.stream_windowed_sums(spark, src, schema, "ts", "value", "1 day", "1 hour", sink, ckpt)
    # later: a row for day 0 (behind the watermark: dropped) and rows for day 3 (close day 2)
    late = [(day + dt.timedelta(hours=2), 100.0), (day + dt.timedelta(days=3, hours=3), 1.0)]
    spark.createDataFrame(late, schema).write.mode("append").parquet(src)
    SM.stream_windowed_sums(spark, src, schema, "ts", "value", "1 day", "1 hour", sink, ckpt)
    rows = sorted((r["window_start"], r["total"], r["n"]) for r in spark.read.parquet(sink).collect())
    assert [(w.day, t, n) for w, t, n in rows] == [(1, 2.0, 2), (2, 2.0, 2), (3, 2.0, 2)]
