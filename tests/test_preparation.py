"""Datasets prepared by tables of renames and rules; statistics counted by the write."""

import pytest
from pyspark.sql import functions as F

from poolsift.operators import preparation as PR
from poolsift.session import shared_path

RULES = "dataset string, class_name string, priority int, code string"


def tables(spark):
    rules = [("a", "philosophy", 0, "413"), ("a", "archaeology", 1, "538"), ("a", "archaeology", 1, "413"), ("a", "agriculture", 2, "246"),
             ("b", "health", 0, "192"), ("b", "wealth", 1, "7"), ("c", "x", 0, "1")]
    targets = [("a", PR.ALL), ("b", "health")]
    return spark.createDataFrame(rules, RULES), spark.createDataFrame(targets, "dataset string, target string")


def test_labels_by_rules_of_several_datasets(spark):
    rules, targets = tables(spark)
    rows = spark.createDataFrame([
        ("a", 1, ["246"]), ("a", 2, ["413"]), ("a", 3, ["538", "246", "246"]), ("a", 4, []), ("a", 5, None), ("a", 6, [None, "538"]), ("a", 7, ["192"]),
        ("b", 1, ["192", "7"]), ("b", 2, ["7"]), ("b", 3, [None]), ("c", 1, ["1"])], "dataset string, uid long, codes array<string>")
    names = {(r.dataset, r.label): r.name for r in PR.class_names(rules, targets).collect()}
    assert names == {("a", 0): "agriculture", ("a", 1): "archaeology", ("a", 2): "philosophy", ("a", 3): "others",
                     ("b", 0): "Negative", ("b", 1): "Positive"}
    got = {(r.dataset, r.uid): r.labels for r in PR.label_rows(rows, rules, targets).collect()}
    assert got == {("a", 1): 0, ("a", 2): 1, ("a", 3): 0, ("a", 4): 3, ("a", 5): 3, ("a", 6): 1, ("a", 7): 3, ("b", 1): 1, ("b", 2): 0, ("b", 3): 0}


def test_renames_are_looked_up_per_dataset(spark):
    renames = spark.createDataFrame([("a", "bias", "codes"), ("a", "id", "uid"), ("b", "topic", "codes")], "dataset string, old string, new string")
    a = spark.createDataFrame([(1, "train", "t", 3)], "id long, split string, text string, bias int")
    b = spark.createDataFrame([(1, "test", "u", ["p", None], 9)], "uid long, split string, text string, topic array<string>, extra int")
    got = sorted(tuple(r) for r in PR.combined({"a": a, "b": b}, renames).collect())
    assert got == [("a", 1, "train", "t", ["3"]), ("b", 1, "test", "u", ["p", None])]
    with pytest.raises(ValueError):
        PR.rename_by_table(b, renames, "a")


def test_statistics_come_from_the_write(spark):
    rows = spark.createDataFrame([(i, "train" if i % 4 else "test", i % 3) for i in range(100)], "uid long, split string, labels int").repartition(5)
    scans = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            scans.add(b.num_rows)
            yield b

    path = shared_path(spark, "prepared")
    PR.write_prepared(rows.mapInArrow(count, rows.schema), path, ["n", "p", "o"], metadata={"binarised": False})
    assert scans.value == 100
    back, stats, facts = PR.read_prepared(spark, path)
    assert back.count() == 100 and facts == {"binarised": False, "rows": 100, "names": ["n", "p", "o"]}
    want = {(r.split, r.labels): r["count"] for r in rows.groupBy("split", "labels").count().collect()}
    assert {(r.split, r.label): r.n for r in stats.collect()} == want
    assert all(abs(r.proportion - r.n / (25 if r.split == "test" else 75)) < 1e-12 for r in stats.collect())
    with pytest.raises(FileExistsError):
        PR.write_prepared(rows, path, ["n", "p", "o"])


def test_odd_rows_and_an_empty_dataset(spark):
    rows = spark.createDataFrame([(1, "train", 0), (2, "validation", 1), (3, "train", None), (4, "train", 7)], "uid long, split string, labels int")
    path = shared_path(spark, "prepared")
    PR.write_prepared(rows, path, ["n", "p"])
    stats = PR.read_prepared(spark, path)[1]
    assert stats.filter(F.col("split").isNull()).first()["n"] == 3
    path = shared_path(spark, "prepared")
    PR.write_prepared(rows.limit(0), path, ["n", "p"])
    assert PR.read_prepared(spark, path)[1].agg(F.sum("n")).first()[0] == 0
