"""Tables kept by id: lookups leave the table in place, reopen, refuse unfinished folders."""

import pytest
from pyspark.sql import functions as F

from poolsift.session import shared_path
from poolsift.sources import id_tables as IT


def pool(spark, n=500):
    return spark.range(n).select((F.col("id") * 7 % n).alias("uid"), (F.col("id") % 3).alias("label"),
                                 F.array(F.col("id").cast("double")).alias("embedding"))


def table_side_moves(df):
    """Whether an exchange lies above the scan of the table in the physical plan."""
    def above(node, under):
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            return above(node.executedPlan(), under)
        if name.startswith("Scan parquet") and "poolsift_by_id" in node.simpleString(1000):
            return under
        under = under or "Exchange" in name
        return any([above(node.children().apply(i), under) for i in range(node.children().size())])
    return above(df._jdf.queryExecution().executedPlan(), False)


def test_lookups_move_only_the_ids(spark):
    path = shared_path(spark, "by-id-test")
    table = IT.write_id_table(pool(spark), path)
    ids = spark.createDataFrame([(3,), (3,), (499,), (None,), (10_000,)], "uid long")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        semi, anti = IT.rows_by_id(table, ids), IT.rows_without_id(table, ids)
        assert not table_side_moves(semi) and not table_side_moves(anti)
        assert table_side_moves(table.repartition(3))   # the test sees exchanges
        assert sorted(r.uid for r in semi.collect()) == [3, 499]
        assert sorted(r.uid for r in anti.collect()) == [i for i in range(500) if i not in (3, 499)]
        assert tuple(IT.split_sizes(table, ids).first()) == (2, 498)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    again = IT.read_id_table(spark, path)
    assert again.schema == table.schema and sorted(map(tuple, again.collect())) == sorted(map(tuple, pool(spark).collect()))


def test_repeated_null_and_no_ids(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, None)], "uid long, label string")
    table = IT.write_id_table(rows, shared_path(spark, "by-id-test"), buckets=3)
    assert sorted(r.label for r in IT.rows_by_id(table, rows.limit(0).union(rows.filter("uid = 1"))).collect()) == ["a", "b"]
    assert IT.rows_without_id(table, rows.limit(0)).count() == 3
    empty = IT.write_id_table(rows.limit(0), shared_path(spark, "by-id-test"))
    assert IT.rows_by_id(empty, rows).count() == 0 and tuple(IT.split_sizes(empty, rows).first()) == (0, 0)
    with pytest.raises(Exception, match="uid is null"):
        IT.write_id_table(spark.createDataFrame([(None, "x")], "uid long, label string"), shared_path(spark, "by-id-test"))


def test_an_unfinished_or_existing_folder_is_refused(spark):
    path = shared_path(spark, "by-id-test")
    with pytest.raises(FileNotFoundError):
        IT.read_id_table(spark, path)
    IT.write_id_table(pool(spark, 10), path)
    with pytest.raises(Exception):
        IT.write_id_table(pool(spark, 10), path)
    assert IT.read_id_table(spark, path).count() == 10
