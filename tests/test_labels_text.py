from pyspark.sql import functions as F

from poolsift.functions import text as TX
from poolsift.operators import labels as L
from poolsift.operators import relational as R

# fixed reference category map (last match wins, in this order)
CATS = {"philosophy": [413, 3999, 4044, 5881, 8900, 8901, 10990, 13319], "archaeology": [538, 539, 8601],
        "agriculture": [246], "audio": [677]}


def test_multiclass_last_match(spark):
    names = L.sorted_names(CATS)
    assert names == ["agriculture", "archaeology", "audio", "philosophy", "others"]
    df = spark.createDataFrame([(0, [246]), (1, [246, 677]), (2, [413, 538]), (3, [])], "i int, t array<int>")
    got = [r["y"] for r in df.orderBy("i").select(L.multiclass_last("t", CATS, names).alias("y")).collect()]
    assert got == [0, 2, 1, 4]


def test_binary_overlap_nulls(spark):
    df = spark.createDataFrame([(0, [1, 539]), (1, []), (2, [1, None])], "i int, t array<int>")
    got = [r["y"] for r in df.orderBy("i").select(L.binarize("t", [538, 539, 8601], "overlap").alias("y")).collect()]
    assert got == [1, 0, 0]


def test_concat_text_null(spark):
    df = spark.createDataFrame([(None, "x")], "title string, content string")
    assert df.select(R.concat_text("title", "content").alias("t")).first()["t"] is None


def test_path_and_strategy_parts(spark):
    df = spark.createDataFrame([("../outputs/ablations/num_anchors/r1", "anchored_entropy"),
                                ("../outputs/main/agnews/r1", "random")], "p string, s string")
    rows = df.select(TX.experiment_group("p").alias("g"), TX.fix_strategy_name("s").alias("f")).collect()
    assert [r["g"] for r in rows] == ["ablations-num_anchors", "main"]
    fixed = [r["f"] for r in rows]
    assert fixed == ["anchored_entropy", "noop_random"]
    parts = df.withColumn("f", TX.fix_strategy_name("s")).select(
        TX.name_part("f", "_", 1).alias("a"), TX.name_part("f", "_", 2).alias("b"),
        TX.name_part("f", "_", 3).alias("c"), TX.name_part_or_null("s", "_", 1).alias("d")).collect()
    assert [(r["a"], r["b"], r["c"], r["d"]) for r in parts] == [("anchored", "entropy", "", "entropy"),
                                                                ("noop", "random", "", None)]


def test_map_lookup_misspelt_key(spark):
    df = spark.createDataFrame([("deberta-v3-base",)], "m string")
    out = R.map_lookup(df, "m", {"deberta_v3-base": "DeBERTa"}).first()["m"]
    assert out is None


def test_assign_uid_contiguous(spark):
    df = spark.range(0, 5000, 3).select(F.col("id").alias("doc_id")).repartition(7)
    got = sorted((r["doc_id"], r["uid"]) for r in R.assign_uid(df, "doc_id").collect())
    assert [u for _, u in got] == list(range(len(got)))


def test_format_cells(spark):
    df = spark.createDataFrame([(0.725, 0.125, 999.0), (None, None, 1250.0)], "m double, i double, b double")
    rows = df.select(TX.format_median_iqr("m", "i").alias("c"), TX.format_thousands("b").alias("t")).collect()
    assert rows[0]["c"] == "0.73 ± 0.13" and rows[1]["c"] == ""
    assert rows[0]["t"] == "999" and rows[1]["t"] == "1.3k"


def test_ids_and_length_order_with_sparse_large_ids(spark):
    rows = [(5, 1 << 61), (1, 1 << 62), (5, -7), (2, (1 << 41) + 3), (1, 12), (None, 3)]
    df = spark.createDataFrame(rows, "n int, doc_id long").repartition(3)
    got = {(r.n, r.doc_id): r.position for r in R.assign_uid(df, ["n", "doc_id"], out="position", start=1).collect()}
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert got == {r: i + 1 for i, r in enumerate(want)}
