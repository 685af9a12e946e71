"""Registered queries against their DuckDB SQL twins on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
KEYS = ["anchored_entropy", "random_query", "initial_budget", "stratified_sample", "metrics_perclass",
        "calibration", "running_auc", "budget_match", "class_stats_total", "label_multiclass_last",
        "kmeanspp_pick", "early_stop_step"]
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def _rows(pdf):
    def norm(v):
        if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return None
        return v.item() if hasattr(v, "item") else v
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(norm(x) for x in r) for r in pdf[cols].itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    got = _rows(E.queries()[key](spark, SF).toPandas())
    exp = _rows(con.execute(E.oracle_sql()[key]).df())
    assert got == exp
