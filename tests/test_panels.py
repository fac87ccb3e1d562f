"""Invariants and small frames of the panel operators."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from ampline.functions import scalars as S
from ampline.operators import panel as P
from ampline.operators import quality as Q
from ampline.operators import series as T
from ampline.queries import ORACLE, QUERIES
from ampline.sources.io import write_verified

SF = "/root/testdata/sf0.001"
H = [dt.datetime(2024, 1, 1, h) for h in range(9)]


def test_missing_tokens_and_unpivot(spark):
    df = spark.createDataFrame([(1, "", " 1.5 "), (2, "none", "abc"), (3, "NaN", "inf")], "t int, a string, b string")
    long = T.wide_to_long(df, ["t"])
    assert long.count() == 6
    assert long.where(S.is_missing(F.col("value"))).count() == 4
    assert df.where(S.is_missing_token(F.col("a"))).count() == 3
    assert Q.columns_by_missing(df, ["t"], 50.0) == ["b"]


def test_gaps_at_both_ends(spark):
    values = [1.0, None, None, 2.0, None, 3.0, None, None]
    df = spark.createDataFrame([("a", H[i], v) for i, v in enumerate(values)], "k string, ts timestamp_ntz, v double")
    got = [(r.gap_start.hour, r.gap_length) for r in T.missing_gaps(df, ["k"], "ts", "v").orderBy("gap_start").collect()]
    assert got == [(1, 2), (4, 1), (6, 2)]


def test_grid_fills_an_hour_that_all_lack(spark):
    df = spark.createDataFrame([("a", H[0], 1.0), ("b", H[3], 2.0)], "k string, ts timestamp_ntz, v double")
    full = T.densify(df, ["k"], "ts", "v")
    assert full.count() == 8 and full.where("target_available = 1").count() == 2


def test_rolling_excludes_the_current_row(spark):
    df = spark.createDataFrame([("a", H[i], float(i)) for i in range(5)], "k string, ts timestamp_ntz, v double")
    rows = T.rolling_features(df, ["k"], "ts", "v", [(2, "2")]).orderBy("ts").collect()
    assert [r.rolling_count_2 for r in rows] == [0, 1, 2, 2, 2] and rows[4].rolling_mean_2 == 2.5


def test_constant_site_and_null_have_no_outlier(spark):
    df = spark.createDataFrame([("a", 1.0)] * 4 + [("b", 5.0), ("b", None)], "site string, v double")
    assert {r.is_outlier for r in P.mark_outliers(df, "site", "v").collect()} == {0, None}


def test_zero_actual_has_no_percentage_error(spark):
    r = S.error_columns(spark.createDataFrame([(0.0, 1.0)], "actual double, prediction double")).first()
    assert r.absolute_percentage_error is None and r.error == -1.0


def test_imputation_treats_nan_as_missing(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", float("nan")), ("b", None)], "k string, v double")
    assert sorted((r.k, r.v) for r in T.impute_median(df, "k", ["v"]).collect()) == [("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 2.0)]


def test_written_table_is_checked(spark, tmp_path):
    df = spark.range(10).toDF("id")
    assert write_verified(df, str(tmp_path / "t"), expected=10, keys=["id"]).count() == 10
    with pytest.raises(ValueError):
        write_verified(df, str(tmp_path / "t"), expected=9)


@pytest.mark.parametrize("name", ["mark_outliers", "missing_distribution", "top_gaps", "rolling_features", "filtered_kpi", "unpivot_wide", "impute_median"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "orders", "lineitem", "events"):
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    rel = con.sql(ORACLE[name])
    names = sorted(d[0] for d in rel.description)
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == names
    at = [[d[0] for d in rel.description].index(n) for n in names]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    fine = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    assert sorted((tuple(fine(r[n]) for n in names) for r in df.collect()), key=key) == sorted((tuple(fine(r[i]) for i in at) for r in rel.fetchall()), key=key)
