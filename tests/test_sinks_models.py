"""Files, sinks, saved models, joins and the stream, on small frames."""

import datetime as dt
import json
import os
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from ampline.functions import scalars as S
from ampline.operators import models as M
from ampline.operators import panel as P
from ampline.operators import quality as Q
from ampline.operators import series as T
from ampline.queries import QUERIES
from ampline.sources import io, store
from ampline.streaming.hourly import hourly_trend

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the clients go to the workers
SF = "/root/testdata/sf0.001"
H = [dt.datetime(2024, 1, 1, h) for h in range(9)]


def test_csv_readers(spark, tmp_path):
    path = tmp_path / "dirty.csv"
    path.write_text("timestamp,a,b,a\n1, 1.5 ,x,2\n2,,y,3\n3,4\n4,5,z,6,7\n")
    assert io.csv_header(spark, str(path)) == ["timestamp", "a", "b", "a"] and Q.duplicate_columns(io.csv_header(spark, str(path))) == {"a": 2}
    path.write_text("t,a,b\n1, 1.5 ,x\n2,,y\n3,4\n4,5,z,6\n")
    assert [tuple(r) for r in io.read_raw_rows(spark, str(path)).orderBy("t").collect()] == [("1", "1.5", "x"), ("2", "", "y")]
    assert io.read_csv(spark, str(path)).dtypes == [("t", "string"), ("a", "string"), ("b", "string")]
    assert io.read_csv(spark, str(path), infer=True).dtypes[0] == ("t", "int")
    assert len(io.read_csv(spark, str(path), "t int, a double, b string", drop_ragged=True).collect()) <= 3
    assert io.row_count(spark, f"{SF}/region.parquet") == 5 and io.row_count(spark, str(tmp_path / "none")) == -1


def test_files_and_chunks(spark, tmp_path):
    df = spark.range(100, numPartitions=7).withColumn("k", F.col("id") % 3)
    parts = lambda d: [f for _, _, names in os.walk(d) for f in names if f.endswith(".snappy.parquet")]
    assert io.write_verified(df, str(tmp_path / "one"), files=1, expected=100).count() == 100 and len(parts(tmp_path / "one")) == 1
    io.write_verified(df, str(tmp_path / "chunks"), files=1, max_records=30)
    assert len(parts(tmp_path / "chunks")) == 4
    assert io.write_verified(df, str(tmp_path / "by"), partition_by=["k"], keys=["id"]).where("k = 1").count() == 33
    with pytest.raises(ValueError):
        io.write_verified(df.unionByName(df), str(tmp_path / "twice"), keys=["id"])


class Client:
    """Writes batches as files; refuses each task's first one once."""

    def __init__(self, folder):
        self.folder, self.n, self.refused = folder, 0, False

    def write(self, lines):
        if not self.refused:
            self.refused = True
            raise ConnectionError("busy")
        self.n += 1
        with open(os.path.join(self.folder, f"{os.getpid()}-{id(self)}-{self.n}-{len(lines)}"), "w") as f:
            json.dump(lines, f)

    def close(self):
        pass


@pytest.mark.parametrize("parallel", [1, 4])
def test_points_reach_the_store(spark, tmp_path, parallel):
    rows = [("a b", H[i % 9], float(i), i if i % 2 else None) for i in range(250)]
    df = spark.createDataFrame(rows, "site string, ts timestamp_ntz, v double, n long").repartition(2)
    lines = df.select(store.line("load", ["site"], ["v", "n"], "ts").alias("line"))
    folder = str(tmp_path)
    points, batches, again = store.write_points(lines, lambda: Client(folder), batch=40, wait=0.01, parallel=parallel)
    got = [x for f in os.listdir(folder) for x in json.load(open(os.path.join(folder, f)))]
    assert points == len(got) == 250 and again == 2 and batches == len(os.listdir(folder))
    assert max(int(f.rsplit("-", 1)[1]) for f in os.listdir(folder)) == 40
    assert "load,site=a\\ b v=1.0,n=1i 1704070800000000000" in got and "load,site=a\\ b v=0.0 1704067200000000000" in got


class Dead(Client):
    def write(self, lines):
        raise ConnectionError("gone")


def test_a_dead_store_fails_the_job(spark, tmp_path):
    folder = str(tmp_path)
    with pytest.raises(Exception, match="gone"):
        store.write_points(spark.createDataFrame([("x",)], "line string"), lambda: Dead(folder), retries=1, wait=0.01)


def test_console(spark, capsys):
    assert io.show(spark.range(1)) is None
    query = io.show(spark.readStream.format("rate").load())
    query.stop()


def test_saved_model_scores_alike(spark, tmp_path):
    rows = [(site, float(i), 3.0 * i + shift) for site, shift in (("a", 0.0), ("b", 10.0)) for i in range(30)]
    train = spark.createDataFrame(rows, "site string, x double, actual double")
    for kind in ("linear", "forest"):
        model = M.pipeline(kind, ["x"], "site").fit(train)
        M.save_model(model, str(tmp_path / kind))
        test = spark.createDataFrame([("a", 5.0, 15.0), ("never seen", 5.0, 0.0)], "site string, x double, actual double")
        first, again = M.score(model, test).collect(), M.score(M.load_model(str(tmp_path / kind)), test).collect()
        assert first == again and len(first) == 2  # an unseen category has a slot of its own
    m = M.metrics(M.score(M.pipeline("linear", ["x"], "site").fit(train), train))
    assert m["rmse"] < 1e-6 and m["r2"] == pytest.approx(1.0) and m["mae"] < 1e-6


def test_best_penalty_is_refitted(spark):
    rows = [(float(i), 2.0 * i + (i % 3)) for i in range(60)]
    df = spark.createDataFrame(rows, "x double, actual double")
    train, validation = df.where("x < 40"), df.where("x >= 40")
    best, results = M.tune_ridge(train, validation, ["x"], None)
    assert best == min(results, key=lambda r: r[1])[0] and len(results) == 4
    _, out = M.refit_ridge(df, validation, best, ["x"], None)
    assert out.count() == 20
    assert not train.is_cached


def test_dimension_mismatch(spark):
    fact = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id int, v string")
    dim = spark.createDataFrame([(1, "p"), (2, "q"), (2, "q2"), (9, "r")], "id int, name string")
    assert sorted((r.id, r.present) for r in P.existence_flag(fact, dim, ["id"]).collect()) == [(1, 1), (2, 1), (3, 0)]
    assert P.inner_on(fact, dim, ["id"], ["name"]).count() == 3 and P.enrich(fact, dim, "id").count() == 4
    assert [r.id for r in Q.unmatched(dim, fact, ["id"]).collect()] == [9]
    assert {r.id: r.name for r in P.constant_by(dim.unionByName(spark.createDataFrame([(1, None)], "id int, name string")), ["id"], ["name"]).collect()}[1] == "p"


def test_wide_table_without_kept_columns(spark):
    df = spark.createDataFrame([(1, "", "1"), (2, "none", "2")], "t int, a string, b string")
    assert Q.keep_columns(df, ["t"]).columns == ["t", "b"] and T.wide_to_long(df.select("t"), ["t"]).count() == 0
    assert S.not_blank(df, "a").count() == 1


def test_times_ties_and_wind(spark):
    df = spark.createDataFrame([("2024-01-02 03:04:05",), ("02/01/2024 03:04",), ("soon",), (None,)], "t string")
    got = [r.t for r in df.select(S.parse_timestamp(F.col("t")).alias("t")).collect()]
    assert got == [dt.datetime(2024, 1, 2, 3, 4, 5), dt.datetime(2024, 1, 2, 3, 4), None, None]
    tied = spark.createDataFrame([("b", 2.0), ("a", 2.0), ("c", 3.0), ("d", 2.0)], "k string, e double")
    assert [r.k for r in P.top(tied, [F.desc("e"), F.col("k")], 3).collect()] == ["c", "a", "b"]
    wind = spark.createDataFrame([(0.0,), (90.0,), (180.0,), (270.0,), (360.0,), (None,)], "d double").withColumns(S.angle_to_vector(F.col("d"), "w"))
    assert [(None if r.w_sin is None else (round(r.w_sin, 9) + 0.0, round(r.w_cos, 9) + 0.0)) for r in wind.collect()] == [(0, 1), (1, 0), (0, -1), (-1, 0), (0, 1), None]
    irregular = spark.createDataFrame([("a", H[0]), ("a", H[1]), ("a", H[1]), ("a", H[3])], "k string, ts timestamp_ntz")
    assert [(r.ts, r.seconds) for r in Q.interval_check(irregular, "ts", keys=["k"]).collect()] == [(H[3], 7200)]
    assert Q.duplicate_keys(irregular, ["k", "ts"]).count() == 1


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.limit(300).repartition(3).write.parquet(str(tmp_path / "in"))
    batch = hourly_trend(spark.read.parquet(str(tmp_path / "in")), "event_type", "ts", "value")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = hourly_trend(stream, "event_type", "ts", "value", "60 days").writeStream.outputMode("complete").format("memory").queryName("trend").start()
    query.processAllAvailable()
    query.stop()
    key = lambda df: sorted((r.site, r.ts, round(r.total, 6), r.records) for r in df.collect())
    assert key(spark.table("trend")) == key(batch)


def test_reports_read_a_table_that_is_written_once(spark, tmp_path):
    source, made = str(tmp_path / "a.parquet"), []

    def make():
        made.append(1)
        return spark.read.parquet(source)

    spark.range(3).write.parquet(source)
    first = [io.written_once(spark, "t", source, make).count() for _ in range(2)]
    os.utime(source, (1, 1))
    spark.range(5).write.mode("append").parquet(source)
    assert (first, io.written_once(spark, "t", source, make).count(), len(made)) == ([3, 3], 8, 2)


SCANS = {"impute_median": 3, "rolling_features": 2, "mark_outliers": 2, "kpi": 1}


@pytest.mark.parametrize("name", SCANS)
def test_plans_read_their_panel_few_times(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert 1 <= plan.count("FileScan") <= SCANS[name], plan
