"""Readers and sinks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def session(name: str = "ampline", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; further settings by name with _ for the dots."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k.replace("_", "."), v)
    return builder.getOrCreate()


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None, infer: bool = False, drop_ragged: bool = False) -> DataFrame:
    """CSV with a header: by schema, inferred (a second pass), or as strings; ragged rows can be dropped."""
    reader = spark.read.option("header", True).option("inferSchema", infer).option("mode", "DROPMALFORMED" if drop_ragged else "PERMISSIVE")
    return (reader.schema(schema) if schema else reader).csv(path)


def csv_header(spark: SparkSession, path: str, sep: str = ",") -> list[str]:
    """Names in the header line of a CSV file, repeats included, as they are written."""
    line = spark.read.text(path).limit(1).first()
    return [c.strip() for c in line["value"].split(sep)] if line else []


def read_raw_rows(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Rows of a CSV file as strings under its header's names; rows with fewer or more fields than the header are dropped.

    Lines are split at each separator (quoted separators are not looked for), so a short row is not filled with nulls.
    """
    header = csv_header(spark, path, sep)
    lines = spark.read.text(path).select(F.split("value", f"\\Q{sep}\\E", -1).alias("f"))
    rows = lines.where((F.size("f") == len(header)) & (F.array_join("f", sep) != sep.join(header)))
    return rows.select(*[F.trim(F.get("f", F.lit(i))).alias(c) for i, c in enumerate(header)])


def scratch_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share: spark.checkpoint.dir; on a local master a temporary one if unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="scratch-")
        spark.conf.set("spark.checkpoint.dir", where)
    return f"{where.rstrip('/')}/panel-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write a table that several branches of a plan read, and read it back; lost executors cost no recomputation."""
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_WRITTEN: dict[tuple, str] = {}


def written_once(spark: SparkSession, name: str, source: str, make) -> DataFrame:
    """The table `name` of a source file: made and written at its first use in a session, read from then on; made anew
    where the source has changed since."""
    path = spark._jvm.org.apache.hadoop.fs.Path(source)
    changed = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getModificationTime()
    key = (spark.sparkContext.applicationId, name, source, changed)
    if key not in _WRITTEN:
        where = scratch_dir(spark)
        make().write.parquet(where)
        _WRITTEN[key] = where
    return spark.read.parquet(_WRITTEN[key])


def show(df: DataFrame, rows: int = 20):
    """Print a batch's first rows; start a console query for a stream and return it."""
    if df.isStreaming:
        return df.writeStream.format("console").option("numRows", rows).outputMode("update").start()
    df.show(rows, truncate=False)
    return None


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def row_count(spark: SparkSession, path: str) -> int:
    """Rows by footers alone; -1 where there is nothing to read."""
    try:
        return spark.read.parquet(path).count()
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return -1
        raise


def write_verified(df: DataFrame, path: str, files: int | None = None, expected: int | None = None, keys: list[str] | None = None, max_records: int | None = None, partition_by: list[str] | None = None) -> DataFrame:
    """Write Parquet, read it back and check it: expected rows, and no key twice. Returns what was read."""
    writer = (df.coalesce(files) if files else df).write.mode("overwrite").option("compression", "snappy")
    if max_records:
        writer = writer.option("maxRecordsPerFile", max_records)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    back = df.sparkSession.read.parquet(path)
    if expected is not None and (n := back.count()) != expected:
        raise ValueError(f"{path}: {n} rows, not {expected}")
    if keys and back.groupBy(*keys).count().where("count > 1").limit(1).count():
        raise ValueError(f"{path}: keys {keys} repeat")
    return back


def artifact_check(spark: SparkSession, expected: dict[str, tuple[DataFrame, int]]) -> DataFrame:
    """Actual against expected rows of each dataset, with PASS or FAIL."""
    rows = [df.agg(F.lit(name).alias("dataset"), F.count("*").alias("actual"), F.lit(n).cast("long").alias("expected")) for name, (df, n) in expected.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.withColumn("status", F.when(F.col("actual") == F.col("expected"), "PASS").otherwise("FAIL"))
