"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Letters, digits of ASCII and everything beyond ASCII (after lower-casing A-Z).
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What lower() changes besides A-Z.
ODD_CAPITALS = r"[^\x00-\x7F&&[\p{javaUpperCase}\p{javaTitleCase}]]"
#: Runs without ASCII white space.
RUN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 2048, size: int = 8 << 20) -> None:
    """Bound the Arrow batches that workers get, by rows and by bytes, since one text may be very long; and let Spark
    delete a query's shuffle files once the query has ended (what later queries need is in written tables)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def shared_dir(spark: SparkSession) -> str:
    """Folder shared by driver and executors: spark.checkpoint.dir, or else the context's checkpoint folder. On a local
    master, where all share one machine, a fresh temporary one where neither is set; elsewhere that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not where:
        current = sc._jsc.sc().getCheckpointDir()
        if current.isDefined():
            where = current.get()
        elif sc.master.startswith("local[") or sc.master == "local":
            where = tempfile.mkdtemp(prefix="ckpt-")
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: lineage ends in the shared folder, so a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


STAGED: list[str] = []


def stage(df: DataFrame) -> DataFrame:
    """Write a table in the shared folder and read it back: a cut in lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/ampline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    STAGED.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def delete_staged(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that stage() has written, by path."""
    jvm = spark._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        STAGED.remove(p)


def release(*tables: DataFrame) -> None:
    """Delete tables that stage() has written, once nothing will read them again."""
    for t in tables:
        if t.staged_path in STAGED:
            delete_staged(t.sparkSession, [t.staged_path])


def clear_stages(spark: SparkSession, since: int = 0, keep: tuple[DataFrame, ...] = ()) -> None:
    """Delete the tables that stage() has written since it had written so many, but for `keep`; results that still need
    one of the others fail afterwards."""
    kept = {t.staged_path for t in keep}
    delete_staged(spark, [p for p in STAGED[since:] if p not in kept])


HELD: list[Broadcast] = []


def hold(broadcast: Broadcast) -> Broadcast:
    """Frees executors of the broadcasts held before; one that is used once more is sent anew."""
    while HELD:
        HELD.pop().unpersist()
    HELD.append(broadcast)
    return broadcast


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. The fast lower() does the same for texts without capitals beyond ASCII."""
    return F.when(c.rlike(ODD_CAPITALS), F.translate(c, UPPER, UPPER.lower())).otherwise(F.lower(c))


def words(c: Column) -> Column:
    """The matches of WORD in the lower-cased text; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(c, F.lit(""))), NOT_WORD), "")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges: (node, component), component = smallest node reachable.

    Alternates hooking of every node to the smallest label among its neighbours with pointer jumping, so the number
    of rounds grows with the logarithm of a component's diameter. Each round is a few joins and aggregations on the
    nodes that have a link at all; tables between rounds are written in the shared folder and deleted when the next one
    is. Self-loops and repeated edges are allowed. Nothing but the number of changed labels reaches the driver.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    both = stage(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = stage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("l")))
    while True:
        # the smallest label next to each node
        near = both.join(labels.select(F.col("u").alias("v"), "l"), "v").groupBy("u").agg(F.min("l").alias("m"))
        seen = stage(labels.join(near, "u").select("u", "l", F.least("l", "m").alias("m")))
        # what a neighbour knows also goes to the node that has been the label so far
        told = seen.groupBy(F.col("l").alias("u")).agg(F.min("m").alias("t"))
        hooked = stage(seen.join(told, "u", "left").select("u", F.col("l").alias("old"), F.least("m", F.coalesce("t", "m")).alias("l")))
        up = hooked.select(F.col("u").alias("l"), F.col("l").alias("g"))
        step = stage(hooked.join(up, "l", "left").select("u", "old", F.least("l", F.coalesce("g", "l")).alias("l")))
        release(labels, seen, hooked)
        labels = step
        if not step.where("old <> l").limit(1).count():
            release(both)
            out = step.select(F.col("u").alias("node"), F.col("l").alias("component"))
            out.staged_path = step.staged_path
            return out
