"""Series operators: reshaping, dense grids, gaps, lags, rolling frames, imputation, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ampline.functions.scalars import bucket, clean, is_missing, to_number

# Classes of gap lengths, in steps.
GAP_CLASSES = [(1, "1"), (3, "2-3"), (6, "4-6"), (24, "7-24"), (72, "25-72")]


def wide_to_long(df: DataFrame, ids: list[str], names: str = "entity", values: str = "value") -> DataFrame:
    """Unpivot all columns but ids, as lenient numbers; missing values stay as NULL rows. Ids alone make no rows."""
    meters = [c for c in df.columns if c not in ids]
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    if not meters:
        return df.select(*[quoted(c) for c in ids], F.lit("").alias(names), F.lit(None).cast("double").alias(values)).limit(0)
    numbers = df.select(*[quoted(c) for c in ids], *[to_number(quoted(c).cast("string")).alias(c) for c in meters])
    return numbers.unpivot([quoted(c) for c in ids], [quoted(c) for c in meters], names, values)


def long_to_wide(df: DataFrame, ids: list[str], names: str, values: str, columns: list[str]) -> DataFrame:
    """Pivot to the listed columns, summing values that share a cell."""
    return df.groupBy(*ids).pivot(names, columns).agg(F.sum(values))


def grid(df: DataFrame, keys: list[str], time: str, step: str = "1 hour") -> DataFrame:
    """Every key at every step from the table's first to its last time (two values, found at once)."""
    ends = df.agg(F.min(time).cast("string").alias("a"), F.max(time).cast("string").alias("b")).first()
    kind = df.schema[time].dataType
    one = df.sparkSession.range(1).select(F.lit(ends["a"]).cast(kind).alias("a"), F.lit(ends["b"]).cast(kind).alias("b"))
    axis = one.select(F.explode(F.expr(f"sequence(a, b, interval {step})")).alias(time))
    return df.select(*keys).distinct().crossJoin(F.broadcast(axis))  # one row a step of the axis


def densify(df: DataFrame, keys: list[str], time: str, value: str, step: str = "1 hour") -> DataFrame:
    """Left join of the table onto the grid, with target_available. The table is read for its ends, its keys and the join:
    materialize() an expensive one first."""
    full = grid(df, keys, time, step).join(df, [*keys, time], "left")
    return full.withColumn("target_available", (~is_missing(F.col(value))).cast("int"))


def lag_features(dense: DataFrame, keys: list[str], time: str, value: str, lags: list[tuple[int, str]]) -> DataFrame:
    """Values of earlier rows of a dense panel, and lag_ready: target and all lags are there."""
    w = W.partitionBy(*keys).orderBy(time)
    out = dense.withColumns({f"lag_{n}": F.lag(value, k).over(w) for k, n in lags})
    ready = F.col(value).isNotNull()
    for _, n in lags:
        ready = ready & F.col(f"lag_{n}").isNotNull()
    return out.withColumn("lag_ready", ready.cast("int"))


def rolling_features(dense: DataFrame, keys: list[str], time: str, value: str, frames: list[tuple[int, str]]) -> DataFrame:
    """Mean and count of the rows before the current one; rolling_ready: every frame is full."""
    w = W.partitionBy(*keys).orderBy(time)
    new, ready = {}, F.col(value).isNotNull()
    for k, n in frames:
        frame = w.rowsBetween(-k, -1)
        new |= {f"rolling_mean_{n}": F.avg(value).over(frame), f"rolling_count_{n}": F.count(value).over(frame)}
    out = dense.withColumns(new)
    for k, n in frames:
        ready = ready & (F.col(f"rolling_count_{n}") == k)
    return out.withColumn("rolling_ready", ready.cast("int"))


def missing_gaps(dense: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """Runs of missing rows of a dense panel: length, start and end. Present rows so far number the islands."""
    w = W.partitionBy(*keys).orderBy(time).rowsBetween(W.unboundedPreceding, 0)
    miss = is_missing(F.col(value))
    islands = dense.select(*keys, time, miss.alias("__m"), F.sum((~miss).cast("int")).over(w).alias("__i")).where("__m")
    return islands.groupBy(*keys, "__i").agg(F.count("*").alias("gap_length"), F.min(time).alias("gap_start"), F.max(time).alias("gap_end")).drop("__i")


def gap_classes(gaps: DataFrame) -> DataFrame:
    return gaps.select(bucket(F.col("gap_length"), GAP_CLASSES, ">72").alias("gap_class"), "gap_length").groupBy("gap_class").agg(F.count("*").alias("gaps"), F.sum("gap_length").alias("steps"))


def impute_median(df: DataFrame, group: str, columns: list[str], exact: bool = True, present: DataFrame | None = None) -> DataFrame:
    """Missing values by the group's median, else by the table's. Medians are of present values only.

    present: a table with all the present values (a panel before it was densified), which spares reading df again.
    """
    median = (lambda c: F.percentile(c, 0.5)) if exact else (lambda c: F.percentile_approx(c, 0.5, 100_000))
    own = df.withColumns({c: clean(F.col(c)) for c in columns})
    have = own if present is None else present.withColumns({c: clean(F.col(c)) for c in columns})
    by = have.groupBy(group).agg(*[median(F.col(c)).alias(f"__g_{c}") for c in columns])
    all_ = have.agg(*[median(F.col(c)).alias(c) for c in columns]).first()  # one row
    joined = own.join(by, group, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.col(f"__g_{c}"), F.lit(all_[c])) for c in columns}).drop(*[f"__g_{c}" for c in columns])


def time_split(df: DataFrame, time: str, at: str) -> tuple[DataFrame, DataFrame]:
    """Rows before a moment, and from it on."""
    moment = F.lit(at).cast(df.schema[time].dataType)
    return df.where(F.col(time) < moment), df.where(F.col(time) >= moment)
