"""Panels: enrichment, site-hour and site-day aggregates, outliers by interquartile range, error reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampline.functions.scalars import bucket, percent

# Classes of a site's outlier rate, in percent.
OUTLIER_CLASSES = [(0.0, "0%"), (1.0, "0-1%"), (5.0, "1-5%"), (10.0, "5-10%")]


def enrich(fact: DataFrame, dim: DataFrame, key: str, exogenous: DataFrame | None = None, on: list[str] | None = None) -> DataFrame:
    """Left joins that keep the fact's rows; the optimizer broadcasts a side that is small enough."""
    out = fact.join(dim, key, "left")
    return out if exogenous is None else out.join(exogenous, on, "left")


def existence_flag(left: DataFrame, right: DataFrame, keys: list[str], name: str = "present") -> DataFrame:
    """Left rows with 1 where right has their keys, else 0; right's rows are made distinct first, so left's number stays."""
    there = right.select(*keys).distinct().withColumn(name, F.lit(1))
    return left.join(there, keys, "left").withColumn(name, F.coalesce(F.col(name), F.lit(0)))


def inner_on(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Left rows that right has the keys of, with right's columns: a test set and its features."""
    return left.join(right.select(*keys, *columns), keys)


def constant_by(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Attributes that do not vary within a key: the first value that is not null."""
    return df.groupBy(*keys).agg(*[F.first(c, ignorenulls=True).alias(c) for c in columns])


def site_hourly(df: DataFrame, site: str, entity: str, time: str, value: str, exogenous: tuple[str, ...] = ()) -> DataFrame:
    """Total and number of active entities of each site and hour; entities are summed up first, so each counts once.

    exogenous: columns that are the same for all entities of a site and hour; they are carried along.
    """
    carried = [F.first(c, ignorenulls=True).alias(c) for c in exogenous]
    each = df.groupBy(F.col(site).alias("site"), F.col(entity).alias("entity"), F.date_trunc("hour", time).cast("timestamp_ntz").alias("ts")).agg(F.sum(value).alias("v"), *carried)
    return each.groupBy("site", "ts").agg(F.sum("v").alias("total"), F.count("*").alias("active"), *carried)


def site_daily(hourly: DataFrame, exogenous: tuple[str, ...] = ()) -> DataFrame:
    """Daily sums, means and extremes of site-hours, with the means of exogenous columns."""
    means = [F.avg(c).alias(f"avg_{c}") for c in exogenous]
    return hourly.groupBy("site", F.to_date("ts").alias("date")).agg(F.sum("total").alias("total"), F.avg("total").alias("mean"), F.min("total").alias("least"), F.max("total").alias("most"), F.max("active").alias("active"), F.count("*").alias("hours"), *means)


def iqr_bounds(df: DataFrame, site: str, value: str, exact: bool = False, accuracy: int = 10_000, factor: float = 1.5) -> DataFrame:
    """Quartiles of each site and the bounds factor times their distance beyond them.

    By default the quartiles come from a sketch of bounded size (rank error 1 / accuracy). exact: interpolated ones, for
    which a site's distinct values are held in one buffer; for panels, not for raw readings.
    """
    q = (lambda p: F.percentile(F.col(value), p)) if exact else (lambda p: F.percentile_approx(F.col(value), p, accuracy))
    out = df.groupBy(site).agg(q(0.25).alias("q1"), q(0.75).alias("q3"))
    width = (F.col("q3") - F.col("q1")) * factor
    return out.withColumns({"lower_bound": F.col("q1") - width, "upper_bound": F.col("q3") + width})


def mark_outliers(df: DataFrame, site: str, value: str, side: str = "both", **options) -> DataFrame:
    """Bounds and is_outlier (NULL for a NULL value): strictly beyond a bound, or above the upper one only."""
    joined = df.join(iqr_bounds(df, site, value, **options), site, "left")
    v = F.col(value)
    hit = v > F.col("upper_bound")
    if side == "both":
        hit = hit | (v < F.col("lower_bound"))
    return joined.withColumn("is_outlier", hit.cast("int"))


def outlier_summary(marked: DataFrame, site: str) -> DataFrame:
    n = F.sum("is_outlier")
    return marked.groupBy(site).agg(F.count("*").alias("rows"), n.alias("outliers"), percent(n, F.count("*")).alias("outlier_rate"))


def outlier_rate_groups(summary: DataFrame) -> DataFrame:
    return summary.groupBy(bucket(F.col("outlier_rate"), OUTLIER_CLASSES, ">10%").alias("rate_class")).agg(F.count("*").alias("sites"), F.sum("outliers").alias("outliers"))


def top(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """A top-k report; the order must be total."""
    return df.orderBy(*order).limit(k)


def error_report(df: DataFrame, by: list[str] | None = None, error: str = "error") -> DataFrame:
    """Rows, MAE, RMSE, greatest absolute error and sum of squares, over the table or by key."""
    e = F.col(error)
    return df.groupBy(*(by or [])).agg(F.count("*").alias("records"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.max(F.abs(e)).alias("max_abs_error"), F.sum(e * e).alias("sse"))


def sse_share(df: DataFrame, flag: str = "is_outlier", error: str = "error") -> DataFrame:
    """Share of the squared error that flagged rows have."""
    sq = F.col(error) * F.col(error)
    part = F.sum(F.when(F.col(flag) == 1, sq).otherwise(0.0))
    return df.agg(F.sum(sq).alias("sse"), part.alias("flagged_sse"), percent(part, F.sum(sq)).alias("share"))


def rollup(df: DataFrame, by: Column, name: str, how: str = "sum") -> DataFrame:
    """Actual and predicted consumption by a key, with MAE, RMSE and records."""
    f = {"sum": F.sum, "avg": F.avg}[how]
    e = F.col("error")
    return df.groupBy(by.alias(name)).agg(f("actual").alias("actual"), f("prediction").alias("predicted"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.count("*").alias("records"))
