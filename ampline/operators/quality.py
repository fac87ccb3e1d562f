"""Data-quality reports: missing rates, profiles, coverage, duplicates, references between tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ampline.functions.scalars import bucket, is_missing, percent

# Bounds of the missing-rate classes, in percent.
RATE_CLASSES = [(0.0, "0%"), (10.0, "0-10%"), (30.0, "10-30%"), (50.0, "30-50%"), (80.0, "50-80%"), (99.9999999999, "80-100%")]
RATE_ORDER = [label for _, label in RATE_CLASSES] + ["100%"]


def missing_rate_by_entity(df: DataFrame, entity: str, value: str) -> DataFrame:
    """Rows, missing rows and missing percentage of each entity."""
    miss = F.count_if(is_missing(F.col(value)))
    return df.groupBy(entity).agg(F.count("*").alias("total"), miss.alias("missing"), percent(miss, F.count("*")).alias("missing_rate"))


def missing_distribution(rates: DataFrame, rate: str = "missing_rate") -> DataFrame:
    """Entities in each class of missing rate, with the class's rank."""
    label = bucket(F.col(rate), RATE_CLASSES, "100%")
    rank = reduce(lambda c, i: c.when(F.col("rate_class") == RATE_ORDER[i], i), range(1, len(RATE_ORDER)), F.when(F.col("rate_class") == RATE_ORDER[0], 0))
    return rates.select(label.alias("rate_class")).groupBy("rate_class").agg(F.count("*").alias("entities")).withColumn("class_rank", rank)


def filter_entities_by_missing(df: DataFrame, entity: str, value: str, threshold: float = 50.0) -> DataFrame:
    """Rows of entities whose missing rate is at most the threshold; a semi join, so the decision stays in the plan."""
    kept = missing_rate_by_entity(df, entity, value).where(F.col("missing_rate") <= threshold).select(entity)
    return df.join(kept, entity, "left_semi")


def columns_by_missing(df: DataFrame, ids: list[str], threshold: float = 50.0) -> list[str]:
    """Wide form: the value columns whose missing rate is at most the threshold. One aggregation, one row collected."""
    values = [c for c in df.columns if c not in ids]
    row = df.agg(F.count("*").alias("n"), *[F.count_if(is_missing(F.col(f"`{c}`").try_cast("double"))).alias(f"m{i}") for i, c in enumerate(values)]).first()
    return [c for i, c in enumerate(values) if row["n"] and 100.0 * row[f"m{i}"] / row["n"] <= threshold]


def keep_columns(df: DataFrame, ids: list[str], threshold: float = 50.0) -> DataFrame:
    """Wide form: the ids and the value columns whose missing rate is at most the threshold."""
    return df.select(*[F.col(f"`{c}`") for c in [*ids, *columns_by_missing(df, ids, threshold)]])


def order_by_list(df: DataFrame, column: str, order: list) -> DataFrame:
    """Rows sorted by their value's place in a list; values that it lacks come last, by value."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(column))
    return df.orderBy(F.when(place > 0, place).otherwise(len(order) + 1), column)


def feature_audit(parts: dict[str, DataFrame], features: list[str]) -> DataFrame:
    """Rows and missing values of each feature in each part of a split."""
    rows = [null_profile(df, features).withColumn("part", F.lit(name)) for name, df in parts.items()]
    return reduce(DataFrame.unionByName, rows)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def duplicate_columns(header: list[str]) -> dict[str, int]:
    """Names that a header holds more than once."""
    return {c: header.count(c) for c in dict.fromkeys(header) if header.count(c) > 1}


def matched(fact: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Distinct keys that both tables hold."""
    return fact.select(key).distinct().join(dim.select(key).distinct(), key)


def unmatched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of left without a partner in right."""
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), keys, "left_anti")


def null_profile(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Missing values of each column, over the table or by key."""
    aggs = [F.count_if(is_missing(F.col(c)) if t in ("double", "float") else F.col(c).isNull()).alias(f"{c}_missing") for c, t in df.select(*columns).dtypes]
    grouped = df.groupBy(*(by or []))
    return grouped.agg(F.count("*").alias("rows"), *aggs)


def value_minmax(df: DataFrame, columns: list[str]) -> DataFrame:
    """Least and greatest value of each column in one pass."""
    return df.agg(*[f(F.when(~is_missing(F.col(c)), F.col(c))).alias(f"{c}_{n}") for c in columns for n, f in (("min", F.min), ("max", F.max))])


def negative_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*[F.count_if((F.col(c) < 0) & ~is_missing(F.col(c))).alias(f"{c}_negative") for c in columns])


def zero_rate(df: DataFrame, by: str, value: str) -> DataFrame:
    zero = F.count_if(F.col(value) == 0)
    return df.groupBy(by).agg(F.count("*").alias("rows"), zero.alias("zeros"), percent(zero, F.count("*")).alias("zero_rate"))


def time_coverage(df: DataFrame, key: str, time: str, expected: int) -> DataFrame:
    """Rows, distinct times, first, last, missing times and coverage percentage of each key."""
    n = F.countDistinct(time)
    return df.groupBy(key).agg(F.count("*").alias("rows"), n.alias("times"), F.min(time).alias("first_time"), F.max(time).alias("last_time"), (F.lit(expected) - n).alias("missing_times"), percent(n, F.lit(float(expected))).alias("coverage"))


def interval_check(df: DataFrame, time: str, seconds: int = 3600, keys: list[str] | None = None) -> DataFrame:
    """Neighbouring distinct times of a key that are not one step apart. Without keys the distinct times of the whole
    table are one series: as many rows as there are steps, however many entities there are."""
    keys = keys or []
    times = df.select(*keys, time).distinct()
    before = F.lag(time).over(W.partitionBy(*keys).orderBy(time))
    gap = F.unix_seconds(F.col(time).cast("timestamp")) - F.unix_seconds(F.col("previous").cast("timestamp"))
    return times.withColumn("previous", before).withColumn("seconds", gap).where(F.col("seconds") != seconds)


def before_after_counts(before: DataFrame, after: DataFrame, site: str, entity: str) -> DataFrame:
    """Distinct entities of each site before and after a filter, and how many went."""
    a = before.groupBy(site).agg(F.countDistinct(entity).alias("before"))
    b = after.groupBy(site).agg(F.countDistinct(entity).alias("after"))
    return a.join(b, site, "left").fillna(0, ["after"]).withColumn("removed", F.col("before") - F.col("after"))


def raw_token_frequency(df: DataFrame, column: str, k: int = 20) -> DataFrame:
    """The most frequent raw strings of a column (a top-k report; ties by the string)."""
    return df.groupBy(F.col(column).alias("token")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_first("token")).limit(k)
