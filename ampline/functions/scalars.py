"""Scalar helpers: missing values, lenient numbers, buckets, calendar and cyclical features, error columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Raw writings of a missing number, trimmed and lower-cased.
MISSING_TOKENS = ("", "null", "none", "na", "nan", "n/a")


def is_missing(c: Column) -> Column:
    """NULL or NaN."""
    return c.isNull() | F.isnan(c)


def clean(c: Column) -> Column:
    """NaN becomes NULL, so that aggregates skip it."""
    return F.when(~F.isnan(c), c)


def to_number(c: Column) -> Column:
    """A raw string as double; what is no number is NULL."""
    return c.try_cast("double")


def is_missing_token(c: Column) -> Column:
    """Whether a raw string stands for a missing number."""
    t = F.lower(F.trim(c))
    return F.coalesce(t.isin(*MISSING_TOKENS) | is_missing(to_number(c)), F.lit(True))


def parse_timestamp(c: Column, formats: tuple[str, ...] = ("yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy HH:mm")) -> Column:
    """A raw string as timestamp without zone, by the first format that fits; else NULL."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats]).cast("timestamp_ntz")


def shift_hours(c: Column, hours: float) -> Column:
    """A local time as another zone's, some hours earlier (negative) or later."""
    return c + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(int(round(hours * 60))))


def day_range(start: str, stop: str | None = None) -> tuple[Column, Column]:
    """Half-open interval of one date, or of two with both their days."""
    day = lambda d: F.to_date(F.lit(d))
    return day(start).cast("timestamp_ntz"), F.date_add(day(stop or start), 1).cast("timestamp_ntz")


def column_or_null(df: DataFrame, name: str, kind: str = "double") -> Column:
    """A table's column, or NULL of that type if it has none of that name."""
    return F.col(name).cast(kind).alias(name) if name in df.columns else F.lit(None).cast(kind).alias(name)


def not_blank(df: DataFrame, column: str) -> DataFrame:
    """Rows whose string has something besides white space."""
    return df.where(F.length(F.trim(F.col(column))) > 0)


def percent(part: Column, whole: Column) -> Column:
    """part / whole * 100; NULL where whole is 0."""
    return F.try_divide(part * F.lit(100.0), whole)


def bucket(c: Column, rules: list[tuple[float, str]], last: str) -> Column:
    """Label of the first bound that c does not exceed."""
    out = None
    for bound, label in rules:
        out = F.when(c <= bound, label) if out is None else out.when(c <= bound, label)
    return out.otherwise(last)


def calendar(ts: str) -> dict[str, Column]:
    """Year, month, day, hour, weekday (1 is Sunday), quarter and weekend flag of a timestamp column."""
    t = F.col(ts)
    dow = F.dayofweek(t)
    return {"year": F.year(t), "month": F.month(t), "day": F.dayofmonth(t), "hour": F.hour(t), "day_of_week": dow, "quarter": F.quarter(t), "is_weekend": dow.isin(1, 7).cast("int")}


def cyclical(value: Column, period: float, name: str) -> dict[str, Column]:
    """Sine and cosine of a value on a circle of the given period."""
    angle = value * F.lit(2.0) * F.pi() / F.lit(float(period))
    return {f"{name}_sin": F.sin(angle), f"{name}_cos": F.cos(angle)}


def angle_to_vector(degrees: Column, name: str) -> dict[str, Column]:
    """Sine and cosine of an angle in degrees."""
    return {f"{name}_sin": F.sin(F.radians(degrees)), f"{name}_cos": F.cos(F.radians(degrees))}


def error_columns(df: DataFrame, actual: str = "actual", prediction: str = "prediction") -> DataFrame:
    """Error, absolute and squared error, and the percentage error (NULL for an actual of 0)."""
    e = F.col(actual) - F.col(prediction)
    ape = F.when(F.col(actual) != 0, F.abs(e / F.col(actual)) * 100)
    return df.withColumns({"error": e, "absolute_error": F.abs(e), "squared_error": e * e, "absolute_percentage_error": ape})
