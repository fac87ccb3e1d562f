"""Report queries as parameterised SQL over a view of forecasts (site, ts, actual, prediction, error, is_outlier)."""

from __future__ import annotations

from pyspark.sql import DataFrame

KPI = "select sum(actual) as actual, sum(prediction) as predicted, avg(abs(error)) as mae, sqrt(avg(error * error)) as rmse, count(*) as records from {f} where ts >= :start and ts < :stop and (:site is null or site = :site)"
TREND = "select date_trunc('hour', ts) as ts, sum(actual) as actual, sum(prediction) as predicted from {f} group by 1"
SITES = "select distinct site from {f} where year(ts) between :first and :last order by site"
ERRORS = "select ts, sum(abs(error)) as abs_error from {f} group by ts"
LISTING = "select ts, site, actual, prediction from {f} order by ts, site"
POINTS = "select count(*) as points, count(distinct site) as sites from {f}"


def report(forecast: DataFrame, query: str, **args) -> DataFrame:
    """One of the queries over a forecast table; parameters are bound, never pasted into the text."""
    return forecast.sparkSession.sql(query, args={k: v for k, v in args.items()}, f=forecast)
