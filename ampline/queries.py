"""Queries over the given tables, and their DuckDB SQL.

events are readings (site: event_type, entity: user_id), lineitem by region and day is a panel over several years,
customer by nation is a dimension.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampline.functions import scalars as S
from ampline.operators import models as M
from ampline.operators import panel as P
from ampline.operators import quality as Q
from ampline.operators import series as T
from ampline.plans import views as V
from ampline.sources import io
from ampline.sources.io import artifact_check as check_rows
from ampline.sources.io import materialize, read_table
from ampline.sources.store import line

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*[F.round(F.col(c) + F.lit(0.0), digits).alias(c) if t == "double" else F.col(c).alias(c) for c, t in df.dtypes])


# ---- shared tables -------------------------------------------------------------------------------------------------


def readings(s: SparkSession, d: str) -> DataFrame:
    e = read_table(s, d, "events")
    return e.select(F.col("event_type").alias("site"), F.col("user_id").alias("entity"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), "value")


def hourly(s, d):
    return P.site_hourly(readings(s, d), "site", "entity", "ts", "value")


def dense(s, d):
    return T.densify(materialize(hourly(s, d)), ["site"], "ts", "total")


def buckets(s, d):
    """Sums of each entity in 6-hour buckets, dense."""
    e = readings(s, d).groupBy("entity", F.window(F.col("ts").cast("timestamp"), "6 hours")["start"].cast("timestamp_ntz").alias("ts")).agg(F.sum("value").alias("value"))
    return T.densify(materialize(e), ["entity"], "ts", "value", "6 hours")


def daily_panel(s, d):
    l, sup, n = (read_table(s, d, x) for x in ("lineitem", "supplier", "nation"))
    own = sup.join(n, sup["s_nationkey"] == n["n_nationkey"]).select("s_suppkey", F.col("n_regionkey").alias("site"))
    return l.join(own, l["l_suppkey"] == own["s_suppkey"]).groupBy("site", F.col("l_shipdate").alias("ts")).agg(F.sum("l_extendedprice").alias("total"))


def daily_features(s, d):
    full = T.densify(materialize(daily_panel(s, d)), ["site"], "ts", "total", "1 day")
    lagged = T.lag_features(full, ["site"], "ts", "total", [(1, "1"), (7, "7"), (28, "28")])
    return T.rolling_features(lagged, ["site"], "ts", "total", [(7, "7"), (28, "28")])


def make_forecast(s, d):
    """Naive forecast of the hourly panel: the value a day before; with errors and outlier flags."""
    lagged = T.lag_features(dense(s, d), ["site"], "ts", "total", [(24, "24")])
    f = lagged.where("total is not null and lag_24 is not null").select("site", "ts", F.col("total").alias("actual"), F.col("lag_24").alias("prediction"))
    f = P.mark_outliers(S.error_columns(f), "site", "actual", exact=True)
    return f.select("site", "ts", "actual", "prediction", "error", "absolute_error", "squared_error", "absolute_percentage_error", "is_outlier")


def forecast(s, d):
    """The forecast table that all reports read: written once in a session."""
    return io.written_once(s, "forecast", f"{d}/events.parquet", lambda: make_forecast(s, d))


def exogenous(s, d):
    o, c, n = (read_table(s, d, x) for x in ("orders", "customer", "nation"))
    x = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"])
    return x.groupBy(F.col("n_regionkey").alias("site"), F.col("o_orderdate").alias("ts")).agg(F.avg("o_totalprice").alias("price"))


E = "e as (select event_type as site, user_id as entity, date_trunc('hour', ts)::timestamp as ts, value from events)"
H = f"{E}, eh as (select site, entity, ts, sum(value) as v from e group by all), h as (select site, ts, sum(v) as total, count(*) as active from eh group by all)"
G = f"{H}, ax as (select unnest(generate_series((select min(ts) from h), (select max(ts) from h), interval 1 hour)) as ts), d as (select k.site, ax.ts, h.total, h.active, (h.total is not null)::int as target_available from (select distinct site from h) k cross join ax left join h on h.site = k.site and h.ts = ax.ts)"
B = f"{E}, b as (select entity, time_bucket(interval 6 hours, ts, timestamp '1970-01-01') as ts, sum(value) as value from e group by all), bax as (select unnest(generate_series((select min(ts) from b), (select max(ts) from b), interval 6 hours)) as ts), bd as (select k.entity, bax.ts, b.value from (select distinct entity from b) k cross join bax left join b on b.entity = k.entity and b.ts = bax.ts)"
L = f"{G}, lg as (select *, lag(total, 24) over (partition by site order by ts) as p from d), f0 as (select site, ts, total as actual, p as prediction, total - p as error, abs(total - p) as absolute_error, (total - p) * (total - p) as squared_error, case when total <> 0 then abs((total - p) / total) * 100 end as absolute_percentage_error from lg where total is not null and p is not null), fq as (select site, quantile_cont(actual, 0.25) as q1, quantile_cont(actual, 0.75) as q3 from f0 group by site), f as (select f0.*, (actual > q3 + 1.5 * (q3 - q1) or actual < q1 - 1.5 * (q3 - q1))::int as is_outlier from f0 join fq using (site))"
D = "p as (select n_regionkey as site, l_shipdate as ts, sum(l_extendedprice) as total from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey group by all), pax as (select unnest(generate_series((select min(ts) from p), (select max(ts) from p), interval 1 day)) as ts), pd as (select k.site, pax.ts, p.total from (select distinct site from p) k cross join pax left join p on p.site = k.site and p.ts = pax.ts), pf as (select *, lag(total, 1) over w as lag_1, lag(total, 7) over w as lag_7, lag(total, 28) over w as lag_28, avg(total) over (w rows between 7 preceding and 1 preceding) as rolling_mean_7, count(total) over (w rows between 7 preceding and 1 preceding) as rolling_count_7, avg(total) over (w rows between 28 preceding and 1 preceding) as rolling_mean_28, count(total) over (w rows between 28 preceding and 1 preceding) as rolling_count_28 from pd window w as (partition by site order by ts))"
X = "x as (select n_regionkey as site, o_orderdate as ts, avg(o_totalprice) as price from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by all)"
GAPS = f"{B}, bi as (select entity, ts, value is null as m, sum((value is not null)::int) over (partition by entity order by ts) as i from bd), gaps as (select entity, count(*) as gap_length, min(ts) as gap_start, max(ts) as gap_end from bi where m group by entity, i)"
RATE = f"{B}, r as (select entity, count(*) as total, sum((value is null)::int)::bigint as missing, sum((value is null)::int) * 100.0 / count(*) as missing_rate from bd group by entity)"
BUCKET = "case when missing_rate <= 0 then '0%' when missing_rate <= 10 then '0-10%' when missing_rate <= 30 then '10-30%' when missing_rate <= 50 then '30-50%' when missing_rate <= 80 then '50-80%' when missing_rate <= 99.9999999999 then '80-100%' else '100%' end"
IQR = f"{H}, q as (select site, quantile_cont(total, 0.25) as q1, quantile_cont(total, 0.75) as q3 from h group by site), bo as (select *, q1 - 1.5 * (q3 - q1) as lower_bound, q3 + 1.5 * (q3 - q1) as upper_bound from q), mk as (select h.*, bo.q1, bo.q3, lower_bound, upper_bound, (total > upper_bound or total < lower_bound)::int as is_outlier from h join bo using (site))"
ERR = "count(*) as records, round(avg(abs(error)), 4) as mae, round(sqrt(avg(error * error)), 4) as rmse, round(max(abs(error)), 4) as max_abs_error, round(sum(error * error), 4) as sse"

# ---- scans, reshaping ----------------------------------------------------------------------------------------------


@register("select l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) as revenue from lineitem where l_quantity > 45 and l_shipdate >= timestamp '1997-01-01'")
def scan_project_filter(s, d):
    l = read_table(s, d, "lineitem").where("l_quantity > 45 and l_shipdate >= timestamp_ntz '1997-01-01'")
    return rounded(l.select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue")))


@register("""select event_id, try_cast(case when event_id % 5 = 0 then 'none' when event_id % 5 = 1 then '' else cast(event_id as varchar) || '.5' end as double) as number from events""")
def try_cast_numeric(s, d):
    raw = F.expr("case when event_id % 5 = 0 then 'none' when event_id % 5 = 1 then '' else cast(event_id as string) || '.5' end")
    return read_table(s, d, "events").select("event_id", S.to_number(raw).alias("number"))


def wide(s, d):
    h = hourly(s, d)
    names = sorted(r[0] for r in h.select("site").distinct().collect())  # one name a column of the result
    return T.long_to_wide(h, ["ts"], "site", "total", names)


@register(f"with {H}, k as (select distinct ts from h), z as (select distinct site from h) select k.ts, z.site as entity, round(h.total, 4) as value from k cross join z left join h on h.ts = k.ts and h.site = z.site")
def unpivot_wide(s, d):
    return rounded(T.wide_to_long(wide(s, d), ["ts"]))


@register(f"with {H} select ts, site as entity, round(total, 4) as value from h")
def pivot_unpivot_roundtrip(s, d):
    return rounded(T.wide_to_long(wide(s, d), ["ts"]).where(~S.is_missing(F.col("value"))))


# ---- quality -------------------------------------------------------------------------------------------------------


@register(f"with {RATE} select entity, total, missing, round(missing_rate, 4) as missing_rate from r")
def missing_rate_by_entity(s, d):
    return rounded(Q.missing_rate_by_entity(buckets(s, d), "entity", "value"))


@register(f"with {RATE} select {BUCKET} as rate_class, count(*) as entities, list_position(['0%', '0-10%', '10-30%', '30-50%', '50-80%', '80-100%', '100%'], {BUCKET})::int - 1 as class_rank from r group by all")
def missing_distribution(s, d):
    return Q.missing_distribution(Q.missing_rate_by_entity(buckets(s, d), "entity", "value"))


@register(f"with {RATE} select bd.entity, count(*) as rows, round(sum(value), 4) as value from bd join r using (entity) where missing_rate <= 50 group by bd.entity")
def filter_entities_by_missing(s, d):
    return rounded(Q.filter_entities_by_missing(buckets(s, d), "entity", "value").groupBy("entity").agg(F.count("*").alias("rows"), F.sum("value").alias("value")))


def gaps(s, d):
    return T.missing_gaps(buckets(s, d), ["entity"], "ts", "value")


@register(f"with {GAPS} select * from gaps")
def missing_gaps(s, d):
    return gaps(s, d)


@register(f"with {GAPS} select gap_length, count(*) as gaps from gaps group by all")
def gap_length_distribution(s, d):
    return gaps(s, d).groupBy("gap_length").agg(F.count("*").alias("gaps"))


@register(f"with {GAPS} select case when gap_length <= 1 then '1' when gap_length <= 3 then '2-3' when gap_length <= 6 then '4-6' when gap_length <= 24 then '7-24' when gap_length <= 72 then '25-72' else '>72' end as gap_class, count(*) as gaps, sum(gap_length)::bigint as steps from gaps group by 1")
def gap_classes(s, d):
    return T.gap_classes(gaps(s, d))


@register(f"with {GAPS} select entity, max(gap_length) as longest from gaps group by all")
def longest_gap_by_entity(s, d):
    return gaps(s, d).groupBy("entity").agg(F.max("gap_length").alias("longest"))


@register(f"with {GAPS} select * from gaps order by gap_length desc, entity, gap_start limit 30")
def top_gaps(s, d):
    return P.top(gaps(s, d), [F.desc("gap_length"), F.col("entity"), F.col("gap_start")], 30)


@register(f"with {E}, t as (select distinct site, ts from e), v as (select *, lag(ts) over (partition by site order by ts) as previous from t) select site, ts, previous, date_diff('second', previous, ts) as seconds from v where date_diff('second', previous, ts) <> 3600")
def interval_check(s, d):
    return Q.interval_check(readings(s, d), "ts", keys=["site"])


@register(f"with {E} select site, entity, ts, count(*) as n from e group by all having count(*) > 1")
def duplicate_keys(s, d):
    return Q.duplicate_keys(readings(s, d), ["site", "entity", "ts"])


@register("select distinct c_custkey as entity from customer where c_custkey in (select user_id from events)")
def matched_entities(s, d):
    return Q.matched(readings(s, d), read_table(s, d, "customer").select(F.col("c_custkey").alias("entity")), "entity")


@register("select distinct user_id as entity from events where user_id not in (select c_custkey from customer)")
def fact_without_dim(s, d):
    return Q.unmatched(readings(s, d), read_table(s, d, "customer").select(F.col("c_custkey").alias("entity")), ["entity"])


@register("select distinct c_custkey as entity from customer where c_custkey not in (select user_id from events)")
def dim_without_fact(s, d):
    return Q.unmatched(read_table(s, d, "customer").select(F.col("c_custkey").alias("entity")), readings(s, d), ["entity"])


@register(f"with {G} select count(*) as rows, sum((total is null)::int)::bigint as total_missing, sum((active is null)::int)::bigint as active_missing from d")
def null_profile(s, d):
    return Q.null_profile(dense(s, d), ["total", "active"])


@register(f"with {G} select site, count(*) as rows, sum((total is null)::int)::bigint as total_missing, sum((active is null)::int)::bigint as active_missing from d group by site")
def null_profile_by_site(s, d):
    return Q.null_profile(dense(s, d), ["total", "active"], ["site"])


@register("select min(c_acctbal) as c_acctbal_min, max(c_acctbal) as c_acctbal_max from customer")
def value_minmax(s, d):
    return Q.value_minmax(read_table(s, d, "customer"), ["c_acctbal"])


@register("select sum((c_acctbal < 0)::int)::bigint as c_acctbal_negative from customer")
def negative_counts(s, d):
    return Q.negative_counts(read_table(s, d, "customer"), ["c_acctbal"])


@register("select l_returnflag as site, count(*) as rows, sum((l_discount = 0)::int)::bigint as zeros, round(sum((l_discount = 0)::int) * 100.0 / count(*), 4) as zero_rate from lineitem group by 1")
def zero_rate_by_site(s, d):
    return rounded(Q.zero_rate(read_table(s, d, "lineitem").withColumnRenamed("l_returnflag", "site"), "site", "l_discount"))


@register(f"with {H} select site, count(*) as rows, count(distinct ts) as times, min(ts) as first_time, max(ts) as last_time, n - count(distinct ts) as missing_times, round(count(distinct ts) * 100.0 / n, 4) as coverage from h, (select date_diff('hour', min(ts), max(ts)) + 1 as n from h) group by site, n")
def time_coverage(s, d):
    h = materialize(hourly(s, d))
    ends = h.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    return rounded(Q.time_coverage(h, "site", "ts", int((ends["b"] - ends["a"]).total_seconds()) // 3600 + 1))


def _by_nation(s, d):
    c = read_table(s, d, "customer").select("c_nationkey", F.col("c_custkey").alias("entity"))
    return c, c.join(readings(s, d).select("entity").distinct(), "entity", "left_semi")


@register("select c_nationkey, count(distinct c_custkey) as before, count(distinct case when c_custkey in (select user_id from events) then c_custkey end) as after, count(distinct c_custkey) - count(distinct case when c_custkey in (select user_id from events) then c_custkey end) as removed from customer group by 1")
def before_after_counts(s, d):
    a, b = _by_nation(s, d)
    return Q.before_after_counts(a, b, "c_nationkey", "entity")


@register("select c_nationkey, c_custkey as entity from customer where c_custkey not in (select user_id from events)")
def removed_entities(s, d):
    a, b = _by_nation(s, d)
    return Q.unmatched(a, b, ["c_nationkey", "entity"])


@register("select props as token, count(*) as n from events group by 1 order by n desc, token nulls first limit 20")
def raw_token_frequency(s, d):
    return Q.raw_token_frequency(read_table(s, d, "events"), "props")


# ---- imputation, enrichment, panels --------------------------------------------------------------------------------


def exo_grid(s, d):
    """The exogenous panel, and it on a dense grid."""
    x = materialize(exogenous(s, d))
    return x, T.densify(x, ["site"], "ts", "price", "1 day").drop("target_available")


XG = f"{X}, xax as (select unnest(generate_series((select min(ts) from x), (select max(ts) from x), interval 1 day)) as ts), xd as (select k.site, xax.ts, x.price from (select distinct site from x) k cross join xax left join x on x.site = k.site and x.ts = xax.ts)"


@register(f"with {XG}, m as (select site, quantile_cont(price, 0.5) as m from xd group by site) select xd.site, ts, round(coalesce(price, m.m, (select quantile_cont(price, 0.5) from xd)), 6) as price from xd left join m using (site)")
def impute_median(s, d):
    x, full = exo_grid(s, d)
    return rounded(T.impute_median(full, "site", ["price"], present=x), 6)


@register(f"with {X} select site, round(quantile_cont(price, 0.5), 4) as median from x group by site")
def site_medians(s, d):
    return rounded(exogenous(s, d).groupBy("site").agg(F.percentile("price", 0.5).alias("median")))


@register(f"with {X} select round(quantile_cont(price, 0.5), 4) as median from x")
def global_medians(s, d):
    return rounded(exogenous(s, d).agg(F.percentile("price", 0.5).alias("median")))


@register("select event_id, user_id, c_mktsegment, n_name, value from events left join customer on user_id = c_custkey left join nation on c_nationkey = n_nationkey")
def enrich_fact(s, d):
    e, c, n = read_table(s, d, "events"), read_table(s, d, "customer"), read_table(s, d, "nation")
    fact = P.enrich(e.withColumnRenamed("user_id", "c_custkey"), c, "c_custkey", n.withColumnRenamed("n_nationkey", "c_nationkey"), ["c_nationkey"])
    return fact.select("event_id", F.col("c_custkey").alias("user_id"), "c_mktsegment", "n_name", "value")


@register(f"with {H} select site, ts, round(total, 4) as total, active from h")
def site_hourly(s, d):
    return rounded(hourly(s, d))


@register(f"with {H} select site, ts, year(ts)::int as year, month(ts)::int as month, day(ts)::int as day, hour(ts)::int as hour, (dayofweek(ts) + 1)::int as day_of_week, quarter(ts)::int as quarter, (dayofweek(ts) in (0, 6))::int as is_weekend from h")
def calendar_features(s, d):
    return hourly(s, d).select("site", "ts").withColumns(S.calendar("ts"))


@register(f"with {H} select site, ts, round(sin(hour(ts) * 2.0 * pi() / 24), 4) + 0.0 as hour_sin, round(cos(hour(ts) * 2.0 * pi() / 24), 4) + 0.0 as hour_cos, round(sin(dayofweek(ts) * 2.0 * pi() / 7), 4) + 0.0 as day_of_week_sin, round(cos(dayofweek(ts) * 2.0 * pi() / 7), 4) + 0.0 as day_of_week_cos from h")
def cyclical_features(s, d):
    c = S.cyclical(F.hour("ts"), 24, "hour") | S.cyclical(F.dayofweek("ts") - 1, 7, "day_of_week")
    out = rounded(hourly(s, d).select("site", "ts").withColumns(c))
    return out.select(*[(F.col(n) + F.lit(0.0)).alias(n) if t == "double" else n for n, t in out.dtypes])


@register("select event_id, round(sin(radians(event_id % 360)), 4) + 0.0 as wind_sin, round(cos(radians(event_id % 360)), 4) + 0.0 as wind_cos from events")
def angle_to_vector(s, d):
    out = rounded(read_table(s, d, "events").select("event_id", *[c.alias(n) for n, c in S.angle_to_vector(F.col("event_id") % 360, "wind").items()]))
    return out.select("event_id", *[(F.col(n) + F.lit(0.0)).alias(n) for n in ("wind_sin", "wind_cos")])


@register(f"with {H} select site, ts::date as date, round(sum(total), 6) as total, round(avg(total), 6) as mean, round(min(total), 6) as least, round(max(total), 6) as most, max(active) as active, count(*) as hours from h group by site, ts::date")
def site_daily(s, d):
    return rounded(P.site_daily(hourly(s, d)), 6)


# ---- outliers ------------------------------------------------------------------------------------------------------


@register(f"with {IQR} select site, round(q1, 4) as q1, round(q3, 4) as q3, round(lower_bound, 4) as lower_bound, round(upper_bound, 4) as upper_bound from bo")
def iqr_bounds_exact(s, d):
    return rounded(P.iqr_bounds(hourly(s, d), "site", "total", exact=True))


@register(f"with {H}, q as (select site, quantile_disc(total, 0.25) as q1, quantile_disc(total, 0.75) as q3 from h group by site) select site, round(q1, 4) as q1, round(q3, 4) as q3, round(q1 - 1.5 * (q3 - q1), 4) as lower_bound, round(q3 + 1.5 * (q3 - q1), 4) as upper_bound from q")
def iqr_bounds_approx(s, d):
    return rounded(P.iqr_bounds(hourly(s, d), "site", "total", exact=False, accuracy=100_000))


def marked(s, d):
    return P.mark_outliers(materialize(hourly(s, d)), "site", "total", exact=True)


@register(f"with {IQR} select site, ts, round(total, 4) as total, active, round(q1, 4) as q1, round(q3, 4) as q3, round(lower_bound, 4) as lower_bound, round(upper_bound, 4) as upper_bound, is_outlier from mk")
def mark_outliers(s, d):
    return rounded(marked(s, d))


@register(f"with {IQR} select site, ts, (total > upper_bound)::int as is_outlier from mk")
def mark_outliers_upper(s, d):
    return P.mark_outliers(materialize(hourly(s, d)), "site", "total", side="upper", exact=True).select("site", "ts", "is_outlier")


@register(f"with {IQR} select site, count(*) as rows, sum(is_outlier)::bigint as outliers, round(sum(is_outlier) * 100.0 / count(*), 4) as outlier_rate from mk group by site")
def outlier_summary(s, d):
    return rounded(P.outlier_summary(marked(s, d), "site"))


@register(f"with {IQR}, y as (select site, sum(is_outlier)::bigint as o, sum(is_outlier) * 100.0 / count(*) as r from mk group by site) select case when r <= 0 then '0%' when r <= 1 then '0-1%' when r <= 5 then '1-5%' when r <= 10 then '5-10%' else '>10%' end as rate_class, count(*) as sites, sum(o)::bigint as outliers from y group by 1")
def outlier_rate_groups(s, d):
    return P.outlier_rate_groups(P.outlier_summary(marked(s, d), "site"))


@register(f"with {IQR}, y as (select site, sum(is_outlier)::bigint as o from mk group by site) select (select sum(o)::bigint from y) as by_site, (select sum(is_outlier)::bigint from mk) as overall")
def outlier_consistency(s, d):
    m = marked(s, d)
    return P.outlier_summary(m, "site").agg(F.sum("outliers").alias("by_site")).crossJoin(F.broadcast(m.agg(F.sum("is_outlier").alias("overall"))))  # a row each


@register(f"with {IQR} select active, count(*) as rows, sum(is_outlier)::bigint as outliers from mk group by active")
def outlier_by_active(s, d):
    return marked(s, d).groupBy("active").agg(F.count("*").alias("rows"), F.sum("is_outlier").alias("outliers"))


@register(f"with {IQR} select site, ts, round(total, 4) as total from mk where is_outlier = 1 order by mk.total desc, site, ts limit 20")
def top_outliers(s, d):
    return rounded(P.top(marked(s, d).where("is_outlier = 1"), [F.desc("total"), F.col("site"), F.col("ts")], 20).select("site", "ts", "total"))


@register(f"with {H} select site, ts, active, round(total / active, 4) as per_active from h order by h.total / h.active desc, site, ts limit 30")
def top_per_active(s, d):
    h = hourly(s, d).select("site", "ts", "active", (F.col("total") / F.col("active")).alias("per_active"))
    return rounded(P.top(h, [F.desc("per_active"), F.col("site"), F.col("ts")], 30))


# ---- features ------------------------------------------------------------------------------------------------------


@register(f"with {G} select site, ts, round(total, 4) as total, active, target_available from d")
def dense_grid(s, d):
    return rounded(dense(s, d))


@register(f"with {G} select site, ts, round(total, 4) as total, round(lag(total, 1) over w, 4) as lag_1, round(lag(total, 24) over w, 4) as lag_24, round(lag(total, 168) over w, 4) as lag_168, (total is not null and lag(total, 1) over w is not null and lag(total, 24) over w is not null and lag(total, 168) over w is not null)::int as lag_ready from d window w as (partition by site order by ts)")
def lag_features(s, d):
    out = T.lag_features(dense(s, d), ["site"], "ts", "total", [(1, "1"), (24, "24"), (168, "168")])
    return rounded(out.select("site", "ts", "total", "lag_1", "lag_24", "lag_168", "lag_ready"))


_PF = "site, ts, round(total, 6) as total, round(lag_1, 6) as lag_1, round(lag_7, 6) as lag_7, round(lag_28, 6) as lag_28, round(rolling_mean_7, 6) as rolling_mean_7, rolling_count_7, round(rolling_mean_28, 6) as rolling_mean_28, rolling_count_28"


@register(f"with {D} select {_PF}, (total is not null and rolling_count_7 = 7 and rolling_count_28 = 28)::int as rolling_ready from pf")
def rolling_features(s, d):
    return rounded(daily_features(s, d).drop("target_available", "lag_ready"), 6)


@register(f"with {D} select site, sum((rolling_count_7 < 7)::int)::bigint as short_7, sum((rolling_count_28 < 28)::int)::bigint as short_28 from pf group by site")
def incomplete_frames(s, d):
    return daily_features(s, d).groupBy("site").agg(F.count_if(F.col("rolling_count_7") < 7).alias("short_7"), F.count_if(F.col("rolling_count_28") < 28).alias("short_28"))


@register(f"with {D}, {X} select pd.site, pd.ts, round(pd.total, 6) as total, round(x.price, 6) as price from pd left join x on x.site = pd.site and x.ts = pd.ts")
def join_exogenous(s, d):
    return rounded(P.enrich(T.densify(materialize(daily_panel(s, d)), ["site"], "ts", "total", "1 day"), exogenous(s, d), ["site", "ts"]).select("site", "ts", "total", "price"), 6)


@register(f"with {D} select case when ts < timestamp '2000-01-01' then 'train' else 'test' end as part, count(*) as rows, count(distinct site) as sites from pf where total is not null and lag_1 is not null and lag_7 is not null and lag_28 is not null group by 1")
def time_split(s, d):
    a, b = T.time_split(daily_features(s, d).where("lag_ready = 1"), "ts", "2000-01-01 00:00:00")
    both = a.withColumn("part", F.lit("train")).unionByName(b.withColumn("part", F.lit("test")))
    return both.groupBy("part").agg(F.count("*").alias("rows"), F.countDistinct("site").alias("sites"))


# ---- errors and reports --------------------------------------------------------------------------------------------

_FC = "site, ts, round(actual, 4) as actual, round(prediction, 4) as prediction, round(error, 4) + 0.0 as error, round(absolute_error, 4) as absolute_error, round(squared_error, 4) as squared_error, round(absolute_percentage_error, 4) as absolute_percentage_error, is_outlier"


@register(f"with {L} select {_FC} from f")
def error_columns(s, d):
    return rounded(forecast(s, d)).withColumn("error", F.col("error") + F.lit(0.0))


@register(f"with {L} select {ERR} from f")
def error_global(s, d):
    return rounded(P.error_report(forecast(s, d)))


@register(f"with {L} select site, {ERR} from f group by site")
def error_by_site(s, d):
    return rounded(P.error_report(forecast(s, d), ["site"]))


@register(f"with {L} select is_outlier, {ERR} from f group by is_outlier")
def error_by_outlier(s, d):
    return rounded(P.error_report(forecast(s, d), ["is_outlier"]))


@register(f"with {L} select round(quantile_disc(absolute_error, 0.5), 4) as p50, round(quantile_disc(absolute_error, 0.9), 4) as p90, round(quantile_disc(absolute_error, 0.95), 4) as p95, round(quantile_disc(absolute_error, 0.99), 4) as p99 from f")
def error_quantiles(s, d):
    q = {f"p{n}": F.percentile_approx("absolute_error", n / 100, 100_000).alias(f"p{n}") for n in (50, 90, 95, 99)}
    return rounded(forecast(s, d).agg(*q.values()))


@register(f"with {L} select round(sum(squared_error), 4) as sse, round(sum(case when is_outlier = 1 then squared_error else 0 end), 4) as flagged_sse, round(sum(case when is_outlier = 1 then squared_error else 0 end) / sum(squared_error) * 100, 4) as share from f")
def sse_share(s, d):
    return rounded(P.sse_share(forecast(s, d)))


@register(f"with {D} select 'naive' as model, count(*) as records, round(sqrt(avg((total - lag_1) * (total - lag_1))), 4) as rmse, round(avg(abs(total - lag_1)), 4) as mae, round(1 - sum((total - lag_1) * (total - lag_1)) / (var_pop(total) * count(*)), 4) as r2 from pf where total is not null and lag_1 is not null")
def naive_forecast_metrics(s, d):
    f = daily_features(s, d).where("total is not null and lag_1 is not null")
    return rounded(M.metrics_frame(f, "naive", "total", "lag_1"))


_ROLL = "round(avg(abs(error)), 4) as mae, round(sqrt(avg(error * error)), 4) as rmse, count(*) as records"


@register(f"with {L} select hour(ts)::int as hour_of_day, round(avg(actual), 4) as actual, round(avg(prediction), 4) as predicted, {_ROLL} from f group by 1")
def rollup_hour_of_day(s, d):
    return rounded(P.rollup(forecast(s, d), F.hour("ts"), "hour_of_day", "avg"))


@register(f"with {L} select ts::date as date, round(sum(actual), 4) as actual, round(sum(prediction), 4) as predicted, {_ROLL} from f group by 1")
def rollup_daily(s, d):
    return rounded(P.rollup(forecast(s, d), F.to_date("ts"), "date"))


@register(f"with {L} select site, round(sum(actual), 4) as actual, round(sum(prediction), 4) as predicted, {_ROLL} from f group by 1")
def rollup_site(s, d):
    return rounded(P.rollup(forecast(s, d), F.col("site"), "site"))


@register(f"with {L} select count(*) as points, count(distinct site) as sites from f")
def point_count(s, d):
    return V.report(forecast(s, d), V.POINTS)


_KPI = "round(sum(actual), 4) as actual, round(sum(prediction), 4) as predicted, round(avg(abs(error)), 4) as mae, round(sqrt(avg(error * error)), 4) as rmse, count(*) as records"


@register(f"with {L} select {_KPI} from f")
def kpi(s, d):
    return rounded(V.report(forecast(s, d), V.KPI, start="1900-01-01", stop="2100-01-01", site=None))


@register(f"with {L} select {_KPI} from f where ts >= timestamp '2024-01-10' and ts < timestamp '2024-01-21' and site = 'click'")
def filtered_kpi(s, d):
    return rounded(V.report(forecast(s, d), V.KPI, start="2024-01-10", stop="2024-01-21", site="click"))


@register(f"with {L} select ts, round(sum(actual), 4) as actual, round(sum(prediction), 4) as predicted from f group by ts")
def trend_hourly(s, d):
    out = V.report(forecast(s, d), V.TREND)
    return rounded(out.withColumn("ts", F.col("ts").cast("timestamp_ntz")))


@register(f"with {L} select distinct site from f where year(ts) between 2016 and 2030")
def site_list(s, d):
    return V.report(forecast(s, d), V.SITES, first=2016, last=2030)


@register(f"with {L} select site, ts, round(absolute_error, 4) as absolute_error from f order by f.absolute_error desc, site, ts limit 20")
def top_errors(s, d):
    return rounded(P.top(forecast(s, d), [F.desc("absolute_error"), F.col("site"), F.col("ts")], 20).select("site", "ts", "absolute_error"))


@register(f"with {L} select ts, round(sum(abs(error)), 4) as abs_error from f group by ts")
def hourly_abs_error(s, d):
    return rounded(V.report(forecast(s, d), V.ERRORS))


@register(f"with {L} select ts, site, round(actual, 4) as actual, round(prediction, 4) as prediction from f")
def forecast_listing(s, d):
    return rounded(V.report(forecast(s, d), V.LISTING))


#: Rows that fixed tables must have; the last entry is wrong on purpose, so that a FAIL is seen too.
EXPECTED = {"region": 5, "nation": 25, "nation_wrong": 24}


@register("select 'region' as dataset, count(*) as actual, 5 as expected, if(count(*) = 5, 'PASS', 'FAIL') as status from region union all select 'nation', count(*), 25, if(count(*) = 25, 'PASS', 'FAIL') from nation union all select 'nation_wrong', count(*), 24, if(count(*) = 24, 'PASS', 'FAIL') from nation")
def artifact_check(s, d):
    return check_rows(s, {name: (read_table(s, d, name.split("_")[0]), n) for name, n in EXPECTED.items()})


# ---- files, sinks, raw text ----------------------------------------------------------------------------------------


def _csv(s, df) -> str:
    path = io.scratch_dir(s)
    df.coalesce(1).write.option("header", True).csv(path)
    return path


@register("select c_mktsegment, count(*) as n, round(sum(c_acctbal), 4) as acctbal from customer group by 1")
def csv_inferred(s, d):
    df = io.read_csv(s, _csv(s, read_table(s, d, "customer")), infer=True)
    return rounded(df.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.sum("c_acctbal").alias("acctbal")))


@register("select cast(n_nationkey as varchar) as n_nationkey, n_name, cast(n_regionkey as varchar) as n_regionkey from nation")
def csv_strings(s, d):
    return io.read_csv(s, _csv(s, read_table(s, d, "nation")))


@register("select cast(n_nationkey as varchar) as n_nationkey, n_name, cast(n_regionkey as varchar) as n_regionkey from nation where n_nationkey % 3 = 0")
def raw_rows(s, d):
    n = read_table(s, d, "nation")
    text = F.when(F.col("n_nationkey") % 3 == 0, F.concat_ws(",", "n_nationkey", "n_name", "n_regionkey")).when(F.col("n_nationkey") % 3 == 1, F.concat_ws(",", "n_nationkey", "n_name")).otherwise(F.concat_ws(",", "n_nationkey", "n_name", "n_regionkey", F.lit("more")))
    path = io.scratch_dir(s)
    head = s.createDataFrame([(-1, "n_nationkey,n_name,n_regionkey")], "k int, value string")
    head.unionByName(n.select(F.col("n_nationkey").alias("k"), text.alias("value"))).coalesce(1).sortWithinPartitions("k").select("value").write.text(path)
    return io.read_raw_rows(s, path)


@register("select (select count(*) from lineitem) as rows, -1::bigint as absent")
def footer_row_count(s, d):
    return s.createDataFrame([(io.row_count(s, f"{d}/lineitem.parquet"), io.row_count(s, f"{d}/no_such_table.parquet"))], "rows long, absent long")


@register(f"with {H} select 'load,site=' || site || ' active=' || cast(active as varchar) || 'i ' || cast(epoch_us(ts) * 1000 as varchar) as line from h")
def line_protocol(s, d):
    return hourly(s, d).select(line("load", ["site"], ["active"], "ts").alias("line"))


@register("select c_custkey, c_name from customer where c_custkey % 4 <> 0")
def blank_filter(s, d):
    c = read_table(s, d, "customer").withColumn("c_name", F.when(F.col("c_custkey") % 4 == 0, "  ").otherwise(F.col("c_name")))
    return S.not_blank(c, "c_name").select("c_custkey", "c_name")


@register(f"with {H}, k as (select distinct ts from h), r as (select z.site from (select distinct site from h) z join h using (site) group by z.site having (select count(*) from k) - count(*) <= 0.6 * (select count(*) from k)) select k.ts, r.site as entity, round(h.total, 4) as value from k cross join r left join h on h.ts = k.ts and h.site = r.site")
def kept_columns(s, d):
    return rounded(T.wide_to_long(Q.keep_columns(materialize(wide(s, d)), ["ts"], 60.0), ["ts"]))


@register("select event_id, value, cast(null as double) as humidity from events")
def missing_column(s, d):
    e = read_table(s, d, "events")
    return e.select("event_id", S.column_or_null(e, "value"), S.column_or_null(e, "humidity"))


@register("select event_id, ts, date_trunc('second', ts) - interval 7 hours as shifted, strftime(ts, '%Y-%m-%d %H:%M') as minute, format('{:,.2f}', value) as amount from (select event_id, date_trunc('second', ts) as ts, value from events)")
def timestamp_text(s, d):
    e = read_table(s, d, "events").withColumn("ts", F.date_trunc("second", "ts"))
    text = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format("ts", "dd/MM/yyyy HH:mm:ss"))
    ts = S.parse_timestamp(text, ("yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy HH:mm:ss"))
    e = e.select("event_id", ts.alias("ts"), "value")
    return e.select("event_id", "ts", S.shift_hours(F.col("ts"), -7).alias("shifted"), F.date_format("ts", "yyyy-MM-dd HH:mm").alias("minute"), F.format_number("value", 2).alias("amount"))


@register("select count(*) as n, count(distinct ts::date) as days from events where ts >= timestamp '2024-01-10' and ts < timestamp '2024-01-13'")
def date_interval(s, d):
    a, b = S.day_range("2024-01-10", "2024-01-12")
    return read_table(s, d, "events").where((F.col("ts") >= a) & (F.col("ts") < b)).agg(F.count("*").alias("n"), F.countDistinct(F.to_date("ts")).alias("days"))


@register("select count(*) as n from (select * from events limit 10)")
def limit_rows(s, d):
    return read_table(s, d, "events").limit(10).agg(F.count("*").alias("n"))


@register("select event_type as site, count(*) as rows, count(case when value > 50 then value end) as present from events group by 1")
def count_present(s, d):
    e = read_table(s, d, "events").withColumn("value", F.when(F.col("value") > 50, F.col("value")))
    return e.groupBy(F.col("event_type").alias("site")).agg(F.count("*").alias("rows"), F.count("value").alias("present"))


@register("select unnest([0.25, 0.5, 0.75])::double as p, unnest(quantile_disc(value, [0.25, 0.5, 0.75])) as value from events")
def quantile_sketch(s, d):
    ps = [0.25, 0.5, 0.75]
    return s.createDataFrame(list(zip(ps, read_table(s, d, "events").approxQuantile("value", ps, 0.0))), "p double, value double")


@register(f"with {RATE}, g as (select {BUCKET} as rate_class, count(*) as entities, list_position(['100%', '80-100%', '50-80%', '30-50%', '10-30%', '0-10%', '0%'], {BUCKET}) as k from r group by all) select rate_class, entities, row_number() over (order by k)::int as place from g")
def custom_order(s, d):
    g = Q.missing_distribution(Q.missing_rate_by_entity(buckets(s, d), "entity", "value")).drop("class_rank")
    rows = [(r["rate_class"], r["entities"], i + 1) for i, r in enumerate(Q.order_by_list(g, "rate_class", Q.RATE_ORDER[::-1]).collect())]  # a row a class
    return s.createDataFrame(rows, "rate_class string, entities long, place int")


@register("select name, count(*) as n from (select regexp_replace(column_name, '^[a-z]+_', '') as name from (select column_name from (describe orders) union all select column_name from (describe customer))) group by 1 having count(*) > 1")
def duplicate_columns(s, d):
    header = [c.split("_", 1)[1] for t in ("orders", "customer") for c in read_table(s, d, t).columns]
    return s.createDataFrame(list(Q.duplicate_columns(header).items()), "name string, n long")


# ---- joins and carried attributes ----------------------------------------------------------------------------------


@register("select c_custkey, (c_custkey in (select user_id from events))::int as present from customer")
def existence_flag(s, d):
    e = read_table(s, d, "events").select(F.col("user_id").alias("c_custkey"))
    return P.existence_flag(read_table(s, d, "customer").select("c_custkey"), e, ["c_custkey"])


@register(f"with {L} select f.site, f.ts, round(f.actual, 4) as actual, h.active from f join h on f.site = h.site and f.ts = h.ts")
def inner_two_keys(s, d):
    return rounded(P.inner_on(forecast(s, d).select("site", "ts", "actual"), hourly(s, d), ["site", "ts"], ["active"]))


@register("select c_custkey % 10 as key, any_value(c_custkey % 5) filter (c_custkey % 3 = 0) as attribute from customer group by 1")
def constant_attribute(s, d):
    c = read_table(s, d, "customer").select((F.col("c_custkey") % 10).alias("key"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey") % 5).alias("attribute"))
    return P.constant_by(c, ["key"], ["attribute"])


EXO = f"{E}, eh as (select site, entity, ts, sum(value) as v from e group by all), h as (select site, ts, sum(v) as total, count(*) as active, any_value(cast(hour(ts) + length(site) / 2.0 as double)) as temperature, any_value(cast(hour(ts) * 15.0 as double)) as wind from eh group by all)"


def hourly_with_exogenous(s, d):
    r = readings(s, d).withColumns({"temperature": F.hour("ts") + F.length("site") / 2.0, "wind": F.hour("ts") * F.lit(15.0)})
    return P.site_hourly(r, "site", "entity", "ts", "value", ("temperature", "wind"))


@register(f"with {EXO} select site, ts, round(total, 4) as total, active, round(temperature, 4) as temperature, round(wind, 4) as wind from h")
def site_hourly_exogenous(s, d):
    return rounded(hourly_with_exogenous(s, d))


@register(f"with {EXO} select site, ts::date as date, round(sum(total), 4) as total, count(*) as hours, round(avg(temperature), 4) as avg_temperature, round(avg(wind), 4) as avg_wind from h group by site, ts::date")
def site_daily_exogenous(s, d):
    out = P.site_daily(hourly_with_exogenous(s, d), ("temperature", "wind"))
    return rounded(out.select("site", "date", "total", "hours", "avg_temperature", "avg_wind"))


@register(f"with {D} select case when ts < timestamp '2000-01-01' then 'train' else 'test' end as part, count(*) as rows, sum((total is null)::int)::bigint as total_missing, sum((lag_1 is null)::int)::bigint as lag_1_missing, sum((lag_28 is null)::int)::bigint as lag_28_missing from pf group by 1")
def split_audit(s, d):
    a, b = T.time_split(daily_features(s, d), "ts", "2000-01-01 00:00:00")
    return Q.feature_audit({"train": a, "test": b}, ["total", "lag_1", "lag_28"])


# ---- models --------------------------------------------------------------------------------------------------------


def _ready(s, d):
    f = daily_features(s, d).where("lag_ready = 1")
    f = f.withColumns(S.cyclical(F.month("ts") - 1, 12, "month") | {"actual": F.col("total"), "region": F.col("site").cast("string")})
    # fitted and scored several times: a panel of a row per region and day, written once
    return T.time_split(materialize(f), "ts", "2000-01-01 00:00:00")


_NUM = ["lag_1", "lag_7", "lag_28", "month_sin", "month_cos"]


@register(f"with {D}, t as (select total as y, lag_7 as x from pf where total is not null and lag_1 is not null and lag_7 is not null and lag_28 is not null) select round(regr_slope(y, x), 4) as slope, round(regr_intercept(y, x), 2) as intercept from t")
def ols_coefficients(s, d):
    t = daily_features(s, d).where("lag_ready = 1").withColumn("actual", F.col("total"))
    m = M.pipeline("linear", ["lag_7"]).fit(t).stages[-1]
    return s.createDataFrame([(float(m.coefficients[0]), float(m.intercept))], "slope double, intercept double").select(F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"))


@register(f"with {D}, t as (select total as y, lag_7 as x from pf where total is not null and lag_1 is not null and lag_7 is not null and lag_28 is not null), c as (select covar_pop(y, x) / (var_pop(x) * (1 + 10.0 / stddev_pop(y))) as b, avg(y) as my, avg(x) as mx from t) select round(b, 4) as slope, round(my - b * mx, 2) as intercept from c")
def ridge_coefficients(s, d):
    t = daily_features(s, d).where("lag_ready = 1").withColumn("actual", F.col("total"))
    m = M.pipeline("linear", ["lag_7"], reg=10.0).fit(t).stages[-1]
    return s.createDataFrame([(float(m.coefficients[0]), float(m.intercept))], "slope double, intercept double").select(F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"))


def _model_query(kind: str, **options):
    def query(s, d):
        train, test = _ready(s, d)
        model = M.pipeline(kind, _NUM, "region", **options).fit(train)
        return S.error_columns(M.score(model, test).select("site", "ts", "actual", "prediction"))

    return query


QUERIES |= {"linear_predictions": _model_query("linear"), "rf_predictions": _model_query("forest"), "ridge_predictions": _model_query("linear", reg=10.0)}


@register()
def ridge_tuning(s, d):
    train, _ = _ready(s, d)
    part, validation = T.time_split(train, "ts", "1999-10-01 00:00:00")
    best, results = M.tune_ridge(part, validation, _NUM, "region")
    return s.createDataFrame([(r, v, r == best) for r, v in results], "reg double, rmse double, best boolean")


@register()
def model_comparison(s, d):
    train, test = _ready(s, d)
    out = M.metrics_frame(test, "naive", "actual", "lag_1")
    for name, kind, options in (("linear", "linear", {}), ("ridge", "linear", {"reg": 10.0}), ("random_forest", "forest", {})):
        out = out.unionByName(M.metrics_frame(M.score(M.pipeline(kind, _NUM, "region", **options).fit(train), test), name))
    return out


#: Normal equations of one feature, solved in closed form; the same forecasts come from the fitted pipeline.
ONE = f"with {D}, t as (select site, ts, total as y, lag_7 as x from pf where total is not null and lag_1 is not null and lag_7 is not null and lag_28 is not null), tr as (select * from t where ts < timestamp '2000-01-01')"


def _one_feature(s, d, reg: float):
    train, test = _ready(s, d)
    model, out = M.refit_ridge(train, test, reg, ["lag_7"], None)
    path = io.scratch_dir(s)
    M.save_model(model, path)
    return M.score(M.load_model(path), test).select("site", "ts", "actual", "prediction")


@register(f"{ONE}, c as (select regr_slope(y, x) as b, regr_intercept(y, x) as a from tr) select site, ts, round(y, 2) as actual, round(a + b * x, 2) as prediction from t, c where ts >= timestamp '2000-01-01'")
def linear_saved_and_scored(s, d):
    return rounded(_one_feature(s, d, 0.0), 2)


_RIDGE = "c as (select covar_pop(y, x) / (var_pop(x) * (1 + 10.0 / stddev_pop(y))) as b, avg(y) as my, avg(x) as mx from tr)"


@register(f"{ONE}, {_RIDGE} select site, ts, round(y, 2) as actual, round(my + b * (x - mx), 2) as prediction from t, c where ts >= timestamp '2000-01-01'")
def ridge_refit_and_scored(s, d):
    return rounded(_one_feature(s, d, 10.0), 2)


_METRICS = "count(*) as records, round(sqrt(avg((y - p) * (y - p))), 2) as rmse, round(avg(abs(y - p)), 2) as mae, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 4) as r2"


@register(f"{ONE}, {_RIDGE}, l as (select regr_slope(y, x) as b, regr_intercept(y, x) as a from tr), te as (select * from t where ts >= timestamp '2000-01-01'), m as (select 'naive' as model, y, x as p from te union all select 'linear', y, l.a + l.b * x from te, l union all select 'ridge', y, my + c.b * (x - mx) from te, c) select model, {_METRICS} from m group by model")
def model_metrics(s, d):
    train, test = _ready(s, d)
    out = M.metrics_frame(test, "naive", "actual", "lag_7")
    for name, reg in (("linear", 0.0), ("ridge", 10.0)):
        out = out.unionByName(M.metrics_frame(M.refit_ridge(train, test, reg, ["lag_7"], None)[1], name))
    return out.select("model", "records", F.round("rmse", 2).alias("rmse"), F.round("mae", 2).alias("mae"), F.round("r2", 4).alias("r2"))
