"""Query catalogue on the test tables: every operator bound to a feed, each
with its DuckDB oracle SQL (when the result is SQL-expressible).

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLE[name] -> str``.
Doubles are rounded to 6 places on both sides before comparison.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from limnos.operators import filters as flt
from limnos.operators import timeseries as ts
from limnos.plans import sqlparts as S
from limnos.sources.tables import W_MEASURES, feed_k, feed_u, feed_w

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double/float column (both engines sum in different orders)."""
    def q(n):
        return "`" + n.replace("`", "``") + "`"
    return df.selectExpr(*[f"round(cast({q(f.name)} as double), {digits}) as {q(f.name)}"
                           if isinstance(f.dataType, (DoubleType, FloatType)) else q(f.name)
                           for f in df.schema.fields])


# =====================================================================
# Feed U: events per user — daily grid, fill, outliers, scaling, windows
# =====================================================================
U_LARGE = 100.0  # second measure: the day's mean of large values only (many gaps)


def u_grid(spark, sf):
    u = feed_u(spark, sf).withColumn("large_value", F.when(F.col("value") >= U_LARGE, F.col("value")))
    return ts.daily_resample(u, "location", "ts", ["value", "large_value"])


U_GRID_SQL = S.daily("events", "cast(user_id as varchar)", "ts",
                     {"value": "value", "large_value": f"case when value >= {U_LARGE} then value end"}, "u_grid")


@query("daily_resample", f"""with {U_GRID_SQL}
select location, "timestamp", {S.r6('value')}, {S.r6('large_value')} from u_grid""")
def q_daily_resample(spark, sf):
    return rounded(u_grid(spark, sf))


@query("gap_count", f"""with {U_GRID_SQL}
select location, cast(sum((case when value is null then 1 else 0 end) + (case when large_value is null then 1 else 0 end)) as bigint) as gaps
from u_grid group by location""")
def q_gap_count(spark, sf):
    return ts.gap_count(u_grid(spark, sf), "location", ["value", "large_value"])


def u_filled(spark, sf, suffix=""):
    return ts.ffill_bfill(u_grid(spark, sf), "location", "timestamp", ["value", "large_value"], suffix=suffix)


@query("fill_ffill_bfill", f"""with {U_GRID_SQL},
{S.fill('u_grid', 'location', ['value', 'large_value'], 'u_fill')}
select location, "timestamp", {S.r6('value')}, {S.r6('large_value')} from u_fill""")
def q_fill(spark, sf):
    return rounded(u_filled(spark, sf))


@query("fill_count", f"""with {U_GRID_SQL},
{S.fill('u_grid', 'location', ['value', 'large_value'], 'u_fill', keep_raw=True)}
select location, cast(sum((case when value_raw is null and value is not null then 1 else 0 end)
  + (case when large_value_raw is null and large_value is not null then 1 else 0 end)) as bigint) as filled
from u_fill group by location""")
def q_fill_count(spark, sf):
    f = u_filled(spark, sf, suffix="_filled")
    return ts.fill_count(f, "location", [("value", "value_filled"), ("large_value", "large_value_filled")])


def user_daily_clean(spark, sf):
    """Minimum slice: per user daily mean, gaps filled, outlier days removed
    (literal mode: a constant series loses its rows), scaled to 0-1."""
    g = ts.daily_resample(feed_u(spark, sf), "location", "ts", ["value"])
    f = ts.ffill_bfill(g, "location", "timestamp", ["value"])
    z = ts.zscore_filter(f, "location", ["value"], constant="drop")
    return ts.minmax_per_key(z, "location", ["value"], suffix="_scaled")


U_CLEAN_SQL = f"""{S.daily('events', 'cast(user_id as varchar)', 'ts', {'value': 'value'}, 'uc_grid')},
{S.fill('uc_grid', 'location', ['value'], 'uc_fill')},
{S.zfilter('uc_fill', 'location', ['value'], 'uc_z', constant='drop')},
{S.minmax('uc_z', 'location', ['value'], 'uc_clean', suffix='_scaled')}"""


@query("user_daily_clean", f"""with {U_CLEAN_SQL}
select location, "timestamp", {S.r6('value')}, {S.r6('value_scaled')} from uc_clean""")
def q_user_daily_clean(spark, sf):
    return rounded(user_daily_clean(spark, sf))


def u_windows(spark, sf):
    return ts.sliding_windows(user_daily_clean(spark, sf), "location", "timestamp",
                              ["value_scaled"], "value_scaled", look_back=12)


@query("sliding_windows", f"""with {U_CLEAN_SQL},
lagged as (select location, "timestamp", value_scaled as y,
  lag(value_scaled, 12) over w as x_first, lag(value_scaled, 1) over w as x_last,
  sum(value_scaled) over (partition by location order by "timestamp" rows between 12 preceding and 1 preceding) as x_sum,
  row_number() over w - 1 as sample_pos
  from uc_clean window w as (partition by location order by "timestamp"))
select location, "timestamp", sample_pos, {S.r6('y')}, {S.r6('x_first')}, {S.r6('x_last')}, {S.r6('x_sum')}
from lagged where sample_pos >= 12""")
def q_sliding_windows(spark, sf):
    w = u_windows(spark, sf)
    return rounded(w.select(
        "location", "timestamp", "sample_pos", "y",
        F.element_at(F.element_at("x", 1), 1).alias("x_first"),
        F.element_at(F.element_at("x", -1), 1).alias("x_last"),
        F.aggregate("x", F.lit(0.0), lambda acc, s: acc + F.element_at(s, 1)).alias("x_sum")))


@query("location_keepalive", f"""with {S.daily('events', 'cast(user_id as varchar)', 'ts',
                                               {'value': "case when user_id = 7 then null else value end"}, 'ka_grid')},
{S.fill('ka_grid', 'location', ['value'], 'ka_fill')},
kept as (select location, "timestamp", value from ka_fill where value is not null),
lost as (select distinct cast(user_id as varchar) as location, cast(null as date) as "timestamp", cast(null as double) as value
         from events where cast(user_id as varchar) not in (select location from kept))
select location, "timestamp", {S.r6('value')} from (select * from kept union all select * from lost)""")
def q_location_keepalive(spark, sf):
    u = feed_u(spark, sf)
    u = u.withColumn("value", F.when(F.col("location") == "7", F.lit(None).cast("double")).otherwise(F.col("value")))
    f = ts.ffill_bfill(ts.daily_resample(u, "location", "ts", ["value"]), "location", "timestamp", ["value"])
    return rounded(flt.keep_alive(f, u, "location", ["value"]))


# =====================================================================
# Feed W: lineitem by l_linestatus — cleaned / normalised measures
# =====================================================================
def w_clean(spark, sf):
    g = ts.daily_resample(feed_w(spark, sf), "location", "ts", W_MEASURES)
    f = ts.ffill_bfill(g, "location", "timestamp", W_MEASURES)
    return ts.zscore_filter(f, "location", W_MEASURES, constant="keep")


W_CLEAN_SQL = f"""{S.daily('lineitem', 'l_linestatus', 'l_shipdate', {m: m for m in W_MEASURES}, 'w_grid')},
{S.fill('w_grid', 'location', W_MEASURES, 'w_fill')},
{S.zfilter('w_fill', 'location', W_MEASURES, 'w_clean', constant='keep')}"""
W_OUT = ", ".join(S.r6(m) for m in W_MEASURES)


@query("outlier_zscore", f"""with {W_CLEAN_SQL}
select location, "timestamp", {W_OUT} from w_clean""")
def q_outlier_zscore(spark, sf):
    return rounded(w_clean(spark, sf))


@query("minmax_per_location", f"""with {W_CLEAN_SQL},
{S.minmax('w_clean', 'location', W_MEASURES, 'w_norm')}
select location, "timestamp", {W_OUT} from w_norm""")
def q_minmax_per_location(spark, sf):
    return rounded(ts.minmax_per_key(w_clean(spark, sf), "location", W_MEASURES))


@query("minmax_global", f"""with {W_CLEAN_SQL},
{S.minmax('w_clean', None, W_MEASURES, 'w_gnorm')}
select location, "timestamp", {W_OUT} from w_gnorm""")
def q_minmax_global(spark, sf):
    clean = w_clean(spark, sf)
    stats = ts.fit_minmax(clean, W_MEASURES)
    return rounded(ts.apply_minmax(clean, stats, W_MEASURES))


@query("minmax_inverse", f"""with {W_CLEAN_SQL}
select location, "timestamp", {', '.join(S.r6(m, m + '_restored') for m in W_MEASURES)} from w_clean""")
def q_minmax_inverse(spark, sf):
    clean = w_clean(spark, sf)
    stats = ts.fit_minmax(clean, W_MEASURES)
    scaled = ts.apply_minmax(clean, stats, W_MEASURES, suffix="_s")
    # invert with the original column names as stats keys
    renamed = scaled.select("location", "timestamp", *[F.col(m + "_s").alias(m) for m in W_MEASURES])
    back = ts.invert_minmax(renamed, stats, W_MEASURES, suffix="_restored")
    return rounded(back.select("location", "timestamp", *[m + "_restored" for m in W_MEASURES]))


# =====================================================================
# Feed K: orders as one global daily series
# =====================================================================
K_NULL_BELOW = 150000.0  # days whose mean price is below this are blanked


@query("global_fill", f"""with {S.daily('orders', None, 'o_orderdate', {'o_totalprice': 'o_totalprice'}, 'k_grid')},
k_gap as (select "timestamp", case when o_totalprice < {K_NULL_BELOW} then null else o_totalprice end as o_totalprice from k_grid),
{S.fill('k_gap', None, ['o_totalprice'], 'k_fill')}
select "timestamp", {S.r6('o_totalprice')} from k_fill""")
def q_global_fill(spark, sf):
    g = ts.daily_resample(feed_k(spark, sf), None, "ts", ["o_totalprice"])
    g = g.withColumn("o_totalprice", F.when(F.col("o_totalprice") < K_NULL_BELOW, F.lit(None).cast("double"))
                     .otherwise(F.col("o_totalprice")))
    return rounded(ts.ffill_bfill(g, None, "timestamp", ["o_totalprice"]))


# =====================================================================
# Feed E: events by event_type — schema, filters, profiles, paging
# =====================================================================
from limnos.operators import index as ix  # noqa: E402
from limnos.operators import joins as jn  # noqa: E402
from limnos.operators import profile as pf  # noqa: E402
from limnos.operators import schema as sc  # noqa: E402
from limnos.sources.tables import feed_e, feed_kl, table  # noqa: E402

E_GAP_K = 90.0  # E measures with gaps: k >= 90 blanks k_low and value_gap


def e_gappy(spark, sf):
    e = feed_e(spark, sf)
    return e.select("event_id", "ts", "location", "value", "k",
                    F.when(F.col("k") < E_GAP_K, F.col("k")).alias("k_low"),
                    F.when(F.col("k") >= E_GAP_K, F.lit(None).cast("double")).otherwise(F.col("value")).alias("value_gap"),
                    F.when(F.col("value") < 0, F.col("value")).alias("neg_value"))


E_GAPPY_SQL = f"""e as (select event_id, ts, event_type as location, value,
  try_cast(json_extract_string(props, '$.k') as double) as k from events),
eg as (select *, case when k < {E_GAP_K} then k end as k_low,
  case when k >= {E_GAP_K} then null else value end as value_gap,
  case when value < 0 then value end as neg_value from e)"""


@query("numeric_coercion", """select event_id, ts, try_cast(user_id as double) as user_id,
  try_cast(event_type as double) as event_type, try_cast(value as double) as value,
  try_cast(json_extract_string(props, '$.k') as double) as k from events""")
def q_numeric_coercion(spark, sf):
    ev = table(spark, sf, "events")
    raw = ev.select("event_id", "ts", "user_id", "event_type", "value", F.get_json_object("props", "$.k").alias("k"))
    return sc.select_numeric(sc.coerce_numeric(raw, keys=("event_id", "ts")), keep=("event_id", "ts"))


@query("location_filter", """select event_id, event_type as location, ts, round(value, 6) as value
from events where event_type in ('click', 'purchase')""")
def q_location_filter(spark, sf):
    e = feed_e(spark, sf)
    return rounded(flt.location_filter(e, ["click", "purchase"]).select("event_id", "location", "ts", "value"))


@query("location_list", "select distinct event_type as location from events where event_type is not null")
def q_location_list(spark, sf):
    return flt.key_list(feed_e(spark, sf))


@query("location_counts", "select event_type as location, count(*) as records from events group by 1")
def q_location_counts(spark, sf):
    return pf.location_counts(feed_e(spark, sf))


@query("avg_records_per_location", """select count(*) as n_records, count(distinct event_type) as n_locations,
  round(count(*) / count(distinct event_type), 6) as avg_records from events""")
def q_avg_records(spark, sf):
    return rounded(pf.avg_records_per_location(feed_e(spark, sf)))


@query("drop_all_null_columns", f"""with {E_GAPPY_SQL}
select event_id, location, round(value, 6) as value, round(k, 6) as k, round(k_low, 6) as k_low from eg""")
def q_drop_all_null_columns(spark, sf):
    e = e_gappy(spark, sf).select("event_id", "location", "value", "k", "k_low", "neg_value")
    kept, _ = flt.drop_all_null_columns(e, keep=["event_id", "location"])
    return rounded(kept)


@query("dropna_any", f"""with {E_GAPPY_SQL}
select event_id, location, round(value, 6) as value, round(k_low, 6) as k_low from eg where k_low is not null""")
def q_dropna_any(spark, sf):
    e = e_gappy(spark, sf).select("event_id", "location", "value", "k_low", "neg_value")
    kept, _ = flt.drop_all_null_columns(e, keep=["event_id", "location"])  # C06 before C05
    return rounded(flt.drop_any_null(kept))


@query("one_hot", """select event_id, round(value, 6) as value,
  case when event_type = 'click' then 1 else 0 end as location_click,
  case when event_type = 'error' then 1 else 0 end as location_error,
  case when event_type = 'purchase' then 1 else 0 end as location_purchase,
  case when event_type = 'signup' then 1 else 0 end as location_signup,
  case when event_type = 'view' then 1 else 0 end as location_view from events""")
def q_one_hot(spark, sf):
    e = feed_e(spark, sf).select("event_id", "value", "location")
    return rounded(ix.one_hot(e, "location"))


@query("mean_impute", f"""with {E_GAPPY_SQL}
select event_id, round(coalesce(value_gap, avg(value_gap) over ()), 6) as value_gap,
  round(coalesce(k_low, avg(k_low) over ()), 6) as k_low from eg""")
def q_mean_impute(spark, sf):
    e = e_gappy(spark, sf).select("event_id", "value_gap", "k_low")
    return rounded(ix.mean_impute(e, ["value_gap", "k_low"]))


@query("round_upper", """select event_id, upper(event_type) as location, round(value / 3, 6) as value_third from events""")
def q_round_upper(spark, sf):
    e = feed_e(spark, sf).select("event_id", "location", (F.col("value") / 3).alias("value_third"))
    return ix.round_upper(e, ["value_third"], "location")


E_PROFILE_COLS = ["location", "value", "k", "k_low", "value_gap", "neg_value"]


def _profile_sql(kind: str) -> str:
    parts = []
    for c in E_PROFILE_COLS:
        if kind == "null":
            parts.append(f"select '{c}' as \"column\", count({c}) as non_null, count(*) - count({c}) as nulls from eg")
        else:
            parts.append(f"select '{c}' as \"column\", count(*) - count({c}) as missing_count, "
                         f"round((count(*) - count({c})) * 100.0 / count(*), 2) as missing_pct from eg")
    body = " union all ".join(parts)
    where = " where missing_count > 0" if kind == "missing" else ""
    return f"with {E_GAPPY_SQL} select * from ({body}){where}"


@query("null_profile", _profile_sql("null"))
def q_null_profile(spark, sf):
    return pf.null_profile(e_gappy(spark, sf), E_PROFILE_COLS)


@query("missing_profile", _profile_sql("missing"))
def q_missing_profile(spark, sf):
    return rounded(pf.missing_profile(e_gappy(spark, sf), E_PROFILE_COLS))


E_DESCRIBE_COLS = ["value", "k", "value_gap"]


@query("describe", f"with {E_GAPPY_SQL} " + " union all ".join(
    f"""select '{c}' as "column", count({c}) as count, round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as std,
  round(min({c}), 6) as min, round(quantile_cont({c}, 0.25), 6) as p25, round(quantile_cont({c}, 0.5), 6) as p50,
  round(quantile_cont({c}, 0.75), 6) as p75, round(max({c}), 6) as max from eg""" for c in E_DESCRIBE_COLS))
def q_describe(spark, sf):
    return rounded(pf.describe(e_gappy(spark, sf), E_DESCRIBE_COLS))


@query("preview", """select event_id, ts, event_type as location, round(value, 6) as value from events
order by ts, event_id limit 10""")
def q_preview(spark, sf):
    e = feed_e(spark, sf).select("event_id", "ts", "location", "value")
    return rounded(e.orderBy("ts", "event_id").limit(10))


PAGE, PAGE_SIZE = 3, 25


@query("page", f"""select event_id, ts, event_type as location, round(value, 6) as value,
  {PAGE} as page, {PAGE_SIZE} as page_size,
  (select cast(ceil(count(*) / {PAGE_SIZE}.0) as bigint) from events) as n_pages from events
order by event_id limit {PAGE_SIZE} offset {(PAGE - 1) * PAGE_SIZE}""")
def q_page(spark, sf):
    """Page p of size s in a stable order, with the page count ceil(n/s)."""
    from limnos.operators.common import attach_row
    e = feed_e(spark, sf).select("event_id", "ts", "location", "value")
    rows_ = e.orderBy("event_id").offset((PAGE - 1) * PAGE_SIZE).limit(PAGE_SIZE)
    n_pages = e.agg(F.ceil(F.count(F.lit(1)) / PAGE_SIZE).cast("bigint").alias("n_pages"))
    return rounded(attach_row(rows_.withColumns({"page": F.lit(PAGE), "page_size": F.lit(PAGE_SIZE)}), n_pages))


@query("latest_per_location", """select location, event_id, ts, round(value, 6) as value from (
  select event_type as location, event_id, ts, value,
  row_number() over (partition by event_type order by ts desc, event_id desc) as rn from events) where rn = 1""")
def q_latest_per_location(spark, sf):
    e = feed_e(spark, sf)
    # per-group arg-max is a partial aggregate: a hot location is combined map-side
    best = e.groupBy("location").agg(F.max_by(F.struct("event_id", "ts", "value"),
                                              F.struct("ts", "event_id")).alias("r"))
    return rounded(best.select("location", "r.event_id", "r.ts", "r.value"))


# =====================================================================
# Feed W (continued): canonical reading, rollups, calendars
# =====================================================================
def w_raw_padded(spark, sf):
    """Lineitem dressed as a raw water feed: padded / aliased names, YEAR and
    MONTH parts, text measures. Rows with l_linenumber 7 carry an invalid
    month, rows with l_linenumber 3 no site, rows with l_linenumber 5 the
    text 'n/a' as quantity."""
    li = table(spark, sf, "lineitem")
    return li.select(
        F.when(F.col("l_linenumber") == 3, F.lit(None)).otherwise(F.col("l_linestatus")).alias(" Site "),
        F.year("l_shipdate").alias(" YEAR"),
        F.when(F.col("l_linenumber") == 7, F.lit(13)).otherwise(F.month("l_shipdate")).alias("MONTH  "),
        F.when(F.col("l_linenumber") == 5, F.lit("n/a")).otherwise(F.col("l_quantity").cast("string")).alias("  quantity "),
        F.col("l_tax").alias("tax   "))


@query("canonical_reading", """select l_linestatus as location, make_date(year(l_shipdate), month(l_shipdate), 1) as "timestamp",
  case when l_linenumber = 5 then null else l_quantity end as quantity, round(l_tax, 6) as tax
from lineitem where l_linenumber <> 7 and l_linenumber <> 3""")
def q_canonical_reading(spark, sf):
    df = sc.canonical_names(w_raw_padded(spark, sf))
    df = sc.canonical_location(df)
    df = sc.canonical_time(df, as_date=True)
    df = flt.drop_null_location(flt.drop_null_time(df))
    return rounded(sc.coerce_numeric(df).select("location", "timestamp", "quantity", "tax"))


def _rollup_sql(unit: str) -> str:
    return f"""select l_linestatus as location, cast(date_trunc('{unit}', l_shipdate) as date) as period, count(*) as n,
  round(avg(l_quantity), 6) as avg_l_quantity, round(min(l_quantity), 6) as min_l_quantity, round(max(l_quantity), 6) as max_l_quantity,
  round(avg(l_extendedprice), 6) as avg_l_extendedprice, round(min(l_extendedprice), 6) as min_l_extendedprice,
  round(max(l_extendedprice), 6) as max_l_extendedprice
from lineitem group by 1, 2"""


def _rollup(unit):
    def run(spark, sf):
        return rounded(ts.period_rollup(feed_w(spark, sf), "location", "ts", ["l_quantity", "l_extendedprice"], unit))
    return run


for _unit in ("week", "month", "year"):
    query(f"period_rollup_{_unit}", _rollup_sql(_unit))(_rollup(_unit))


@query("month_end_dates", """select location, step, last_day(last_d + to_months(step)) as forecast_date from
  (select l_linestatus as location, max(cast(l_shipdate as date)) as last_d from lineitem group by 1),
  (select cast(unnest(generate_series(1, 12)) as integer) as step)""")
def q_month_end_dates(spark, sf):
    return ts.month_end_dates(feed_w(spark, sf), "location", "ts", 12)


# =====================================================================
# Joins and unions: W (located water) with K / KL (climate-like)
# =====================================================================
def k_clean(spark, sf):
    g = ts.daily_resample(feed_k(spark, sf), None, "ts", ["o_totalprice"])
    return ts.ffill_bfill(g, None, "timestamp", ["o_totalprice"])


K_FILL_SQL = f"""{S.daily('orders', None, 'o_orderdate', {'o_totalprice': 'o_totalprice'}, 'k_grid')},
{S.fill('k_grid', None, ['o_totalprice'], 'k_fill')}"""


@query("join_global_climate", f"""with {W_CLEAN_SQL}, {K_FILL_SQL}
select w.location, w."timestamp", {', '.join(S.r6('w.' + m, m) for m in W_MEASURES)}, {S.r6('k.o_totalprice', 'o_totalprice')},
  case when k."timestamp" is not null then 'water_climate_combined' else 'water_only' end as data_source
from w_clean w left join k_fill k on w."timestamp" = k."timestamp\"""")
def q_join_global_climate(spark, sf):
    return rounded(jn.left_join_tagged(w_clean(spark, sf), k_clean(spark, sf), ["timestamp"]))


@query("join_by_location", f"""with {W_CLEAN_SQL},
{S.daily('orders', 'o_orderstatus', 'o_orderdate', {'o_totalprice': 'o_totalprice'}, 'kl_grid')}
select w.location, w."timestamp", {', '.join(S.r6('w.' + m, m) for m in W_MEASURES)}, {S.r6('k.o_totalprice', 'o_totalprice')},
  case when k."timestamp" is not null then 'water_climate_combined' else 'water_only' end as data_source
from w_clean w left join kl_grid k on w.location = k.location and w."timestamp" = k."timestamp\"""")
def q_join_by_location(spark, sf):
    kl = ts.daily_resample(feed_kl(spark, sf), "location", "ts", ["o_totalprice"])
    return rounded(jn.left_join_tagged(w_clean(spark, sf), kl, ["location", "timestamp"]))


@query("join_means_broadcast", f"""with {W_CLEAN_SQL}, {K_FILL_SQL}
select location, "timestamp", {W_OUT}, round((select avg(o_totalprice) from k_fill), 6) as o_totalprice_climate from w_clean""")
def q_join_means_broadcast(spark, sf):
    return rounded(jn.attach_means(w_clean(spark, sf), k_clean(spark, sf), ["o_totalprice"]))


@query("join_positional", f"""with {S.daily('lineitem', None, 'l_shipdate', {'l_quantity': 'l_quantity'}, 'wg_grid')}, {K_FILL_SQL},
a as (select row_number() over (order by "timestamp") - 1 as row_pos, "timestamp" as w_timestamp, l_quantity from wg_grid),
b as (select row_number() over (order by "timestamp") - 1 as row_pos, "timestamp" as k_timestamp, o_totalprice from k_fill)
select coalesce(a.row_pos, b.row_pos) as row_pos, w_timestamp, {S.r6('l_quantity')}, k_timestamp, {S.r6('o_totalprice')}
from a full join b on a.row_pos = b.row_pos""")
def q_join_positional(spark, sf):
    wg = ts.daily_resample(feed_w(spark, sf), None, "ts", ["l_quantity"])
    a = wg.select(F.col("timestamp").alias("w_timestamp"), "l_quantity", F.year("timestamp").alias("_ya"))
    b = k_clean(spark, sf).select(F.col("timestamp").alias("k_timestamp"), "o_totalprice",
                                  F.year("timestamp").alias("_yb"))
    z = jn.zip_by_position(a, b, ["w_timestamp"], ["k_timestamp"], "_ya", "_yb")
    return rounded(z.select("row_pos", "w_timestamp", "l_quantity", "k_timestamp", "o_totalprice"))


@query("join_global_global", f"""with {S.daily('lineitem', None, 'l_shipdate', {'l_quantity': 'l_quantity'}, 'wg_grid')}, {K_FILL_SQL}
select w."timestamp", {S.r6('w.l_quantity', 'l_quantity')}, {S.r6('k.o_totalprice', 'o_totalprice')},
  case when k."timestamp" is not null then 'water_climate_combined' else 'water_only' end as data_source
from wg_grid w left join k_fill k on w."timestamp" = k."timestamp\"""")
def q_join_global_global(spark, sf):
    """A global (unlocated) daily series joined to the global side series."""
    wg = ts.daily_resample(feed_w(spark, sf), None, "ts", ["l_quantity"])
    return rounded(jn.left_join_tagged(wg, k_clean(spark, sf), ["timestamp"]))


@query("join_suffixes", f"""with {W_CLEAN_SQL}, {K_FILL_SQL}
select w.location, w."timestamp", {S.r6('w.l_extendedprice', 'value_water')}, {S.r6('k.o_totalprice', 'value_climate')},
  case when k."timestamp" is not null then 'water_climate_combined' else 'water_only' end as data_source
from w_clean w left join k_fill k on w."timestamp" = k."timestamp\"""")
def q_join_suffixes(spark, sf):
    w = w_clean(spark, sf).select("location", "timestamp", F.col("l_extendedprice").alias("value"))
    k = k_clean(spark, sf).select("timestamp", F.col("o_totalprice").alias("value"))
    return rounded(jn.left_join_tagged(w, k, ["timestamp"]))


@query("join_passthrough", f"""with {W_CLEAN_SQL},
{S.daily('events', None, 'ts', {'value': 'value'}, 'ev_grid')}
select w.location, w."timestamp", {S.r6('w.l_quantity', 'l_quantity')}, {S.r6('e.value', 'value')},
  case when e."timestamp" is not null then 'water_climate_combined' else 'water_only' end as data_source
from w_clean w left join ev_grid e on w."timestamp" = e."timestamp\"""")
def q_join_passthrough(spark, sf):
    ev = ts.daily_resample(table(spark, sf, "events"), None, "ts", ["value"])
    return rounded(jn.left_join_tagged(w_clean(spark, sf).select("location", "timestamp", "l_quantity"), ev, ["timestamp"]))


def w_variants(spark, sf):
    clean = w_clean(spark, sf)
    norm = ts.minmax_per_key(clean, "location", W_MEASURES)
    return jn.union_variants(clean, norm).withColumn("processing_stage", F.col("data_type"))


W_VARIANTS_SQL = f"""{W_CLEAN_SQL},
{S.minmax('w_clean', 'location', W_MEASURES, 'w_norm')},
w_var as (select location, "timestamp", {', '.join(W_MEASURES)}, 'cleaned' as data_type from w_clean
  union all select location, "timestamp", {', '.join(W_MEASURES)}, 'normalized' as data_type from w_norm)"""


@query("union_variants", f"""with {W_VARIANTS_SQL}
select location, "timestamp", {W_OUT}, data_type, data_type as processing_stage from w_var""")
def q_union_variants(spark, sf):
    return rounded(w_variants(spark, sf))


@query("union_by_name", f"""with {W_CLEAN_SQL}
select location, "timestamp", {S.r6('l_quantity')}, {S.r6('l_extendedprice')}, cast(null as double) as l_tax from w_clean where location = 'F'
union all
select location, "timestamp", {S.r6('l_quantity')}, cast(null as double) as l_extendedprice, {S.r6('l_tax')} from w_clean where location = 'O'""")
def q_union_by_name(spark, sf):
    c = w_clean(spark, sf)
    f = c.where(F.col("location") == "F").select("location", "timestamp", "l_quantity", "l_extendedprice")
    o = c.where(F.col("location") == "O").select("location", "timestamp", "l_quantity", "l_tax")
    return rounded(jn.union_by_name([f, o]))


SEQ_SQL = f"""with {W_VARIANTS_SQL},
seq as (select location, "timestamp", data_type, {', '.join(W_MEASURES)},
  row_number() over (order by location, "timestamp", data_type) - 1 as sequence_id,
  true as sliding_window_ready, 30 as window_size_recommended, count(*) over () as total_sequences from w_var)"""


@query("sequence_metadata", f"""{SEQ_SQL}
select location, "timestamp", data_type, {W_OUT}, sequence_id, sliding_window_ready, window_size_recommended, total_sequences from seq""")
def q_sequence_metadata(spark, sf):
    v = w_variants(spark, sf).drop("processing_stage")
    return rounded(sc.sequence_metadata(v, "location", ("timestamp", "data_type")))


@query("scaling_metadata", f"""{SEQ_SQL}
select location, "timestamp", data_type, {W_OUT}, sequence_id, sliding_window_ready, window_size_recommended, total_sequences,
  {len(W_MEASURES) + 3} as numeric_columns_count, 'MinMaxScaler_0_to_1' as scaling_method from seq""")
def q_scaling_metadata(spark, sf):
    v = w_variants(spark, sf).drop("processing_stage")
    return rounded(sc.scaling_metadata(sc.sequence_metadata(v, "location", ("timestamp", "data_type"))))


@query("feature_set_projection", f"""with {W_CLEAN_SQL}
select location, "timestamp", {S.r6('l_tax', 'tax')}, {S.r6('l_quantity', 'quantity')} from w_clean""")
def q_feature_set_projection(spark, sf):
    p = sc.project_features(w_clean(spark, sf), ["l_tax", "l_quantity", "not_in_table"], keep=["location", "timestamp"])
    return rounded(sc.rename(p, {"l_tax": "tax", "l_quantity": "quantity"}))


@query("missing_feature_default", f"""with {W_CLEAN_SQL}
select location, "timestamp", {S.r6('l_quantity')}, cast(0.0 as double) as rainfall, cast(0.0 as double) as tmax from w_clean""")
def q_missing_feature_default(spark, sf):
    p = sc.project_features(w_clean(spark, sf), ["l_quantity"], keep=["location", "timestamp"])
    return rounded(sc.backfill_columns(p, ["l_quantity", "rainfall", "tmax"]))


# ---------------------------------------------------------------- index
W_WEIGHTS = {"l_quantity": 0.4, "l_extendedprice": 0.3, "l_discount": 0.2, "l_tax": 0.1}


def w_index(spark, sf):
    norm = ts.minmax_per_key(w_clean(spark, sf), "location", W_MEASURES)
    pct = norm.withColumns({m: F.col(m) * 100.0 for m in W_MEASURES})
    return ix.weighted_index(pct, W_WEIGHTS, out="WQI").select("location", "timestamp", "WQI")


W_INDEX_SQL = f"""{W_CLEAN_SQL},
{S.minmax('w_clean', 'location', W_MEASURES, 'w_norm')},
w_idx as (select location, "timestamp", {' + '.join(f'coalesce({m} * 100.0, 0.0) * {w}' for m, w in W_WEIGHTS.items())} as WQI from w_norm)"""


@query("weighted_index", f"""with {W_INDEX_SQL} select location, "timestamp", {S.r6('WQI')} from w_idx""")
def q_weighted_index(spark, sf):
    return rounded(w_index(spark, sf))


@query("index_range", f"""with {W_INDEX_SQL} select {S.r6('min(WQI)', 'min_WQI')}, {S.r6('max(WQI)', 'max_WQI')} from w_idx""")
def q_index_range(spark, sf):
    return rounded(pf.value_range(w_index(spark, sf), "WQI"))


def _advice_case(col):
    from limnos.functions.constants import WQI_ADVICE
    arms = " ".join(f"when '{k}' then '{v}'" for k, v in WQI_ADVICE.items())
    return f"case {col} {arms} end"


@query("index_class", f"""with {W_INDEX_SQL},
c as (select location, "timestamp", WQI, case when WQI < 50 then 'Excellent' when WQI < 75 then 'Good'
  when WQI < 90 then 'Fair' else 'Poor' end as wqi_class from w_idx)
select location, "timestamp", {S.r6('WQI')}, wqi_class, {_advice_case('wqi_class')} as advice from c""")
def q_index_class(spark, sf):
    return rounded(ix.index_class(w_index(spark, sf), "WQI"))


@query("clamp", f"""with {W_INDEX_SQL}
select location, "timestamp", {S.r6('greatest(0.0, least(100.0, WQI * 1.5 - 10.0))', 'wqi_clamped')} from w_idx""")
def q_clamp(spark, sf):
    d = w_index(spark, sf).withColumn("wqi_clamped", F.col("WQI") * 1.5 - 10.0)
    return rounded(ix.clamp_col(d, "wqi_clamped").select("location", "timestamp", "wqi_clamped"))


@query("format_value", """select l_orderkey, l_linenumber,
  case when l_discount = 0 then 'N/A' else printf('%.2f', round(l_extendedprice, 2)) end as price_text from lineitem""")
def q_format_value(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.when(F.col("l_discount") == 0, F.lit(None).cast("double")).otherwise(F.col("l_extendedprice")).alias("price_text"))
    return ix.format_col(li, "price_text")


# ---------------------------------------------------------------- distributions
@query("box_stats", """with s as (select l_linestatus as location, min(l_extendedprice) as min,
  quantile_cont(l_extendedprice, 0.25) as q1, quantile_cont(l_extendedprice, 0.5) as median,
  quantile_cont(l_extendedprice, 0.75) as q3, max(l_extendedprice) as max from lineitem group by 1),
f as (select *, q1 - 1.5 * (q3 - q1) as lower_fence, q3 + 1.5 * (q3 - q1) as upper_fence from s),
o as (select f.location, count(*) filter (where l_extendedprice < lower_fence or l_extendedprice > upper_fence) as outliers
  from lineitem l join f on l.l_linestatus = f.location group by 1)
select f.location, round(min, 6) as min, round(q1, 6) as q1, round(median, 6) as median, round(q3, 6) as q3,
  round(max, 6) as max, round(lower_fence, 6) as lower_fence, round(upper_fence, 6) as upper_fence, o.outliers
from f join o on f.location = o.location""")
def q_box_stats(spark, sf):
    return rounded(pf.box_stats(feed_w(spark, sf), "location", "l_extendedprice"))


@query("histogram30", """with r as (select min(l_extendedprice) as lo, max(l_extendedprice) as hi from lineitem),
b as (select case when hi = lo then 0 else least(floor((l_extendedprice - lo) / ((hi - lo) / 30)), 29) end as bin, lo, hi
  from lineitem, r where l_extendedprice is not null)
select cast(bin as int) as bin, round(lo + bin * ((hi - lo) / 30), 6) as lower, round(lo + (bin + 1) * ((hi - lo) / 30), 6) as upper,
  count(*) as count from b group by bin, lo, hi""")
def q_histogram30(spark, sf):
    return rounded(pf.histogram(feed_w(spark, sf), "l_extendedprice", 30))


CORR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_partkey", "l_suppkey"]


def _corr_sql(top: bool) -> str:
    parts = []
    for i, a in enumerate(CORR_COLS):
        for j, b in enumerate(CORR_COLS):
            if top and not i < j:
                continue
            if i == j:
                r = f"case when stddev_pop({a}) > 0 then 1.0 end"
            else:
                r = f"covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0)"
            parts.append(f"select '{a}' as col_a, '{b}' as col_b, cast({r} as double) as r from lineitem")
    body = " union all ".join(parts)
    if top:
        return f"select col_a, col_b, round(r, 6) as r from ({body}) where r is not null order by abs(r) desc, col_a, col_b limit 10"
    return f"select col_a, col_b, round(r, 6) as r from ({body})"


@query("corr_matrix", _corr_sql(False))
def q_corr_matrix(spark, sf):
    return rounded(pf.corr_matrix(table(spark, sf, "lineitem"), CORR_COLS))


@query("top_correlations", _corr_sql(True))
def q_top_correlations(spark, sf):
    corr = pf.corr_matrix(table(spark, sf, "lineitem"), CORR_COLS)
    return rounded(pf.top_correlations(corr, CORR_COLS, 10))


# =====================================================================
# Flagship: stage 1 end to end (W located feed ⟕ K global side feed)
# =====================================================================
from limnos.plans.prepare import prepare  # noqa: E402


def prepared_table(spark, sf):
    return prepare(feed_w(spark, sf), feed_k(spark, sf), "location", "ts", W_MEASURES,
                   climate_ts="ts", climate_measures=["o_totalprice"])


_PT_COLS = f'location, "timestamp", {", ".join(W_MEASURES)}, o_totalprice, data_source, processing_stage, data_type'
PREPARED_SQL = f"""{W_CLEAN_SQL},
{S.minmax('w_clean', 'location', W_MEASURES, 'w_norm')},
{K_FILL_SQL},
{S.zfilter('k_fill', None, ['o_totalprice'], 'k_clean')},
{S.minmax('k_clean', None, ['o_totalprice'], 'k_norm')},
cj as (select w.location, w."timestamp", {', '.join('w.' + m for m in W_MEASURES)}, k.o_totalprice,
  case when k."timestamp" is not null then 'water_climate_combined' else 'water_only' end as data_source,
  'cleaned' as processing_stage, 'cleaned' as data_type from w_clean w left join k_clean k on w."timestamp" = k."timestamp"),
nj as (select w.location, w."timestamp", {', '.join('w.' + m for m in W_MEASURES)}, k.o_totalprice,
  case when k."timestamp" is not null then 'water_climate_combined' else 'water_only' end as data_source,
  'normalized' as processing_stage, 'normalized' as data_type from w_norm w left join k_norm k on w."timestamp" = k."timestamp"),
pt_u as (select {_PT_COLS} from cj union all select {_PT_COLS} from nj),
pt as (select *, row_number() over (order by location, "timestamp", data_type) - 1 as sequence_id,
  true as sliding_window_ready, 30 as window_size_recommended, count(*) over () as total_sequences,
  {len(W_MEASURES) + 1 + 3} as numeric_columns_count, 'MinMaxScaler_0_to_1' as scaling_method from pt_u)"""


@query("prepared_table", f"""with {PREPARED_SQL}
select location, "timestamp", {W_OUT}, {S.r6('o_totalprice')}, data_source, processing_stage, data_type, sequence_id,
  sliding_window_ready, window_size_recommended, total_sequences, numeric_columns_count, scaling_method from pt""")
def q_prepared_table(spark, sf):
    return rounded(prepared_table(spark, sf))


# =====================================================================
# Splits, shape fitting, cleaning report (U windows, embeddings)
# =====================================================================
from limnos.operators import forecast as fc  # noqa: E402
from limnos.plans.prepare import cleaning_report  # noqa: E402


def u_samples(spark, sf):
    """U look-back windows with the deterministic hash split."""
    return ts.hash_split(u_windows(spark, sf), ["location", "timestamp"])


SPLIT_SQL = """case when (('0x' || substr(md5('42|' || location || '|' || cast("timestamp" as varchar)), 1, 8))::bigint) % 100 < 20
  then 'test' else 'train' end"""
U_SAMPLES_SQL = f"""{U_CLEAN_SQL},
us_lag as (select location, "timestamp", value_scaled as y,
  lag(value_scaled, 1) over w as x_last,
  avg(value_scaled) over (partition by location order by "timestamp" rows between 12 preceding and 1 preceding) as x_mean,
  row_number() over w - 1 as sample_pos
  from uc_clean window w as (partition by location order by "timestamp")),
us as (select *, {SPLIT_SQL} as split from us_lag where sample_pos >= 12)"""


@query("train_test_split", f"""with {U_SAMPLES_SQL} select location, "timestamp", split from us""")
def q_train_test_split(spark, sf):
    return u_samples(spark, sf).select("location", "timestamp", "split")


@query("train_test_split_time", f"""with {U_SAMPLES_SQL},
ranked as (select location, "timestamp", row_number() over (partition by location order by "timestamp") - 1 as rn,
  count(*) over (partition by location) as n from us)
select location, "timestamp", case when rn >= ceil(n * 0.8) then 'test' else 'train' end as split from ranked""")
def q_train_test_split_time(spark, sf):
    """D10 ``mode="time"``: the last 20 % of each user's windows are test."""
    return ts.time_split(u_samples(spark, sf).drop("split"), "location", "timestamp").select(
        "location", "timestamp", "split")


@query("validation_tail", f"""with {U_SAMPLES_SQL}
select location, "timestamp", percent_rank() over (order by location, "timestamp") >= 0.8 as is_validation
from us where split = 'train'""")
def q_validation_tail(spark, sf):
    tr = u_samples(spark, sf).where(F.col("split") == "train").select("location", "timestamp")
    return ts.validation_tail(tr, "location", ["timestamp"])


@query("shape_fit", """select vec_id, 12 as n_steps, 40 as n_feats,
  round(12 * list_sum(cast(list_slice(embedding, 1, 40) as double[])), 6) as x_sum,
  round(cast(embedding[1] as double), 6) as x_first, round(cast(embedding[40] as double), 6) as x_last,
  80 as n_padded, round(list_sum(cast(embedding as double[])), 6) as padded_sum from embeddings""")
def q_shape_fit(spark, sf):
    e = table(spark, sf, "embeddings")
    x = ts.fit_shape(F.col("embedding"), 12, 40)
    p = ts.fit_shape(F.col("embedding"), 1, 80)
    total = F.aggregate(F.flatten(x), F.lit(0.0), lambda a, v: a + v)
    return rounded(e.select(
        "vec_id", F.size(x).alias("n_steps"), F.size(F.element_at(x, 1)).alias("n_feats"), total.alias("x_sum"),
        F.element_at(F.element_at(x, 1), 1).alias("x_first"), F.element_at(F.element_at(x, -1), -1).alias("x_last"),
        F.size(F.element_at(p, 1)).alias("n_padded"),
        F.aggregate(F.element_at(p, 1), F.lit(0.0), lambda a, v: a + v).alias("padded_sum")))


@query("cleaning_report", f"""with {S.daily('events', 'cast(user_id as varchar)', 'ts', {'value': 'value'}, 'cr_grid')},
{S.fill('cr_grid', 'location', ['value'], 'cr_fill', keep_raw=True)},
cr_z as (select *, coalesce(abs((value - avg(value) over (partition by location))
    / nullif(stddev_pop(value) over (partition by location), 0)) < 3, false) as keep from cr_fill)
select location, cast(count(*) - count(value_raw) as bigint) as gaps,
  cast(count(*) filter (where value_raw is null and value is not null) as bigint) as filled,
  cast(count(*) filter (where not keep) as bigint) as outliers_removed,
  cast(count(*) filter (where keep) as bigint) as rows_left from cr_z group by location""")
def q_cleaning_report(spark, sf):
    return cleaning_report(feed_u(spark, sf), "location", "ts", ["value"], constant="drop")


# =====================================================================
# Forecast baselines and model comparison
# =====================================================================
def u_predictions(spark, sf):
    return fc.baseline_predictions(u_samples(spark, sf), "location", ["location", "timestamp", "split"])


AR1_SQL = """(case when var_pop(case when split = 'train' then x_last end) over (partition by location) > 0
  then avg(case when split = 'train' then y end) over (partition by location)
     - covar_pop(case when split = 'train' then x_last end, case when split = 'train' then y end) over (partition by location)
       / var_pop(case when split = 'train' then x_last end) over (partition by location)
       * avg(case when split = 'train' then x_last end) over (partition by location)
     + covar_pop(case when split = 'train' then x_last end, case when split = 'train' then y end) over (partition by location)
       / var_pop(case when split = 'train' then x_last end) over (partition by location) * x_last
  end)"""
PRED_SQL = f"""{U_SAMPLES_SQL},
preds as (select 'last_value' as model, location, "timestamp", split, y, x_last as prediction from us
  union all select 'mean12', location, "timestamp", split, y, x_mean from us
  union all select 'ar1', location, "timestamp", split, y, coalesce({AR1_SQL}, x_last) from us)"""


def _forecast_sql(model: str) -> str:
    return f"""with {PRED_SQL}
select location, "timestamp", split, {S.r6('y')}, {S.r6('prediction')} from preds where model = '{model}'"""


def _forecast_q(model):
    def run(spark, sf):
        s = u_samples(spark, sf)
        return rounded(fc.BASELINES[model](s, "location").select("location", "timestamp", "split", "y", "prediction"))
    return run


for _m, _name in (("last_value", "forecast_last_value"), ("mean12", "forecast_mean12"), ("ar1", "forecast_ar1")):
    query(_name, _forecast_sql(_m))(_forecast_q(_m))


METRICS_SQL = f"""{PRED_SQL},
m as (select model, count(*) as n, avg((prediction - y) * (prediction - y)) as mse, avg(abs(prediction - y)) as mae,
  sum((prediction - y) * (prediction - y)) as sse, count(*) * var_pop(y) as sst from preds
  where split = 'test' and y is not null and prediction is not null group by model)"""


def u_metrics(spark, sf):
    p = u_predictions(spark, sf).where(F.col("split") == "test")
    return pf.regression_metrics(p, "y", "prediction", ("model",))


@query("error_metrics", f"""with {METRICS_SQL}
select model, n, {S.r6('mse')}, {S.r6('sqrt(mse)', 'rmse')}, {S.r6('mae')},
  {S.r6('case when sst > 0 then 1 - sse / sst end', 'r2')} from m""")
def q_error_metrics(spark, sf):
    return rounded(u_metrics(spark, sf))


@query("best_model", f"""with {METRICS_SQL}
select model as best_model, {S.r6('mse', 'best_mse')} from m order by mse, model limit 1""")
def q_best_model(spark, sf):
    return rounded(pf.pick_best(u_metrics(spark, sf), "mse"))


def comparison_document(metrics: DataFrame) -> DataFrame:
    """The nested comparison document as one row: ``models`` maps each model
    to its metrics struct; ``best_model`` is the lowest-MSE model (A09 layout).
    Bounded by the number of models."""
    entry = F.struct(F.col("model"), F.struct("mse", "rmse", "mae", "r2").alias("metrics"))
    return metrics.agg(F.map_from_entries(F.collect_list(entry)).alias("models"),
                       F.min_by("model", F.struct("mse", "model")).alias("best_model"))


def flatten_document(doc: DataFrame) -> DataFrame:
    """One row per model with its metrics; ``best_model`` is not a model."""
    ex = doc.select(F.explode("models").alias("model", "m"))
    return ex.select("model", "m.mse", "m.rmse", "m.mae", "m.r2")


@query("metrics_flat", f"""with {METRICS_SQL}
select upper(model) as model, {S.r6('mse')}, {S.r6('sqrt(mse)', 'rmse')}, {S.r6('mae')},
  {S.r6('case when sst > 0 then 1 - sse / sst end', 'r2')} from m""")
def q_metrics_flat(spark, sf):
    flat = flatten_document(comparison_document(u_metrics(spark, sf)))
    return rounded(ix.round_upper(flat, ["mse", "rmse", "mae", "r2"], "model"))


@query("forecast_pivot", f"""with {PRED_SQL}
select location,
  round(max_by(prediction, "timestamp") filter (where model = 'last_value'), 6) as last_value,
  round(max_by(prediction, "timestamp") filter (where model = 'mean12'), 6) as mean12,
  round(max_by(prediction, "timestamp") filter (where model = 'ar1'), 6) as ar1
from preds group by location""")
def q_forecast_pivot(spark, sf):
    p = u_predictions(spark, sf)
    latest = p.groupBy("location", "model").agg(F.max_by("prediction", "timestamp").alias("prediction"))
    return rounded(pf.pivot_wide(latest, "location", "model", "prediction", ["last_value", "mean12", "ar1"]))


@query("model_overview", f"""with {METRICS_SQL}
select count(*) as n_models, string_agg(model, ',' order by model) as models,
  string_agg(model || '=' || case when mse is null then 'N/A' else printf('%.2f', round(mse, 2)) end, ',' order by model) as mse_text
from m""")
def q_model_overview(spark, sf):
    m = u_metrics(spark, sf)
    m = ix.format_col(m, "mse", "mse_text")
    return m.agg(F.count(F.lit(1)).alias("n_models"),
                 F.array_join(F.sort_array(F.collect_list("model")), ",").alias("models"),
                 F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("model", "mse_text"))),
                                          lambda s: F.concat(s["model"], F.lit("="), s["mse_text"])), ",").alias("mse_text"))


@query("mean_prediction", f"""with {PRED_SQL}
select model, {S.r6('greatest(0.0, least(100.0, coalesce(avg(prediction * 100.0), 60.0)))', 'mean_prediction')}
from preds group by model""")
def q_mean_prediction(spark, sf):
    p = u_predictions(spark, sf).withColumn("prediction", F.col("prediction") * 100.0)
    return rounded(ix.mean_prediction(p))


# =====================================================================
# Spark ML forecasting on W windows (rows-only: not SQL-expressible)
# =====================================================================
from limnos.plans import training as tr  # noqa: E402


def w_samples(spark, sf):
    norm = ts.minmax_per_key(w_clean(spark, sf), "location", W_MEASURES)
    win = ts.sliding_windows(norm, "location", "timestamp", W_MEASURES, "l_quantity", 12)
    return ts.hash_split(win, ["location", "timestamp"])


@query("forecast_ml")
def q_forecast_ml(spark, sf):
    """Linear, random forest and GBT on the W windows;
    test-set metrics per family."""
    metrics, _ = tr.train_and_compare(tr.training_table(w_samples(spark, sf)))
    return rounded(metrics)


@query("search_trials")
def q_search_trials(spark, sf):
    """Seeded random search, 15/15/20 draws, scored on the last fifth
    of every location."""
    return tr.search(tr.training_table(w_samples(spark, sf)))


@query("multi_target")
def q_multi_target(spark, sf):
    """Next-day forecast of every W measure per location, in its units."""
    clean = w_clean(spark, sf)
    norm = ts.minmax_per_key(clean, "location", W_MEASURES)
    return rounded(tr.multi_target(norm, "location", "timestamp", W_MEASURES, W_MEASURES,
                                   stats=ts.minmax_stats(clean, "location", W_MEASURES), stats_key="location"))


# =====================================================================
# Sources and sinks: write what Spark derived from the tables, read it back
# =====================================================================
from limnos.session import scratch_path  # noqa: E402
from limnos.sources import documents  # noqa: E402
from limnos.sources import files as io  # noqa: E402

W_CSV_SCHEMA = "timestamp string, location string, " + ", ".join(f"{m} double" for m in W_MEASURES)


@query("csv_roundtrip", f"""with {W_CLEAN_SQL}
select location, "timestamp", {W_OUT} from w_clean""")
def q_csv_roundtrip(spark, sf):
    """A06 write (CSV, header, time index first) -> A01/A02 read with a
    declared schema and the first column parsed as the time index."""
    path = scratch_path(spark, "w_clean_csv")
    clean = w_clean(spark, sf).select(F.col("timestamp").cast("string").alias("timestamp"), "location", *W_MEASURES)
    io.write_table(clean, path, fmt="csv")
    back = io.read_csv_indexed(spark, path, W_CSV_SCHEMA)
    return rounded(back.select("location", F.col("timestamp").cast("date").alias("timestamp"), *W_MEASURES))


@query("json_roundtrip", f"""with {METRICS_SQL}
select model, {S.r6('mse')}, {S.r6('sqrt(mse)', 'rmse')}, {S.r6('mae')},
  {S.r6('case when sst > 0 then 1 - sse / sst end', 'r2')}, (select model from m order by mse, model limit 1) as best_model from m""")
def q_json_roundtrip(spark, sf):
    """A09 write of the comparison document -> A05 multi-line JSON read ->
    G17 flatten (``models`` read back as a map of metric structs)."""
    path = scratch_path(spark, "comparison_json")
    io.write_json_doc(comparison_document(u_metrics(spark, sf)), path)
    schema = ("models map<string, struct<mse: double, rmse: double, mae: double, r2: double>>, "
              "best_model string")
    doc = io.read_json_docs(spark, path, schema, multiline=False)
    flat = doc.select("best_model", F.explode("models").alias("model", "m"))
    return rounded(flat.select("model", "m.mse", "m.rmse", "m.mae", "m.r2", "best_model"))


@query("tensor_roundtrip", f"""with {U_SAMPLES_SQL}
select location, "timestamp", split, round(cast(cast(y as float) as double), 6) as y,
  round(cast(cast(x_last as float) as double), 6) as x_last from us""")
def q_tensor_roundtrip(spark, sf):
    """Windows written as float32 tensors partitioned by split, read back."""
    path = scratch_path(spark, "u_samples")
    io.write_samples(u_samples(spark, sf), path)
    back = io.read_samples(spark, path)
    return rounded(back.select("location", "timestamp", "split", "y",
                               F.element_at(F.element_at("x", -1), 1).alias("x_last")))


@query("scaler_roundtrip", f"""with {W_CLEAN_SQL},
{S.minmax('w_clean', None, W_MEASURES, 'w_gnorm')}
select location, "timestamp", {W_OUT} from w_gnorm""")
def q_scaler_roundtrip(spark, sf):
    """Fit the scaler, persist its stats table, reload it and apply."""
    clean = w_clean(spark, sf)
    path = scratch_path(spark, "scaler")
    io.write_stats(ts.fit_minmax(clean, W_MEASURES), path)
    return rounded(ts.apply_minmax(clean, io.read_stats(spark, path), W_MEASURES))


@query("file_catalogue")
def q_file_catalogue(spark, sf):
    """Write the cleaned W table as CSV partitioned by location, then
    list every CSV below the root with directory, size and time."""
    root = scratch_path(spark, "catalogue")
    io.write_table(w_clean(spark, sf), root, fmt="csv", partition_by="location")
    cat = io.file_catalogue(spark, root)
    return cat.select(F.regexp_extract("dir", r"([^/]*)$", 1).alias("dir"), "file", "size_bytes", "size")


@query("trial_log")
def q_trial_log(spark, sf):
    """Trial logs written by a search over the W windows, read back as a
    table (one row per trial: values, score, status, error text)."""
    root = scratch_path(spark, "trials")
    tr.search(tr.training_table(w_samples(spark, sf)), families=("linear",), folder=root)
    read = documents.read_documents(spark, root, glob="part-*", per_line=True)
    steps = documents.best_steps(documents.observations(read)).where("metric = 'val_mse'").select("source", "best_value")
    back = documents.trials(read).join(steps, "source", "left")
    return back.select("trial_id", "status", "score", "best_step", F.to_json("values").alias("values"), "message", (F.col("best_value") == F.col("score")).alias("score_observed"))


# =====================================================================
# Streaming: daily means of the event feed (D01 as a stream)
# =====================================================================
from limnos.streaming import daily as sd  # noqa: E402


@query("stream_daily_means", """select cast(user_id as varchar) as location, cast(ts as date) as "timestamp",
  round(avg(value), 6) as value from events where ts is not null group by 1, 2""")
def q_stream_daily_means(spark, sf):
    """The events file read as a stream (two micro-batches at most one file
    each), per-user daily means kept in the state store and drained into a
    Parquet table; the current means are read back from it."""
    base = scratch_path(spark, "stream")
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    s = sd.daily_stream(spark, sf, schema, "user_id", "ts", ["value"], glob="events.parquet",
                        max_files_per_trigger=1)
    sd.run_to_table(s, base + "/table", base + "/checkpoint")
    return rounded(sd.current_means(spark, base + "/table", ["value"]))


# =====================================================================
# Stage 2: model table (fill, index, one-hot, global min-max) and samples
# =====================================================================
from limnos.plans.features import model_samples, model_table  # noqa: E402

MT_MEASURES = W_MEASURES + ["o_totalprice"]
MT_INTS = ["sequence_id", "window_size_recommended", "total_sequences", "numeric_columns_count"]
MT_ONEHOT = {"data_source": ["water_climate_combined", "water_only"],
             "processing_stage": ["cleaned", "normalized"], "data_type": ["cleaned", "normalized"],
             "scaling_method": ["MinMaxScaler_0_to_1"]}
MT_NUM = MT_MEASURES + MT_INTS + ["WQI"] + [f"{c}_{v}" for c, vs in MT_ONEHOT.items() for v in vs]


def _mt_sql(spec: str = 'partition by location, data_type order by "timestamp"', name: str = "mt") -> str:
    w = f"over ({spec} rows between unbounded preceding and current row)"
    wa = f"over ({spec} rows between unbounded preceding and unbounded following)"
    fill = ", ".join(f"coalesce(last_value({m} ignore nulls) {w}, first_value({m} ignore nulls) {wa}) as {m}"
                     for m in MT_MEASURES)
    idx = " + ".join(f"coalesce({m}, 0.0) * {wt}" for m, wt in W_WEIGHTS.items())
    nn = " and ".join(f"{c} is not null" for c in MT_MEASURES + MT_INTS + ["WQI"])
    oh = ", ".join(f"case when {c} = '{v}' then 1 else 0 end as {c}_{v}" for c, vs in MT_ONEHOT.items() for v in vs)
    scaled = ", ".join(
        f"round(case when max({c}) over () = min({c}) over () then 0.0 else "
        f"({c} - min({c}) over ()) / (max({c}) over () - min({c}) over ()) end, 6) as {c}" for c in MT_NUM)
    return f"""{PREPARED_SQL},
mt_fill as (select location, "timestamp", data_type, data_source, processing_stage, scaling_method, sliding_window_ready,
  {', '.join(MT_INTS)}, {fill} from pt),
mt_idx as (select *, {idx} as WQI from mt_fill),
mt_oh as (select *, {oh} from mt_idx where {nn}),
mt as (select location, "timestamp", data_type, sliding_window_ready, {scaled} from mt_oh)"""


MT_SQL = _mt_sql()
MT_ROW_ORDER_SQL = _mt_sql("order by sequence_id")


def q_model_table_df(spark, sf):
    table, _stats = model_table(prepared_table(spark, sf), W_WEIGHTS)
    return table


@query("model_table", f"with {MT_SQL} select * from mt")
def q_model_table(spark, sf):
    return rounded(q_model_table_df(spark, sf))


@query("model_table_row_order", f"with {MT_ROW_ORDER_SQL} select * from mt")
def q_model_table_row_order(spark, sf):
    """D05 literal: the fill runs over the whole prepared table in
    sequence_id order (two-phase, bucketed by sequence_id)."""
    table, _stats = model_table(prepared_table(spark, sf), W_WEIGHTS, fill_mode="row_order")
    return rounded(table)


@query("model_samples", f"""with {MT_SQL},
ms as (select location, data_type, "timestamp", WQI as y,
  lag(WQI, 12) over w as x_first, lag(WQI, 1) over w as x_last, row_number() over w - 1 as sample_pos
  from mt window w as (partition by location, data_type order by "timestamp"))
select location, data_type, "timestamp", sample_pos, {S.r6('y')}, {S.r6('x_first')}, {S.r6('x_last')},
  {len(MT_NUM)} as n_features,
  case when (('0x' || substr(md5('42|' || location || '|' || data_type || '|' || cast("timestamp" as varchar)), 1, 8))::bigint) % 100 < 20
  then 'test' else 'train' end as split
from ms where sample_pos >= 12""")
def q_model_samples(spark, sf):
    samples, feats = model_samples(q_model_table_df(spark, sf), "WQI")
    k = feats.index("WQI") + 1
    return rounded(samples.select(
        "location", "data_type", "timestamp", "sample_pos", "y",
        F.element_at(F.element_at("x", 1), k).alias("x_first"),
        F.element_at(F.element_at("x", -1), k).alias("x_last"),
        F.size(F.element_at("x", 1)).alias("n_features"), "split"))


@query("model_comparison")
def q_model_comparison(spark, sf):
    """Search every family, refit each with its best draw, score
    the test windows and name the winner (lowest MSE)."""
    from limnos.operators.common import attach_row
    metrics, _trials, _best = tr.tune_and_compare(tr.training_table(w_samples(spark, sf)))
    return rounded(attach_row(metrics, pf.pick_best(metrics, "mse").select("best_model")))


# queries of raw feeds, documents and forecasts register themselves
from limnos.plans import catalog_feeds, catalog_models  # noqa: E402, F401
