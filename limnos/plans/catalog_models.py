"""Queries of forecasts over a horizon and of early stopping."""

from __future__ import annotations

from pyspark.sql import functions as F

from limnos.operators import filters as flt
from limnos.operators import forecast as fc
from limnos.operators import timeseries as ts
from limnos.plans import horizon as hz
from limnos.plans import sqlparts as S
from limnos.plans.catalog import U_CLEAN_SQL, query, rounded, user_daily_clean, w_clean
from limnos.sources.tables import W_MEASURES, table

DAYS = 7


@query("forecast_horizon_day", f"""with recursive {U_CLEAN_SQL},
st as (select min(value) as lo, max(value) as hi from uc_clean),
sc as (select location, "timestamp", case when hi = lo then 0.0 else (value - lo) / (hi - lo) end as v from uc_clean, st where value is not null),
pairs as (select location, "timestamp", v as y, lag(v) over (partition by location order by "timestamp") as x from sc),
fit as (select location, case when var_pop(x) > 0 then regr_slope(y, x) end as b, case when var_pop(x) > 0 then regr_intercept(y, x) end as a from pairs where x is not null group by location),
last as (select location, max("timestamp") as d, arg_max(v, "timestamp") as v from sc group by location),
roll as (select location, 0 as step, d, v from last
  union all select r.location, r.step + 1, r.d, case when f.b is null then r.v else f.a + f.b * r.v end from roll r left join fit f using (location) where r.step < {DAYS})
select location, step, cast(d + to_days(step) as date) as forecast_date, {S.r6('v * (hi - lo) + lo', 'value')} from roll, st where step > 0""")
def q_forecast_horizon_day(spark, sf):
    """Per user the least-squares line of a day on the day before,
    fed back for a week; in the measure's units."""
    clean = flt.drop_any_null(user_daily_clean(spark, sf).select("location", "timestamp", "value"))
    stats = ts.fit_minmax(clean, ["value"])
    scaled = ts.apply_minmax(clean, stats, ["value"])
    out = hz.forecast_least_squares(scaled, "location", "timestamp", "value", DAYS)
    return rounded(hz.unscaled(out, stats, None, ["value"]))


@query("forecast_horizon_month")
def q_forecast_horizon_month(spark, sf):
    """All W measures per location at the twelve month ends after
    its last day, by linear models over 12-row windows of all measures; in the
    measures' units."""
    clean = w_clean(spark, sf)
    norm = ts.minmax_per_key(clean, "location", W_MEASURES)
    out = hz.forecast(norm, "location", "timestamp", W_MEASURES, W_MEASURES, horizon=12, unit="month",
                      stats=ts.minmax_stats(clean, "location", W_MEASURES), stats_key="location")
    return rounded(out)


@query("early_stopping", f"""with e as (select user_id, date_diff('day', date '2024-01-01', ts::date) as step, avg(value) as v from events group by 1, 2),
n as (select *, row_number() over (partition by user_id order by step) - 1 as i from e),
m as (select *, arg_min(i, struct_pack(v := v, i := i)) over (partition by user_id order by i rows between unbounded preceding and current row) as top from n),
stop as (select user_id, coalesce(min(i) filter (where i - top >= {fc.PATIENCE}), max(i)) as until from m group by user_id)
select cast(m.user_id as varchar) as location, arg_min(m.step, struct_pack(v := m.v, i := m.i))::bigint as best_step, round(min(m.v), 6) as best_value, count(*) as steps_run
from m join stop on m.user_id = stop.user_id and m.i <= stop.until group by m.user_id""")
def q_early_stopping(spark, sf):
    """Where a run over each user's daily means, taken as validation
    scores, ends with patience 10, and the step it keeps."""
    e = table(spark, sf, "events")
    days = e.groupBy(F.col("user_id").cast("string").alias("location"), F.datediff("ts", F.lit("2024-01-01").cast("date")).alias("step")).agg(F.avg("value").alias("v"))
    return rounded(fc.stopping_points(days, ["location"], "step", "v"))
