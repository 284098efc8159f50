"""Queries over raw feeds and JSON documents that Spark derives from the test
tables: elected date formats, cleaning with its report and quarantine,
comparison and trial documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from limnos.operators.common import attach_row
from limnos.operators.dates import date_report
from limnos.operators.schema import canonical_time
from limnos.plans import sqlparts as S
from limnos.operators import index as ix
from limnos.operators import positions as pos
from limnos.operators import profile as pf
from limnos.operators import timeseries as ts
from limnos.plans.catalog import METRICS_SQL, U_SAMPLES_SQL, query, rounded, u_metrics, u_samples
from limnos.plans.cleaning import clean_raw, full_report
from limnos.session import scratch_path
from limnos.sources import documents as docs
from limnos.sources.tables import table


# ---------------------------------------------------------------- B03: dates
def order_date_texts(spark, sf):
    """Order dates as feeds write them: day first, dotted, dashed, named, ISO,
    month first in two digits; and a column that mixes two ways and has texts
    that are no dates."""
    d, k = F.col("o_orderdate"), F.col("o_orderkey")
    mixed = F.when(k % 97 == 0, "soon").when(k % 10 == 0, F.date_format(d, "MM/dd/yyyy")).otherwise(F.date_format(d, "d/M/yyyy"))
    return table(spark, sf, "orders").select(
        F.date_format(d, "dd/MM/yyyy").alias("day_first"), F.date_format(d, "dd.MM.yyyy").alias("dotted"), F.date_format(d, "MM-dd-yyyy").alias("dashed"),
        F.date_format(d, "d MMM yyyy").alias("named"), d.cast("string").alias("iso"), F.date_format(d, "MM/dd/yy").alias("short"), mixed.alias("mixed"))


_MIXED = "case when o_orderkey % 97 = 0 then 'soon' when o_orderkey % 10 = 0 then strftime(o_orderdate, '%m/%d/%Y') else strftime(o_orderdate, '%-d/%-m/%Y') end"


@query("date_election", f"""with m as (select {_MIXED} as t from orders),
named(col, fmt) as (values ('day_first', 'd/M/yyyy[ H:mm[:ss]]'), ('dotted', 'd.M.yyyy[ H:mm[:ss]]'), ('dashed', 'M-d-yyyy[ H:mm[:ss]]'),
  ('named', 'd MMM yyyy[ H:mm[:ss]]'), ('iso', 'iso'), ('short', 'M/d/yy'))
select col as "column", fmt as format, (select count(distinct o_orderdate) from orders) as n_texts, (select count(*) from orders) as n_rows,
  (select count(distinct o_orderdate) from orders) as parsed_texts, (select count(*) from orders) as parsed_rows, cast(0 as bigint) as rejected_rows, false as mixed from named
union all select 'mixed', 'd/M/yyyy[ H:mm[:ss]]', count(distinct t), count(*), count(distinct t) filter (where try_strptime(t, '%d/%m/%Y') is not null),
  count(try_strptime(t, '%d/%m/%Y')), count(*) - count(try_strptime(t, '%d/%m/%Y')), true from m""")
def q_date_election(spark, sf):
    """The format that each column elects, and what it rejects."""
    texts = order_date_texts(spark, sf)
    return date_report(texts, texts.columns).withColumns({c: F.col(c).cast("bigint") for c in ("n_texts", "n_rows", "parsed_texts", "parsed_rows", "rejected_rows")})


@query("date_elected_days", f"""with m as (select try_strptime({_MIXED}, '%d/%m/%Y') as t from orders)
select cast(t as date) as "timestamp", count(*) as n from m group by 1""")
def q_date_elected_days(spark, sf):
    """B03 + C01: orders per day as the mixed column's one format reads them;
    rejected texts are counted under NULL."""
    read = canonical_time(order_date_texts(spark, sf).select(F.col("mixed").alias("Date")), as_date=True, elect=True)
    return read.groupBy("timestamp").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- C01 / G21
def event_cells(spark, sf):
    """The event feed as a raw text file would bring it: padded names, day
    before month, cells that are no numbers, rows without time or place, a
    measure that one place never reports."""
    e, i = table(spark, sf, "events"), F.col("event_id")
    return e.select(
        F.when(i % 101 != 0, F.col("event_type")).alias(" Site "),
        F.when(i % 97 == 0, "soon").otherwise(F.date_format("ts", "dd/MM/yyyy HH:mm")).alias("Date "),
        F.when(i % 89 == 0, "n/a").when(i % 83 != 0, F.col("value").cast("string")).alias("  reading"),
        F.when(F.col("event_type") != "signup", F.get_json_object("props", "$.k")).alias("k "), (i % 7).alias("step"))


_CELLS = """cells as (select case when event_id % 101 <> 0 then event_type end as location, case when event_id % 97 <> 0 then ts end as t,
  case when event_id % 89 = 0 or event_id % 83 = 0 then null else value end as reading, event_id % 89 = 0 as refused,
  case when event_type <> 'signup' then try_cast(props->>'$.k' as double) end as k, (event_id % 7)::double as step from events),
good as (select * from cells where location is not null and t is not null)"""
_DAILY = S.daily("good", "location", "t", {"reading": "reading", "k": "k", "step": "step"}, "g")


@query("cleaning_full_report", f"""with {_CELLS}, {_DAILY},
{S.fill('g', 'location', ['reading', 'k', 'step'], 'f', keep_raw=True)},
z as (select *, {' and '.join(f"coalesce(abs(({m} - avg({m}) over (partition by location)) / nullif(stddev_pop({m}) over (partition by location), 0)) < 3, true)" for m in ('reading', 'k', 'step'))} as keep from f),
late as (select location, sum((reading_raw is null)::int + (k_raw is null)::int + (step_raw is null)::int) as gaps,
  sum((reading_raw is null and reading is not null)::int + (k_raw is null and k is not null)::int + (step_raw is null and step is not null)::int) as filled,
  count(*) filter (where not keep) as outliers_removed, count(*) filter (where keep) as rows_left from z group by location),
early as (select location, count(*) as "rows", count(*) filter (where location is null or t is null) as rejected,
  count(reading) + count(k) as cells_converted, count(*) filter (where refused) as cells_refused,
  case when count(k) filter (where location is not null and t is not null) = 0 then 'k' else '' end
    || case when count(reading) filter (where location is not null and t is not null) = 0 then ',reading,step' else '' end as dropped_columns
  from cells group by location)
select early.*, cast(coalesce(gaps, 0) as bigint) as gaps, cast(coalesce(filled, 0) as bigint) as filled,
  cast(coalesce(outliers_removed, 0) as bigint) as outliers_removed, cast(coalesce(rows_left, 0) as bigint) as rows_left
from early left join late on early.location is not distinct from late.location""")
def q_cleaning_full_report(spark, sf):
    """The whole account of the raw event feed by location, NULL
    included; the raw table is read once."""
    report = full_report(clean_raw(event_cells(spark, sf)))
    return report.withColumn("dropped_columns", F.array_join("dropped_columns", ","))


@query("quarantine", f"""with {_CELLS}
select concat_ws(',', case when t is null then 'time' end, case when location is null then 'location' end) as reason, location, count(*) as n,
  count(*) filter (where t is null) as n_soon from cells where t is null or location is null group by 1, 2""")
def q_quarantine(spark, sf):
    """Rejected rows by reason and location; their raw cells are kept."""
    bad = clean_raw(event_cells(spark, sf)).quarantine
    return bad.groupBy("reason", "location").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.get_json_object("raw", "$.Date") == "soon").alias("n_soon"))


# ---------------------------------------------------------------- A05 / A09 / G17
@query("comparison_variant", f"""with {METRICS_SQL},
long as (unpivot (select model, mse, sqrt(mse) as rmse, mae, case when sst > 0 then 1 - sse / sst end as r2 from m) on mse, rmse, mae, r2 into name name value number)
select model, 'metrics' as section, name, round(number, 6) as number, (select model from m order by mse, model limit 1) as best_model from long
union all select model, 'settings', 'batch_size', 32.0, (select model from m order by mse, model limit 1) from m
union all select model, 'hyperparameters', 'look_back', 12.0, (select model from m order by mse, model limit 1) from m""")
def q_comparison_variant(spark, sf):
    """A09 -> A05 -> G17: the comparison document written, read as VARIANT
    without a schema, and every member of every model flattened."""
    metrics = F.map_from_arrays(F.array(*[F.lit(c) for c in ("mse", "rmse", "mae", "r2")]), F.array("mse", "rmse", "mae", "r2"))
    results = u_metrics(spark, sf).select("model", F.create_map(F.lit("look_back"), F.lit(12)).alias("hyperparameters"), F.lit(32).alias("batch_size"), metrics.alias("metrics"))
    root = scratch_path(spark, "documents")
    docs.write_model_documents(results, root)
    read = docs.read_documents(spark, f"{root}/model_comparison", per_line=True)
    flat = docs.flatten_comparison(read).where(F.col("number").isNotNull())
    return rounded(flat.join(docs.best_model(read), "source").select("model", "section", "name", "number", "best_model"))


# ---------------------------------------------------------------- A11
def trial_documents(spark, sf):
    """A trial document per event type: its daily means are what the trial
    observed, a day a step; types without readings failed."""
    e = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").try_cast("double"))
    step = F.datediff("ts", F.lit("2024-01-01").cast("date")).cast("bigint")
    days = e.groupBy("event_type", step.alias("step")).agg(F.avg("value").alias("val_loss"), F.avg("k").alias("score"))
    seen = {m: F.sort_array(F.collect_list(F.struct("step", F.array(m).alias("value")))) for m in ("val_loss", "score")}
    metrics = F.struct(*[F.struct(F.lit("min" if m == "val_loss" else "max").alias("direction"), seen[m].alias("observations")).alias(m) for m in seen])
    return days.groupBy("event_type").agg(metrics.alias("m"), F.min("val_loss").alias("best"), F.min_by("step", F.struct("val_loss", "step")).alias("at")).select(
        F.to_json(F.struct(F.col("event_type").alias("trial_id"), F.lit("COMPLETED").alias("status"), F.col("best").alias("score"), F.col("at").alias("best_step"),
                           F.struct(F.struct(F.lit(64).alias("units")).alias("values")).alias("hyperparameters"), F.struct(F.col("m").alias("metrics")).alias("metrics"))).alias("json"))


@query("trial_observations", """with e as (select event_type as trial_id, date_diff('day', date '2024-01-01', ts::date) as step, value, try_cast(props->>'$.k' as double) as k from events),
days as (select trial_id, step, avg(value) as val_loss, avg(k) as score from e group by 1, 2),
long as (select trial_id, 'val_loss' as metric, 'min' as direction, step, val_loss as value from days
  union all select trial_id, 'score', 'max', step, score from days)
select trial_id, 'COMPLETED' as status, metric, direction, count(*) as n_steps, round(max(value), 6) as greatest,
  (case direction when 'min' then arg_min(step, struct_pack(v := value, s := step)) else arg_min(step, struct_pack(v := -value, s := step)) end)::bigint as best_step,
  round(case direction when 'min' then min(value) else max(value) end, 6) as best_value
from long group by trial_id, metric, direction""")
def q_trial_observations(spark, sf):
    """Trial documents written and read again; every observation of every
    metric, and the best step in the metric's direction."""
    root = scratch_path(spark, "trials")
    trial_documents(spark, sf).write.text(root)
    read = docs.read_documents(spark, root, per_line=True)
    # a file may hold several trials, so a trial's id goes with its source
    seen = docs.observations(read).withColumn("source", F.concat_ws("#", "source", "trial_id"))
    most = seen.groupBy("source", "metric").agg(F.max("value").alias("greatest"))
    status = docs.trials(read).select("trial_id", "status")
    out = docs.best_steps(seen).join(most, ["source", "metric"]).join(status, "trial_id")
    return rounded(out.select("trial_id", "status", "metric", "direction", "n_steps", "greatest", "best_step", "best_value"))


# ---------------------------------------------------------------- D11 by location, G09 with a NULL location, unkeyed numbering
@query("box_stats_null_key", """with v as (select case when event_type <> 'click' then event_type end as location, value from events where value is not null),
s as (select location, min(value) as min, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.5) as median, quantile_cont(value, 0.75) as q3, max(value) as max from v group by 1),
f as (select *, q1 - 1.5 * (q3 - q1) as lower_fence, q3 + 1.5 * (q3 - q1) as upper_fence from s)
select location, """ + ", ".join(f"round(any_value(f.{c}), 6) as {c}" for c in ("min", "q1", "median", "q3", "max", "lower_fence", "upper_fence")) + """,
  count(*) filter (where v.value < f.lower_fence or v.value > f.upper_fence) as outliers
from f join v using (location) where location is not null group by location
union all select null, """ + ", ".join(f"round(any_value(f.{c}), 6)" for c in ("min", "q1", "median", "q3", "max", "lower_fence", "upper_fence")) + """,
  count(*) filter (where v.value < f.lower_fence or v.value > f.upper_fence) from f, v where f.location is null and v.location is null""")
def q_box_stats_null_key(spark, sf):
    """Rows without a location are a group with outliers of its own."""
    e = table(spark, sf, "events").select(F.when(F.col("event_type") != "click", F.col("event_type")).alias("location"), "value")
    return rounded(pf.box_stats(e, "location", "value"))


@query("validation_tail_per_location", f"""with {U_SAMPLES_SQL}
select location, "timestamp", percent_rank() over (partition by location order by "timestamp") >= 0.8 as is_validation
from us where split = 'train'""")
def q_validation_tail_per_location(spark, sf):
    """D11 as the training job takes it: the last fifth of every location."""
    train = u_samples(spark, sf).where(F.col("split") == "train").select("location", "timestamp")
    return ts.validation_tail(train, "location", ["timestamp"], each=True)


@query("unkeyed_windows", """with e as (select event_id, value, row_number() over (order by event_id) - 1 as sample_pos,
  sum(value) over (order by event_id rows between 12 preceding and 1 preceding) as x_sum, lag(value, 1) over (order by event_id) as x_last from events)
select event_id, sample_pos, round(value, 6) as y, round(x_sum, 6) as x_sum, round(x_last, 6) as x_last from e where sample_pos >= 12""")
def q_unkeyed_windows(spark, sf):
    """D09 over one series without a key, in the order of a number."""
    e = table(spark, sf, "events").select("event_id", "value")
    w = ts.sliding_windows(e, None, "event_id", ["value"], "value", 12)
    return rounded(w.select("event_id", "sample_pos", "y", F.aggregate("x", F.lit(0.0), lambda a, s: a + s[0]).alias("x_sum"), F.element_at("x", -1)[0].alias("x_last")))


# ---------------------------------------------------------------- D10 exact, B13 without bound, H05 by directory, E05 by stored row
@query("train_test_split_exact", f"""with {U_SAMPLES_SQL},
h as (select location, "timestamp", ('0x' || substr(md5('42|' || location || '|' || cast("timestamp" as varchar)), 1, 15))::bigint as h from us),
r as (select *, row_number() over (order by h, location, "timestamp") as rn, count(*) over () as n from h)
select location, "timestamp", case when rn <= ceil(n * 0.2) then 'test' else 'train' end as split from r""")
def q_train_test_split_exact(spark, sf):
    """A shuffled split with exactly ceil(0.2 n) test rows."""
    return pos.exact_split(u_samples(spark, sf).select("location", "timestamp"), ["location", "timestamp"])


@query("one_hot_sparse", """with v as (select distinct 0 as place, event_type as value from events union select distinct 1, cast(user_id as varchar) from events where user_id % 9 <> 0),
c as (select *, row_number() over (order by place, value) - 1 as code from v)
select event_id, (select count(*) from c) as size, a.code as first_code, b.code as second_code, (a.code is not null)::int + (b.code is not null)::int as ones
from events left join c a on a.place = 0 and a.value = event_type left join c b on b.place = 1 and b.value = cast(user_id as varchar) and user_id % 9 <> 0""")
def q_one_hot_sparse(spark, sf):
    """Event types and users as one sparse vector; no list of labels is
    collected."""
    e = table(spark, sf, "events").select("event_id", "event_type", F.when(F.col("user_id") % 9 != 0, F.col("user_id")).alias("user_id"))
    x = F.col("one_hot")
    return ix.one_hot_sparse(e, ["event_type", "user_id"]).select(
        "event_id", x["size"].alias("size"), F.try_element_at(x["indices"], F.lit(1)).alias("first_code"), F.try_element_at(x["indices"], F.lit(2)).alias("second_code"),
        F.aggregate(x["values"], F.lit(0.0), lambda a, v: a + v).cast("int").alias("ones"))


@query("page_by_directory", """with e as (select event_id, ts, event_type as location, round(value, 6) as value, row_number() over (order by event_id) - 1 as rn, count(*) over () as n from events)
select event_id, ts, location, value, 4 as page, cast(ceil(n / 25.0) as bigint) as n_pages from e where rn between 75 and 99""")
def q_page_by_directory(spark, sf):
    """The fourth page of 25, read as a range of keys."""
    e = table(spark, sf, "events").select("event_id", "ts", F.col("event_type").alias("location"), "value")
    directory = pos.page_directory(e, "event_id", 25)
    page = pos.read_page(e, directory, "event_id", 4)
    return rounded(attach_row(page.withColumn("page", F.lit(4)), directory.agg(F.max("n_pages").alias("n_pages"))))


@query("zip_stored_rows", """with c as (select c_custkey, row_number() over (order by c_custkey) - 1 as row_pos from customer),
s as (select s_suppkey, row_number() over (order by s_suppkey) - 1 as row_pos from supplier)
select row_pos, c_custkey, s_suppkey from c full join s using (row_pos)""")
def q_zip_stored_rows(spark, sf):
    """Customers and suppliers side by side as they are stored (their
    files are in key order)."""
    return pos.zip_stored(table(spark, sf, "customer").select("c_custkey", "_metadata"), table(spark, sf, "supplier").select("s_suppkey", "_metadata")).select("row_pos", "c_custkey", "s_suppkey")
