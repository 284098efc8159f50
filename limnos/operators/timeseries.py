"""Time-series operators (D01-D14): daily grid, fill, outliers, scaling,
look-back windows, splits, calendars, shape fitting and period rollups.

Execution model
---------------
* Raw readings -> daily grid (D01) is a partial aggregate: a key holding a
  third of all raw rows is combined map-side before the shuffle.
* After D01 a series holds at most one row per calendar day, so per-key work
  that needs order (fill, statistics, numbering, look-back windows) runs as
  window functions partitioned by the key. They all share ONE
  ``hash(key)`` exchange, there are no self-joins (so the raw scan is never
  repeated), and a task's window buffer is bounded by the calendar span, not
  by data volume.
* Series without a key, or long raw series, use the two-phase bucketed forms
  (``bucket=`` / ``block=``): a tiny summary row per (series, bucket) carries
  state across bucket borders so no task ever holds a whole series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, TimestampNTZType, TimestampType

from limnos.functions.constants import LOOK_BACK, TEST_FRACTION, VALIDATION_FRACTION, Z_LIMIT
from limnos.functions.exprs import col_of, hash_percent, nan_to_null
from limnos.operators.common import as_list, attach_row, q, stats_join

DAY = "timestamp"


def _bucketed(df: DataFrame, order: str, out: str) -> DataFrame:
    """``df`` with bucket numbers or dates ``out`` that ascend with ``order``:
    months where it is a time, else ranges of its values, one per shuffle
    partition (written once, so that a row keeps its range)."""
    if isinstance(df.schema[order].dataType, (DateType, TimestampType, TimestampNTZType)):
        return df.withColumn(out, F.trunc(F.col(q(order)).cast("date"), "month"))
    from limnos.operators.common import materialize
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(df.repartitionByRange(parts, F.col(q(order))).withColumn(out, F.spark_partition_id()), "order_ranges")


# ---------------------------------------------------------------- D01 / D02
def daily_resample(df: DataFrame, key: str | None, ts: str, measures: list[str],
                   out: str = DAY) -> DataFrame:
    """One row per (key, calendar day) from the key's first to last day;
    each measure is the mean of that day's readings (NULL and NaN are none),
    empty day = NULL.

    Single pass: the day aggregate is partial (map-side combine); then each
    present day emits itself plus the empty days up to the key's next present
    day (``lead`` over the key's days + ``sequence``/``explode``). No calendar
    table is joined back, so the input is scanned once.
    """
    keys = as_list(key)
    day = F.to_date(col_of(ts)).alias(out)
    daily = (df.where(col_of(ts).isNotNull())
               .groupBy(*[col_of(k) for k in keys], day)
               .agg(*[F.avg(nan_to_null(col_of(m).cast("double"))).alias(m) for m in measures]))
    if not keys:
        # One global series: its day means (one row per day, bounded by the
        # calendar) are written once under the checkpoint folder, so the raw
        # table is scanned once however many passes follow (grid, two-phase
        # fill, statistics). The calendar comes from a one-row min/max.
        from limnos.operators.common import materialize
        daily = materialize(daily, "daily_global")
        span = daily.agg(F.min(out).alias("_lo"), F.max(out).alias("_hi"))
        grid = span.select(F.explode(F.sequence("_lo", "_hi", F.expr("interval 1 day"))).alias(out))
        return grid.join(daily, [out], "left")
    w = Window.partitionBy(*keys).orderBy(out)
    with_next = daily.withColumn("_next", F.lead(out).over(w))
    span = F.sequence(F.col(out), F.coalesce(F.date_sub("_next", 1), F.col(out)))
    expanded = with_next.select(*keys, F.col(out).alias("_d0"), *[col_of(m) for m in measures],
                                F.explode(span).alias(out))
    same = F.col(out) == F.col("_d0")
    return expanded.select(*keys, out, *[F.when(same, col_of(m)).alias(m) for m in measures])


def gap_count(grid: DataFrame, key: str | None, measures: list[str],
              out: str = "gaps") -> DataFrame:
    """Null cells per key in the resampled grid (missing days x columns
    plus missing values)."""
    keys = as_list(key)
    n = F.count(F.lit(1))
    expr = sum((n - F.count(col_of(m)) for m in measures), F.lit(0))
    return grid.groupBy(*keys).agg(expr.cast("bigint").alias(out))


# ---------------------------------------------------------------- D03 / D04
def ffill_bfill(df: DataFrame, key: str | None, order: str, measures: list[str],
                bucket: Column | None = None, suffix: str = "") -> DataFrame:
    """Forward fill then backward fill of each measure, per key, in
    ``order``. After a forward fill only leading nulls remain, so the
    backward fill is the first non-null value of the series:
    ``coalesce(last(x, ignorenulls) over running, first(x, ignorenulls) over
    whole series)`` — never a ``[current, unbounded following]`` frame
    (quadratic).

    Keyed series use one window per key. Without a key (one global series)
    or with ``bucket`` given, the two-phase bucketed form is used.
    """
    keys = as_list(key)
    if keys and bucket is None:
        spec = f"partition by {', '.join(q(k) for k in keys)} order by {q(order)}"
        return df.withColumns({
            m + suffix: F.expr(
                f"coalesce(last({q(m)}, true) over ({spec} rows between unbounded preceding and current row), "
                f"first({q(m)}, true) over ({spec} rows between unbounded preceding and unbounded following))")
            for m in measures})
    return _ffill_bfill_bucketed(df, keys, order, measures, bucket, suffix)


def _ffill_bfill_bucketed(df, keys, order, measures, bucket, suffix):
    """Two-phase fill: (1) per (key, bucket) last/first non-null value
    (partial aggregate); (2) a window over those few summary rows gives each
    bucket its carry-in and the series head; (3) a running fill inside each
    (key, bucket), falling back to carry-in, then head."""
    d = df.withColumn("_b", bucket) if bucket is not None else _bucketed(df, order, "_b")
    o = F.col(order)
    aggs = []
    for m in measures:
        c = col_of(m)
        aggs.append(F.max_by(c, F.when(c.isNotNull(), o)).alias(f"_last{m}"))
        aggs.append(F.min_by(c, F.when(c.isNotNull(), o)).alias(f"_first{m}"))
    summary = d.groupBy(*keys, "_b").agg(*aggs)
    carry = _keyed_carry(summary, keys, measures) if keys else _series_carry(summary, measures)
    joined = stats_join(d, carry, keys + ["_b"])
    run = Window.partitionBy(*keys, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    filled = {
        m + suffix: F.coalesce(F.last(col_of(m), True).over(run), F.col(f"`_in{m}`"), F.col(f"`_head{m}`"))
        for m in measures
    }
    res = joined.withColumns(filled)
    return res.drop("_b", *[f"_in{m}" for m in measures], *[f"_head{m}" for m in measures])


def _keyed_carry(summary: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Carry-in and head per (key, bucket). Up to ``SINGLE_TASK_PARTS``
    summary rows: a window per key. Beyond: the (key, bucket) rows are
    range-split; inside a range each key is carried locally, and a key that
    spans several ranges gets the carry of its earlier ranges from one row
    per (range, key)."""
    summary = summary.persist()
    n = summary.count()
    if n <= SINGLE_TASK_PARTS:
        w = Window.partitionBy(*keys).orderBy("_b")
        before = w.rowsBetween(Window.unboundedPreceding, -1)
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return summary.select(
            *keys, "_b",
            *[F.last(f"`_last{m}`", True).over(before).alias(f"_in{m}") for m in measures],
            *[F.first(f"`_first{m}`", True).over(whole).alias(f"_head{m}") for m in measures])
    from limnos.operators.common import materialize
    order = F.struct(*[F.col(q(k)) for k in keys], F.col("_b"))
    ranged = materialize(summary.withColumn("_kb", order)
                         .repartitionByRange(int(n // (SINGLE_TASK_PARTS // 4)) + 1, "_kb")
                         .withColumn("_pb", F.spark_partition_id()).drop("_kb"), "fill_key_ranges")
    local = Window.partitionBy("_pb", *keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per = ranged.groupBy("_pb", *keys).agg(
        *[F.max_by(f"`_last{m}`", F.when(F.col(f"`_last{m}`").isNotNull(), F.col("_b"))).alias(f"_rl{m}")
          for m in measures],
        *[F.min_by(f"`_first{m}`", F.when(F.col(f"`_first{m}`").isNotNull(), F.col("_b"))).alias(f"_rf{m}")
          for m in measures])
    kw = Window.partitionBy(*keys).orderBy("_pb")      # ranges spanned by one key: few rows
    per = per.select("_pb", *keys,
                     *[F.last(f"`_rl{m}`", True).over(kw.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_ri{m}")
                       for m in measures],
                     *[F.first(f"`_rf{m}`", True).over(kw.rowsBetween(Window.unboundedPreceding,
                                                                      Window.unboundedFollowing)).alias(f"_head{m}")
                       for m in measures])
    inner = ranged.select("_pb", *keys, "_b",
                          *[F.last(f"`_last{m}`", True).over(local).alias(f"_li{m}") for m in measures])
    out = stats_join(inner, per, ["_pb"] + keys, "inner")  # a NULL key is a series too
    return out.select(*keys, "_b", *[F.coalesce(f"`_li{m}`", f"`_ri{m}`").alias(f"_in{m}") for m in measures],
                      *[F.col(f"`_head{m}`") for m in measures])


def _series_carry(summary: DataFrame, measures: list[str]) -> DataFrame:
    """Carry-in and head per bucket of ONE series from its per-bucket
    last/first values. Up to ``SINGLE_TASK_PARTS`` buckets: one small window.
    Beyond: buckets are range-split (``repartitionByRange`` keeps their
    order), carried inside each range, and ranges carry into each other
    through one row per range."""
    summary = summary.persist()
    n = summary.count()
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    if n <= SINGLE_TASK_PARTS:
        return summary.select(
            "_b", *[F.last(f"`_last{m}`", True).over(before).alias(f"_in{m}") for m in measures],
            *[F.first(f"`_first{m}`", True).over(Window.partitionBy()).alias(f"_head{m}") for m in measures])
    from limnos.operators.common import attach_row, materialize
    ranged = materialize(summary.repartitionByRange(int(n // (SINGLE_TASK_PARTS // 4)) + 1, "_b")
                         .withColumn("_pb", F.spark_partition_id()), "fill_ranges")
    local = Window.partitionBy("_pb").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per_range = ranged.groupBy("_pb").agg(
        *[F.max_by(f"`_last{m}`", F.when(F.col(f"`_last{m}`").isNotNull(), F.col("_b"))).alias(f"_rl{m}")
          for m in measures],
        *[F.min_by(f"`_first{m}`", F.when(F.col(f"`_first{m}`").isNotNull(), F.col("_b"))).alias(f"_rf{m}")
          for m in measures])
    prev = Window.orderBy("_pb").rowsBetween(Window.unboundedPreceding, -1)
    range_in = per_range.select("_pb", *[F.last(f"`_rl{m}`", True).over(prev).alias(f"_ri{m}") for m in measures])
    heads = per_range.agg(*[F.min_by(f"`_rf{m}`", F.when(F.col(f"`_rf{m}`").isNotNull(), F.col("_pb")))
                            .alias(f"_head{m}") for m in measures])
    inner = ranged.select("_pb", "_b", *[F.last(f"`_last{m}`", True).over(local).alias(f"_li{m}") for m in measures])
    out = inner.join(F.broadcast(range_in), ["_pb"])  # one row per range
    out = out.select("_b", *[F.coalesce(f"`_li{m}`", f"`_ri{m}`").alias(f"_in{m}") for m in measures])
    return attach_row(out, heads)


def fill_count(before_after: DataFrame, key: str | None, pairs: list[tuple[str, str]],
               out: str = "filled") -> DataFrame:
    """Cells that were null before and are set after the fill, per key."""
    keys = as_list(key)
    expr = sum((F.count_if(col_of(b).isNull() & col_of(a).isNotNull()) for b, a in pairs), F.lit(0))
    return before_after.groupBy(*keys).agg(expr.cast("bigint").alias(out))


# ---------------------------------------------------------------- per-key statistics
def _with_stats(df: DataFrame, keys: list[str], aggs: dict[str, str], method: str) -> DataFrame:
    """Attach per-key aggregates to every row.

    ``method="window"`` (default for keyed series): whole-partition window
    aggregates on the key's partition — no join, no second scan.
    ``method="join"``: partial aggregate + join back (for raw, unbounded
    series where one key may hold a third of the rows).
    Without a key: a one-row aggregate (scalar subquery).
    ``aggs`` maps output names to SQL aggregate text (one JVM call each).
    """
    if keys and method == "window":
        part = ", ".join(q(k) for k in keys)
        return df.withColumns({n: F.expr(f"{a} over (partition by {part})") for n, a in aggs.items()})
    stats = (df.groupBy(*keys) if keys else df).agg(*[F.expr(a).alias(n) for n, a in aggs.items()])
    return stats_join(df, stats, keys)


# ---------------------------------------------------------------- D06
def zscore_mark(df: DataFrame, key: str | None, measures: list[str], limit: float = Z_LIMIT,
                constant: str = "keep", method: str = "window", out: str = "_keep") -> DataFrame:
    """D06 as a flag column ``out``: True when |z| < limit for every measure,
    z being the population z-score within its key. A measure that is NULL on
    the row (a column absent for that key) does not vote. A constant measure
    has no z-score: ``constant="keep"`` keeps those rows, ``"drop"`` drops
    them (the literal behaviour: NaN < 3 is false)."""
    keys = as_list(key)
    aggs = {}
    for m in measures:
        aggs[f"_mu{m}"] = f"avg({q(m)})"
        aggs[f"_sd{m}"] = f"stddev_pop({q(m)})"
    j = _with_stats(df, keys, aggs, method)
    const = "true" if constant == "keep" else "false"
    votes = [f"({q(m)} is null or case when {q('_sd' + m)} = 0 then {const} "
             f"else abs(({q(m)} - {q('_mu' + m)}) / {q('_sd' + m)}) < {float(limit)!r} end)" for m in measures]
    return j.withColumn(out, F.expr(f"coalesce({' and '.join(votes)}, false)")).drop(*aggs.keys())


def zscore_filter(df: DataFrame, key: str | None, measures: list[str],
                  limit: float = Z_LIMIT, constant: str = "keep", method: str = "window") -> DataFrame:
    """Keep only rows with |z| < limit in every measure (see zscore_mark)."""
    return zscore_mark(df, key, measures, limit, constant, method, "_keep").where("_keep").drop("_keep")


# ---------------------------------------------------------------- D07 / D08
def minmax_stats(df: DataFrame, key: str | None, measures: list[str]) -> DataFrame:
    keys = as_list(key)
    aggs = []
    for m in measures:
        aggs += [F.min(col_of(m)).cast("double").alias(f"_lo{m}"),
                 F.max(col_of(m)).cast("double").alias(f"_hi{m}")]
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def _scaled(x: Column, lo: Column, hi: Column) -> Column:
    # constant column -> 0 (sklearn behaviour; Spark ML's scaler gives 0.5)
    return F.when(hi == lo, F.when(x.isNotNull(), F.lit(0.0))).otherwise((x - lo) / (hi - lo))


def minmax_per_key(df: DataFrame, key: str | None, measures: list[str], suffix: str = "",
                   method: str = "window") -> DataFrame:
    """Min-max to [0, 1] within each key; constant column -> 0."""
    keys = as_list(key)
    aggs = {}
    for m in measures:
        aggs[f"_lo{m}"] = f"min(cast({q(m)} as double))"
        aggs[f"_hi{m}"] = f"max(cast({q(m)} as double))"
    j = _with_stats(df, keys, aggs, method)
    out = {}
    for m in measures:
        x, lo, hi = f"cast({q(m)} as double)", q("_lo" + m), q("_hi" + m)
        # constant column -> 0 (sklearn behaviour; Spark ML's scaler gives 0.5)
        out[m + suffix] = F.expr(f"case when {hi} = {lo} then (case when {x} is not null then 0.0D end) "
                                 f"else ({x} - {lo}) / ({hi} - {lo}) end")
    return j.withColumns(out).drop(*aggs.keys())


def fit_minmax(df: DataFrame, measures: list[str]) -> DataFrame:
    """D08 fit: the scaler as a stats table ``(column, lo, hi)`` — one
    aggregation pass, persisted with ``write`` for reuse (A08)."""
    wide = minmax_stats(df, None, measures)
    return wide.select(F.inline(F.array(*[F.struct(F.lit(m).alias("column"), F.col(q("_lo" + m)).alias("lo"), F.col(q("_hi" + m)).alias("hi")) for m in measures])))


def _stats_row(stats: DataFrame, measures: list[str]) -> DataFrame:
    """Pivot the (column, lo, hi) table to one row (bounded by the column count)."""
    aggs = []
    for m in measures:
        aggs += [F.max(F.when(F.col("column") == m, F.col("lo"))).alias(f"_lo{m}"),
                 F.max(F.when(F.col("column") == m, F.col("hi"))).alias(f"_hi{m}")]
    return stats.agg(*aggs)


def apply_minmax(df: DataFrame, stats: DataFrame, measures: list[str], suffix: str = "") -> DataFrame:
    """D08 apply: scale with a fitted stats table (one row per column, so the
    broadcast is bounded by the schema width)."""
    j = attach_row(df, _stats_row(stats, measures))
    out = {m + suffix: _scaled(col_of(m).cast("double"), F.col(q("_lo" + m)), F.col(q("_hi" + m)))
           for m in measures}
    return j.withColumns(out).drop(*[f"_lo{m}" for m in measures], *[f"_hi{m}" for m in measures])


def invert_minmax(df: DataFrame, stats: DataFrame, measures: list[str], suffix: str = "") -> DataFrame:
    """A08/D08 inverse: x * (hi - lo) + lo."""
    j = attach_row(df, _stats_row(stats, measures))
    out = {m + suffix: col_of(m) * (F.col(q("_hi" + m)) - F.col(q("_lo" + m))) + F.col(q("_lo" + m))
           for m in measures}
    return j.withColumns(out).drop(*[f"_lo{m}" for m in measures], *[f"_hi{m}" for m in measures])


# ---------------------------------------------------------------- numbering
def number_rows(df: DataFrame, key: str | None, order: list[str], out: str = "rn",
                bucket: Column | None = None) -> DataFrame:
    """0-based dense row number per key in ``order``. Keyed: one window per
    key. Without a key or with ``bucket``: two-phase — count per (key,
    bucket) -> prefix sum over the small summary -> row number inside the
    bucket + offset, so no task sees a whole series."""
    keys = as_list(key)
    if keys and bucket is None:
        return df.withColumn(out, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))
    d = df.withColumn("_nb", bucket) if bucket is not None else _bucketed(df, order[0], "_nb")
    counts = d.groupBy(*keys, "_nb").agg(F.count(F.lit(1)).alias("_n"))
    if keys:
        # offsets over (key, bucket) in order — range-split when there are very
        # many buckets, so a hot key's bucket summary is not one task — minus
        # each key's own starting offset
        kb = counts.withColumn("_kb", F.struct(*[F.col(q(k)) for k in keys], F.col("_nb")))
        glob = part_offsets(kb, "_kb", "_n")
        glob = glob.select(*[F.col("_kb").getField(k).alias(k) for k in keys],
                           F.col("_kb").getField("_nb").alias("_nb"), "_poff")
        start = glob.groupBy(*keys).agg(F.min("_poff").alias("_start"))
        offsets = (stats_join(glob, start, keys)
                       .select(*keys, "_nb", (F.col("_poff") - F.col("_start")).alias("_off")))
    else:  # one series: bucket offsets by the (range-split when large) prefix sum
        offsets = part_offsets(counts, "_nb", "_n").withColumnRenamed("_poff", "_off")
    inner = Window.partitionBy(*keys, "_nb").orderBy(*order)
    return (stats_join(d, offsets, keys + ["_nb"])
             .withColumn(out, F.col("_off") + F.row_number().over(inner) - 1)
             .drop("_nb", "_off"))


SINGLE_TASK_PARTS = 200_000  # parts whose offsets one task may prefix-sum


def part_offsets(sizes: DataFrame, part: str, n_col: str = "_pn", total: str | None = None) -> DataFrame:
    """Offset of each part (rows of all smaller parts) from a table of one
    row per part. The sizes table is computed once (persisted); up to
    ``SINGLE_TASK_PARTS`` parts the prefix sum is one small window. Beyond
    that the parts are range-partitioned (``repartitionByRange`` keeps their
    order across partition ids), each range is prefix-summed by its own task,
    and only one row per range goes through the small global window."""
    from limnos.operators.common import materialize
    # one row per part: kept in memory for the size check and the prefix
    # (a lost block is recomputed from lineage; nothing large is cached)
    sizes = sizes.select(part, n_col).persist()
    n_parts = sizes.count()
    if n_parts <= SINGLE_TASK_PARTS:
        w = Window.orderBy(part)
        cols = [part, F.coalesce(F.sum(n_col).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_poff")]
        if total:
            cols.append(F.sum(n_col).over(Window.partitionBy()).alias(total))
        return sizes.select(*cols)
    buckets = int(n_parts // (SINGLE_TASK_PARTS // 4)) + 1
    ranged = materialize(sizes.repartitionByRange(buckets, part).withColumn("_pb", F.spark_partition_id()),
                         "part_ranges")
    per_range = ranged.groupBy("_pb").agg(F.sum(n_col).alias("_bn"))
    wb = Window.orderBy("_pb")
    bcols = ["_pb", F.coalesce(F.sum("_bn").over(wb.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_boff")]
    if total:
        bcols.append(F.sum("_bn").over(Window.partitionBy()).alias(total))
    range_off = per_range.select(*bcols)           # one row per range: bounded, broadcast
    wi = Window.partitionBy("_pb").orderBy(part)
    inner = ranged.withColumn("_ioff", F.coalesce(F.sum(n_col).over(wi.rowsBetween(Window.unboundedPreceding, -1)),
                                                  F.lit(0)))
    out = inner.join(F.broadcast(range_off), ["_pb"])
    return out.select(part, (F.col("_boff") + F.col("_ioff")).alias("_poff"), *([total] if total else []))


def number_rows_global(df: DataFrame, part: str, order: list[str], out: str = "rn",
                       bucket: Column | None = None, total: str | None = None) -> DataFrame:
    """Dense 0-based row number over the whole table ordered by
    ``[part] + order`` (H02). Each row gets its number inside its part (a
    window per part) plus the part's offset (``part_offsets``: a prefix sum
    over one row per part, range-split when there are very many parts).
    ``total`` also attaches the table's row count from the same small table."""
    numbered = number_rows(df, part, order, "_local", bucket)
    sizes = df.groupBy(part).agg(F.count(F.lit(1)).alias("_pn"))
    poff = part_offsets(sizes, part, "_pn", total)
    return (stats_join(numbered, poff, [part])
            .withColumn(out, F.col("_poff") + F.col("_local"))
            .drop("_poff", "_local"))


# ---------------------------------------------------------------- D09
def sliding_windows(df: DataFrame, key: str | None, order: str, features: list[str],
                    target: str, look_back: int = LOOK_BACK, block: int | None = None) -> DataFrame:
    """For every row with at least ``look_back`` predecessors in its key,
    x = the previous ``look_back`` rows (all features, in order) and y = the
    row's target. Samples per key = max(0, n - look_back).

    Keyed (default): a ``rowsBetween(-look_back, -1)`` frame per key.
    Without a key or with ``block``: rows are numbered (two-phase), cut into
    blocks of ``block`` rows, and the last ``look_back`` rows of each block are
    copied into the next one, so every block holds the history its rows need
    and the frame is a bounded window per (key, block).
    """
    keys = as_list(key)
    step = F.array(*[col_of(f).cast("double") for f in features])
    if keys and block is None:
        w = Window.partitionBy(*keys).orderBy(order)
        return (df.withColumn("sample_pos", (F.row_number().over(w) - 1).cast("long"))
                  .withColumn("x", F.collect_list(step).over(w.rowsBetween(-look_back, -1)))
                  .where(F.col("sample_pos") >= look_back)
                  .withColumn("y", col_of(target).cast("double")))
    block = block or 4096
    numbered = number_rows(df, key, [order], "_rn")
    home = F.floor(F.col("_rn") / block)
    copies = F.when((F.col("_rn") % block) >= block - look_back,
                    F.array(home, home + 1)).otherwise(F.array(home))
    exploded = numbered.withColumn("_home", home).withColumn("_blk", F.explode(copies))
    w = Window.partitionBy(*keys, "_blk").orderBy("_rn").rowsBetween(-look_back, -1)
    return (exploded.withColumn("x", F.collect_list(step).over(w))
                    .where((F.col("_blk") == F.col("_home")) & (F.col("_rn") >= look_back))
                    .withColumn("y", col_of(target).cast("double"))
                    .withColumnRenamed("_rn", "sample_pos")
                    .drop("_home", "_blk"))


# ---------------------------------------------------------------- D10 / D11
def hash_split(df: DataFrame, key_cols: list[str], test_fraction: float = TEST_FRACTION,
               seed: int = 42, out: str = "split") -> DataFrame:
    """Deterministic train/test split from a hash of the key — the same
    row always lands in the same split, whatever the partitioning or retries."""
    key = F.concat_ws("|", *[col_of(c).cast("string") for c in key_cols])
    pct = hash_percent(key, seed)
    return df.withColumn(out, F.when(pct < int(round(test_fraction * 100)), "test").otherwise("train"))


def time_split(df: DataFrame, key: str | None, order: str, test_fraction: float = TEST_FRACTION,
               out: str = "split") -> DataFrame:
    """D10 ``mode="time"``: the last ``test_fraction`` of each key's rows are test."""
    keys = as_list(key)
    numbered = number_rows(df, key, [order], "_rn")
    j = _with_stats(numbered, keys, {"_n": "count(1)"}, "window")
    keep_pct = int(round((1 - test_fraction) * 100))  # exact integer threshold: ceil(n * keep_pct / 100)
    first_test = F.expr(f"(_n * {keep_pct} + 99) div 100")
    return (j.withColumn(out, F.when(F.col("_rn") >= first_test, "test")
                               .otherwise("train"))
             .drop("_rn", "_n"))


def validation_tail(df: DataFrame, part: str, order: list[str], fraction: float = VALIDATION_FRACTION,
                    out: str = "is_validation", each: bool = False) -> DataFrame:
    """The last ``fraction`` of the rows in stored order (``[part] +
    order``) are validation rows: percent_rank >= 1 - fraction, computed from
    a distributed dense row number and the total count. ``each``: the last
    ``fraction`` of every part, so that no part is only validated on."""
    if each:
        rank = F.percent_rank().over(Window.partitionBy(q(part)).orderBy(*[F.col(q(c)) for c in order]))
        return df.withColumn(out, rank >= F.lit(1 - fraction))
    j = number_rows_global(df, part, order, "_grn", total="_total")
    pr = F.when(F.col("_total") > 1, F.col("_grn") / (F.col("_total") - 1)).otherwise(F.lit(0.0))
    return j.withColumn(out, pr >= F.lit(1 - fraction)).drop("_grn", "_total")


# ---------------------------------------------------------------- D12 / D13 / D14
def month_end_dates(df: DataFrame, key: str | None, ts: str, n: int = 12, out: str = "forecast_date") -> DataFrame:
    """N month-end dates after each key's last timestamp."""
    keys = as_list(key)
    last = df.groupBy(*keys).agg(F.max(F.to_date(col_of(ts))).alias("_last"))
    return (last.select(*keys, "_last", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
                .select(*keys, "step", F.last_day(F.add_months("_last", F.col("step"))).alias(out)))


def fit_shape(arr: Column, steps: int, feats: int) -> Column:
    """Fit a 1-D feature array to (steps, feats): truncate or zero-pad the
    features, then repeat the row over all steps."""
    a = arr.cast("array<double>")
    padded = F.when(F.size(a) >= feats, F.slice(a, 1, feats)).otherwise(
        F.concat(a, F.array_repeat(F.lit(0.0), F.lit(feats) - F.size(a))))
    return F.array_repeat(padded, steps)


def fit_sequence(seq: Column, steps: int, feats: int) -> Column:
    """D13 for 3-D input (array of steps): pad by repeating the last step or
    truncate to ``steps``, then fit every step's features."""
    s = seq.cast("array<array<double>>")
    n = F.size(s)
    stepped = F.when(n >= steps, F.slice(s, 1, steps)).otherwise(
        F.concat(s, F.array_repeat(F.element_at(s, -1), F.lit(steps) - n)))

    def fit_row(r):
        return F.when(F.size(r) >= feats, F.slice(r, 1, feats)).otherwise(
            F.concat(r, F.array_repeat(F.lit(0.0), F.lit(feats) - F.size(r))))
    return F.transform(stepped, fit_row)


def period_rollup(df: DataFrame, key: str | None, ts: str, measures: list[str], unit: str,
                  out: str = "period") -> DataFrame:
    """Mean, min, max and count per key and week / month / year."""
    keys = as_list(key)
    per = F.date_trunc(unit, col_of(ts)).cast("date").alias(out)
    aggs = [F.count(F.lit(1)).alias("n")]
    for m in measures:
        c = col_of(m)
        aggs += [F.avg(c).alias(f"avg_{m}"), F.min(c).alias(f"min_{m}"), F.max(c).alias(f"max_{m}")]
    return df.groupBy(*keys, per).agg(*aggs)
