"""Cleaning a raw feed with an account of what became of it.

The raw table is read once: every row is written with its canonical values
or, when it has no time or no location, with the reason and its raw cells.
Totals are observed while that table is written; the report by location is
made of the written table.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from limnos.functions.exprs import col_of, to_double
from limnos.operators import schema as sc
from limnos.operators.common import q, stats_join
from limnos.plans.prepare import cleaning_report
from limnos.session import scratch_path

#: reasons in the order in which they are looked for
REASONS = ("time", "location")
_MARKS = ("_reason", "_raw", "_converted", "_refused", "_from_text", "_accepted")


@dataclass
class Cleaned:
    """``table``: accepted rows (location, timestamp, measures as DOUBLE).
    ``quarantine``: rejected rows (reason, location, raw: a JSON object of the
    row's cells). ``totals``: counts over the whole feed. ``staged``: both, as
    written. ``from_text``: measures that came as text."""

    table: DataFrame
    quarantine: DataFrame
    totals: dict[str, int]
    staged: DataFrame
    measures: list[str]
    located: bool


def clean_raw(raw: DataFrame, ts_col: str | None = None, sentinels: list[float] | None = None, as_date: bool = False,
              path: str | None = None) -> Cleaned:
    """Names trimmed (B01), location and time found (B02, B03: one date format
    for the whole column), all other columns read as DOUBLE (B04). A row
    without a time that can be read is rejected for ``time``, one of a located
    feed without a location for ``location`` (``time,location`` for both). A
    feed without a time column has no rows rejected for time. ``sentinels``
    (e.g. -999) become NULL. ``path``: where the written table goes (default:
    the checkpoint folder)."""
    df = sc.canonical_names(raw)
    located = sc.detect_location(df) is not None
    cells = F.to_json(F.struct(*[col_of(c) for c in df.columns]))
    df = sc.canonical_time(sc.canonical_location(df.withColumn("_raw", cells)), ts_col=ts_col, as_date=as_date, elect=True)
    keys = [c for c in ("location", "timestamp") if c in df.columns]
    measures = [c for c in df.columns if c not in (*keys, *_MARKS)]
    text = [c for c in measures if isinstance(df.schema[c].dataType, StringType)]
    filled = {c: F.trim(col_of(c)) != "" for c in text}  # a blank cell is missing, not refused
    reads = {c: to_double(c).isNotNull() for c in text}
    number = {c: to_double(c) for c in measures}
    if sentinels:
        number = {c: F.when(~x.isin([float(v) for v in sentinels]), x) for c, x in number.items()}
    no_time = F.col("timestamp").isNull() if "timestamp" in keys else F.lit(False)
    no_place = F.col("location").isNull() if located else F.lit(False)
    reason = F.concat_ws(",", F.when(no_time, REASONS[0]), F.when(no_place, REASONS[1]))
    zero = F.lit(0)
    staged = df.select(
        *[col_of(c) for c in keys], *[number[c].alias(c) for c in measures],
        F.when(reason != "", reason).alias("_reason"), F.when(reason != "", F.col("_raw")).alias("_raw"),
        reduce(add, [reads[c].cast("int") for c in text], zero).alias("_converted"),
        reduce(add, [(F.coalesce(filled[c], F.lit(False)) & ~reads[c]).cast("int") for c in text], zero).alias("_refused"),
        (reason == "").alias("_accepted"))
    seen = Observation("cleaning")
    accepted = F.col("_accepted")
    observed = staged.observe(
        seen, F.count(F.lit(1)).alias("rows"), F.count_if(accepted).alias("accepted"),
        F.count_if(F.col("_reason").startswith(REASONS[0])).alias("without_time"), F.count_if(F.col("_reason").endswith(REASONS[1])).alias("without_location"),
        F.coalesce(F.sum("_converted"), zero).alias("cells_converted"), F.coalesce(F.sum("_refused"), zero).alias("cells_refused"))
    path = path or scratch_path(raw.sparkSession, "staged")
    observed.write.mode("overwrite").partitionBy("_accepted").parquet(path)
    staged = raw.sparkSession.read.schema(observed.schema).parquet(path)
    return Cleaned(staged.where("_accepted").select(*[col_of(c) for c in (*keys, *measures)]),
                   staged.where("NOT _accepted").select(F.col("_reason").alias("reason"), "location", F.col("_raw").alias("raw")),
                   {k: int(v) for k, v in seen.get.items()}, staged, measures, located)


def full_report(cleaned: Cleaned, constant: str = "keep") -> DataFrame:
    """G21, one row per location (rows without one under NULL): rows, rejected,
    cells_converted (text that reads as a number), cells_refused (text that
    does not), dropped_columns (measures without any value there, by name),
    then gaps, filled, outliers_removed and rows_left of the daily table (0
    where no row was accepted)."""
    kept = F.col("_accepted")
    empty = F.array_compact(F.array(*[F.when(F.count(F.when(kept, col_of(c))) == 0, F.lit(c)) for c in sorted(cleaned.measures)]).cast("array<string>"))
    counts = cleaned.staged.groupBy("location").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(~kept).alias("rejected"), F.sum("_converted").cast("bigint").alias("cells_converted"),
        F.sum("_refused").cast("bigint").alias("cells_refused"), empty.alias("dropped_columns"))
    daily = cleaning_report(cleaned.table, "location", "timestamp", cleaned.measures, constant)
    late = ["gaps", "filled", "outliers_removed", "rows_left"]
    out = stats_join(counts, daily, ["location"])
    return out.select(*counts.columns, *[F.coalesce(q(c), F.lit(0)).cast("bigint").alias(c) for c in late])
