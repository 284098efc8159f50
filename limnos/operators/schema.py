"""Schema and projection operators."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.functions.constants import (FEATURE_SETS, LOCATION_CANDIDATES, TIME_CANDIDATES,
                                        WINDOW_SIZE_RECOMMENDED)
from limnos.functions.exprs import col_of, to_double
from limnos.operators.common import numeric_columns
from limnos.operators.dates import elected_time
from limnos.operators.timeseries import number_rows_global


def canonical_names(df: DataFrame, collapse_inner: bool = True) -> DataFrame:
    """Trim outer blanks of every column name; by default also collapse
    inner runs of blanks to one (so 'Nitrate-N/Nitrite-N  (mg/L)' matches
    its weight key)."""
    def fix(n: str) -> str:
        n = n.strip()
        return re.sub(r"\s+", " ", n) if collapse_inner else n
    return df.toDF(*[fix(c) for c in df.columns])


def detect_location(df: DataFrame, candidates=LOCATION_CANDIDATES) -> str | None:
    """The first candidate location column present, else None."""
    for c in candidates:
        if c in df.columns:
            return c
    return None


def canonical_location(df: DataFrame, out: str = "location") -> DataFrame:
    """Rename the detected location column to ``out``; when there is
    none the frame is a single dataset and ``out`` is NULL."""
    hit = detect_location(df)
    if hit is None:
        return df.withColumn(out, F.lit(None).cast("string"))
    return df.withColumnRenamed(hit, out) if hit != out else df


#: date texts tried in turn after ISO 8601; month before day where either could be meant
DATE_FORMATS = ("M/d/yyyy[ H:mm[:ss]]", "yyyy/M/d[ H:mm[:ss]]", "d-MMM-yyyy", "MMM d, yyyy", "MMMM d, yyyy", "yyyyMMdd")


def canonical_time(df: DataFrame, ts_col: str | None = None, out: str = "timestamp",
                   as_date: bool = False, formats=DATE_FORMATS, elect: bool = False) -> DataFrame:
    """Derive one time column. Priority: YEAR+MONTH (first of the
    month; out-of-range parts give NULL) -> Date -> date -> datetime -> time
    -> ``ts_col``. With ``elect`` the whole text column takes the one format
    that reads most of it (``dates.elected_time``); else each text is read as
    ISO 8601 or by the first of ``formats`` that fits. What can't be read
    becomes NULL; source columns are dropped."""
    cols = set(df.columns)
    if {"YEAR", "MONTH"} <= cols:
        y, m = to_double("YEAR").cast("int"), to_double("MONTH").cast("int")
        ok = y.isNotNull() & m.between(1, 12) & y.between(1, 9999)
        t = F.when(ok, F.make_date(y, m, F.lit(1)))
        res = df.withColumn(out, t if as_date else t.cast("timestamp_ntz")).drop("YEAR", "MONTH")
        return res
    src = next((c for c in TIME_CANDIDATES if c in cols), None) or ts_col
    if src is None:
        return df
    from pyspark.sql.types import DateType, TimestampNTZType, TimestampType
    dt = df.schema[src].dataType
    if isinstance(dt, (TimestampNTZType, TimestampType, DateType)):
        t = col_of(src).cast("timestamp_ntz")
    elif elect:
        df, t = elected_time(df, src, "__read"), F.col("__read")
    else:
        text = F.trim(col_of(src).cast("string"))
        t = F.coalesce(F.try_to_timestamp(text), *[F.try_to_timestamp(text, F.lit(f)) for f in formats])
        t = t.cast("timestamp_ntz")
    t = t.cast("date") if as_date else t
    res = df.withColumn("__t", t).drop("__read")
    if src != out:
        res = res.drop(src)
    return res.withColumnRenamed("__t", out)


def coerce_numeric(df: DataFrame, keys=("timestamp", "location")) -> DataFrame:
    """Every non-key column to DOUBLE; text that is not a number -> NULL."""
    ks = set(keys)
    return df.select(*[col_of(c) if c in ks else to_double(c).alias(c) for c in df.columns])


def select_numeric(df: DataFrame, keep=()) -> DataFrame:
    """The key columns in ``keep`` plus every numeric-typed column."""
    nums = numeric_columns(df, exclude=keep)
    return df.select(*[col_of(c) for c in keep], *[col_of(c) for c in nums])


def add_provenance(df: DataFrame, **consts) -> DataFrame:
    """Constant label columns (data_source, processing_stage, data_type)."""
    return df.withColumns({k: F.lit(v) for k, v in consts.items()})


def sequence_metadata(df: DataFrame, part: str = "location", order=("timestamp", "data_type"),
                      window_size: int = WINDOW_SIZE_RECOMMENDED) -> DataFrame:
    """Dense 0-based ``sequence_id`` over (part, *order), plus
    ``sliding_window_ready``, ``window_size_recommended`` and ``total_sequences``
    (the row count, attached from a one-row aggregate)."""
    numbered = number_rows_global(df, part, list(order), "sequence_id", total="total_sequences")
    return numbered.withColumns({"sliding_window_ready": F.lit(True),
                                 "window_size_recommended": F.lit(window_size)})


def scaling_metadata(df: DataFrame, method: str = "MinMaxScaler_0_to_1") -> DataFrame:
    """Number of numeric columns at this point (plan-time schema count,
    booleans excluded) and the scaling method label."""
    n = len(numeric_columns(df))
    return df.withColumns({"numeric_columns_count": F.lit(n), "scaling_method": F.lit(method)})


def backfill_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Add model columns that are absent, as 0.0."""
    return df.withColumns({c: F.lit(0.0) for c in columns if c not in df.columns})


def project_features(df: DataFrame, features, keep=()) -> DataFrame:
    """Keep columns + a named feature set (or an explicit list), in the
    set's order; names absent from the frame are skipped."""
    cols = FEATURE_SETS[features] if isinstance(features, str) else list(features)
    return df.select(*[col_of(c) for c in keep], *[col_of(c) for c in cols if c in df.columns])


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Renames."""
    return df.withColumnsRenamed(mapping)
