"""Stage 1 — clean, normalise, merge: one lazy plan per call.

raw located feed ──► daily grid ─► fill ─► outliers ─► (cleaned, min-max)
raw side feed    ──► daily grid ─► fill ─► outliers ─► (cleaned, min-max)
      cleaned ⟕ cleaned side, normalised ⟕ normalised side  (on day)
      ─► tag ─► union ─► sequence numbering ─► metadata
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.operators import filters as flt
from limnos.operators import joins as jn
from limnos.operators import schema as sc
from limnos.operators import timeseries as ts
from limnos.operators.common import materialize


def clean_series(df: DataFrame, key: str | None, ts_col: str, measures: list[str],
                 constant: str = "keep", keep_empty: bool = True) -> DataFrame:
    """Per key: daily grid (D01) -> ffill/bfill (D03) -> z-score filter (D06);
    keys left without values keep one row holding only the key (C08)."""
    g = ts.daily_resample(df, key, ts_col, measures)
    f = ts.ffill_bfill(g, key, "timestamp", measures)
    if key is not None and keep_empty:
        # every location that reached the grid stays visible (C01 runs first);
        # flag + window keep-alive share the key partitioning of the fill
        z = ts.zscore_mark(f, key, measures, constant=constant, out="_keep")
        return flt.keep_alive_marked(z, key, "_keep", measures)
    return ts.zscore_filter(f, key, measures, constant=constant)


def prepare(water: DataFrame, climate: DataFrame | None, key: str, ts_col: str,
            measures: list[str], climate_ts: str | None = None, climate_measures: list[str] | None = None,
            constant: str = "keep", keep_empty: bool = True) -> DataFrame:
    """The prepared table: cleaned and normalised variants of the located
    feed, each joined to the matching variant of the global side feed on the
    day, tagged, unioned, numbered and annotated."""
    # The cleaned daily tables feed several branches (normalised variant,
    # joins, union, numbering): each is materialised once into the
    # checkpoint folder, so the raw scans run once and lineage is cut.
    # The two are independent jobs and are submitted side by side.
    from concurrent.futures import ThreadPoolExecutor
    has_side = climate is not None and bool(climate_measures)
    with ThreadPoolExecutor(max_workers=2) as pool:
        fw = pool.submit(lambda: materialize(clean_series(water, key, ts_col, measures, constant, keep_empty),
                                             "cleaned"))
        fc = pool.submit(lambda: materialize(clean_series(climate, None, climate_ts or ts_col, climate_measures,
                                                          constant, keep_empty=False), "side_cleaned")) \
            if has_side else None
        wc = fw.result()
        cc = fc.result() if fc is not None else None
    wn = ts.minmax_per_key(wc, key, measures)
    if has_side:
        cn = ts.minmax_per_key(cc, None, climate_measures)
        cleaned = jn.left_join_tagged(wc, cc, ["timestamp"])
        normalized = jn.left_join_tagged(wn, cn, ["timestamp"])
    else:
        cleaned = wc.withColumn("data_source", F.lit("water_only"))
        normalized = wn.withColumn("data_source", F.lit("water_only"))
    cleaned = cleaned.withColumn("processing_stage", F.lit("cleaned"))
    normalized = normalized.withColumn("processing_stage", F.lit("normalized"))
    both = jn.union_variants(cleaned, normalized)
    seq = sc.sequence_metadata(both, key, ("timestamp", "data_type"))
    return sc.scaling_metadata(seq)


def cleaning_report(df: DataFrame, key: str, ts_col: str, measures: list[str],
                    constant: str = "keep") -> DataFrame:
    """Per key — null cells in the daily grid (D02), cells filled (D04),
    outlier rows removed (D06) and rows left. One aggregation pass over the
    grid with the fill and the outlier flag computed as window columns."""
    g = ts.daily_resample(df, key, ts_col, measures)
    f = ts.ffill_bfill(g, key, "timestamp", measures, suffix="_filled")
    filled_names = [m + "_filled" for m in measures]
    z = ts.zscore_mark(f, key, filled_names, constant=constant)
    gaps = sum((F.count(F.lit(1)) - F.count(F.col(m)) for m in measures), F.lit(0))
    fills = sum((F.count_if(F.col(m).isNull() & F.col(m + "_filled").isNotNull()) for m in measures), F.lit(0))
    return z.groupBy(key).agg(gaps.cast("bigint").alias("gaps"), fills.cast("bigint").alias("filled"),
                              F.count_if(~F.col("_keep")).cast("bigint").alias("outliers_removed"),
                              F.count_if(F.col("_keep")).cast("bigint").alias("rows_left"))


def canonicalise(raw: DataFrame, ts_col: str | None = None, sentinels: list[float] | None = None,
                 as_date: bool = False) -> DataFrame:
    """Raw feed -> canonical reading table: trimmed names (B01), ``location``
    (B02, NULL when the feed has none), ``timestamp`` (B03, one format for
    the whole column), rows without a
    time or (when located) a location dropped (C01, C02), every other column
    coerced to DOUBLE (B04). ``sentinels`` (e.g. [-999]) become NULL."""
    df = sc.canonical_names(raw)
    located = sc.detect_location(df) is not None
    df = sc.canonical_location(df)
    df = flt.drop_null_time(sc.canonical_time(df, ts_col=ts_col, as_date=as_date, elect=True))
    if located:
        df = flt.drop_null_location(df)
    df = sc.coerce_numeric(df, keys=("timestamp", "location"))
    if sentinels:
        vals = [float(v) for v in sentinels]
        df = df.withColumns({c: F.when(F.col(f"`{c}`").isin(vals), F.lit(None).cast("double"))
                             .otherwise(F.col(f"`{c}`")) for c in df.columns if c not in ("timestamp", "location")})
    return df
