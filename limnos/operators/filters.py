"""Filters and predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.functions.exprs import col_of


def drop_null_time(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Drop rows whose time could not be parsed."""
    return df.where(col_of(ts).isNotNull())


def drop_null_location(df: DataFrame, key: str = "location") -> DataFrame:
    """Drop rows without a location."""
    return df.where(col_of(key).isNotNull())


def location_filter(df: DataFrame, locations, key: str = "location",
                    max_inline: int = 1000) -> DataFrame:
    """Keep the chosen locations. Short lists become an ``IN``
    predicate (pushed into the scan); a DataFrame of locations or a long
    list becomes a left-semi join. An empty choice gives an empty result."""
    if isinstance(locations, DataFrame):
        return df.join(locations.select(col_of(key).alias(key)).distinct(), [key], "left_semi")
    locs = list(locations)
    if len(locs) <= max_inline:
        return df.where(col_of(key).isin(locs)) if locs else df.limit(0)
    spark = df.sparkSession
    sel = spark.createDataFrame([(x,) for x in locs], [key])
    return df.join(sel, [key], "left_semi")


def drop_any_null(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Drop rows holding any null."""
    return df.na.drop("any", subset=subset)


def non_null_counts(df: DataFrame, cols: list[str] | None = None) -> dict[str, int]:
    """One aggregation pass: non-null count per column (a single small row)."""
    cols = cols or df.columns
    row = df.agg(*[F.count(col_of(c)).alias(c) for c in cols]).first()
    return {c: int(row[c]) for c in cols}


def drop_all_null_columns(df: DataFrame, keep: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Drop columns that hold no value at all (one ``agg`` pass decides
    the schema). Returns the frame and the dropped names."""
    keep = set(keep or [])
    counts = non_null_counts(df, [c for c in df.columns if c not in keep])
    dropped = [c for c, n in counts.items() if n == 0]
    return df.drop(*dropped), dropped


def nonzero_rows(df: DataFrame, col: str) -> DataFrame:
    """Keep profile rows with a positive count."""
    return df.where(col_of(col) > 0)


def keep_alive(cleaned: DataFrame, source: DataFrame, key: str, measures: list[str]) -> DataFrame:
    """Every location of ``source`` stays visible. Locations left with no
    value after cleaning yield one row holding only the location.

    Written as ``kept ∪ (locations ▷ kept locations)`` — an anti join of two
    distinct-location aggregates — so a hot location never passes through a
    join on its rows.
    """
    any_value = reduce(lambda a, b: a | b, [col_of(m).isNotNull() for m in measures])
    kept = cleaned.where(any_value)
    lost = (source.select(key).where(col_of(key).isNotNull()).distinct()
                  .join(kept.select(key).distinct(), [key], "left_anti"))
    return kept.unionByName(lost, allowMissingColumns=True)


def keep_alive_marked(df: DataFrame, key: str, keep_col: str, measures: list[str],
                      ts: str = "timestamp") -> DataFrame:
    """C08 on a frame whose rows carry a keep flag (e.g. the z-score flag):
    rows with the flag and a value are kept; a location with no such row
    yields one row holding only the location. Computed with window
    aggregates on the location's partition — no join, no second scan."""
    from pyspark.sql import Window
    any_value = reduce(lambda a, b: a | b, [col_of(m).isNotNull() for m in measures])
    ok = col_of(keep_col) & any_value
    w = Window.partitionBy(key)
    d = df.withColumns({"_ok": ok, "_alive": F.max(ok.cast("int")).over(w) == 1,
                        "_first": F.row_number().over(w.orderBy(ts)) == 1})
    out = d.where(F.col("_ok") | (~F.col("_alive") & F.col("_first")))
    blank = {c: F.when(F.col("_alive"), col_of(c)) for c in df.columns if c not in (key, keep_col)}
    return out.withColumns(blank).drop("_ok", "_alive", "_first", keep_col)


def key_list(df: DataFrame, key: str = "location") -> DataFrame:
    """Sorted distinct non-null locations."""
    return df.select(key).where(col_of(key).isNotNull()).distinct().orderBy(key)

