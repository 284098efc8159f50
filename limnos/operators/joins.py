"""Joins (E01-E07) and unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.functions.exprs import col_of
from limnos.operators.common import as_list, attach_row, stats_join
from limnos.operators.timeseries import number_rows_global

MATCH = "_matched"


def suffix_collisions(left: DataFrame, right: DataFrame, keys: list[str],
                      suffixes=("_water", "_climate")) -> tuple[DataFrame, DataFrame]:
    """Rename equal non-key names on both sides before a join."""
    both = (set(left.columns) & set(right.columns)) - set(keys)
    lmap = {c: c + suffixes[0] for c in both}
    rmap = {c: c + suffixes[1] for c in both}
    return left.withColumnsRenamed(lmap), right.withColumnsRenamed(rmap)


def left_join_tagged(left: DataFrame, right: DataFrame, keys: list[str],
                     suffixes=("_water", "_climate"), tag: str | None = "data_source",
                     labels=("water_climate_combined", "water_only")) -> DataFrame:
    """All left rows, right columns where the keys match
    (NULL elsewhere). ``tag`` labels each row from its own match flag, so a
    right side that is empty or out of range gives ``water_only`` rows.

    The planner chooses the strategy; AQE converts the join to a broadcast
    only when the materialised right side measures below the broadcast
    threshold.
    """
    left, right = suffix_collisions(left, right, keys, suffixes)
    right = right.withColumn(MATCH, F.lit(True))
    j = stats_join(left, right, keys)
    if tag:
        j = j.withColumn(tag, F.when(F.col(MATCH).isNotNull(), labels[0]).otherwise(labels[1]))
    return j.drop(MATCH)


def attach_means(left: DataFrame, right: DataFrame, measures: list[str], suffix: str = "_climate") -> DataFrame:
    """No common time key — attach the right side's column means as
    constant columns ``{col}{suffix}`` (a one-row aggregate, scalar subquery)."""
    means = right.agg(*[F.avg(col_of(m)).alias(m + suffix) for m in measures])
    return attach_row(left, means)


def zip_by_position(a: DataFrame, b: DataFrame, order_a: list[str], order_b: list[str],
                    part_a: str, part_b: str, out: str = "row_pos") -> DataFrame:
    """Glue two tables side by side by row position in their orders;
    the shorter side is padded with NULL (full outer join on the position).
    Positions come from the distributed dense numbering."""
    na = number_rows_global(a, part_a, order_a, out)
    nb = number_rows_global(b, part_b, order_b, out)
    return na.join(nb, [out], "full")


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """union matching columns by name; columns absent on one side are NULL."""
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames)


def union_variants(cleaned: DataFrame | None, normalized: DataFrame | None, tag: str = "data_type") -> DataFrame:
    """Cleaned ∪ normalised, each tagged; one side alone is tagged
    ``cleaned_only`` / ``normalized_only``."""
    if cleaned is not None and normalized is not None:
        return union_by_name([cleaned.withColumn(tag, F.lit("cleaned")),
                              normalized.withColumn(tag, F.lit("normalized"))])
    if cleaned is not None:
        return cleaned.withColumn(tag, F.lit("cleaned_only"))
    if normalized is not None:
        return normalized.withColumn(tag, F.lit("normalized_only"))
    raise ValueError("no data available for the final combination")


def distinct_sorted(df: DataFrame, cols) -> DataFrame:
    """duplicate removal + sort."""
    cs = as_list(cols)
    return df.select(*cs).distinct().orderBy(*cs)
