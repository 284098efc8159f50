"""Exact quantiles (linear interpolation between order statistics).

A mergeable sketch per key (one pass, partial aggregate) gives each wanted
quantile a bracket: two values between which it must lie. A second pass counts
the values outside all brackets, one row per key, and keeps those inside,
equal ones counted together. Only these, about a hundredth of the rows, are
range-sorted by key and value; each range sums its own counts, and the ranges'
totals, one row per key and range, turn them into ranks over the whole key. No
group's values meet in one task. Keys with no more rows than the sketch has
steps are kept whole. The counts tell whether every bracket holds its ranks:
should one ever miss them, all values are ranked instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from limnos.operators.common import as_list, materialize, q, stats_join

#: steps of the sketch: its ranks are off by a step at most
ACCURACY = 2000
#: steps a bracket reaches to either side
_REACH = 4


def _brackets(points: DataFrame, named: list[Column], probs: list[float], whole: bool) -> DataFrame:
    """Per key: n, _min, _max and the bracket (_lo{i}, _hi{i}) of each quantile
    that is neither the least nor the greatest value."""
    ends = [e for p in probs for e in (p - _REACH / ACCURACY, p + _REACH / ACCURACY)]
    aggs = [F.count(F.lit(1)).alias("n"), F.min("_x").alias("_min"), F.max("_x").alias("_max")]
    if not whole:
        aggs.append(F.percentile_approx("_x", [min(max(e, 0.0), 1.0) for e in ends], ACCURACY).alias("_e"))
    per_key = points.groupBy(*named).agg(*aggs)
    bounds = []
    for i in range(len(probs)):
        for name, end, at in ((f"_lo{i}", "_min", 2 * i), (f"_hi{i}", "_max", 2 * i + 1)):
            outer = whole or not 0 < ends[at] < 1
            bounds.append((F.col(end) if outer else F.when(F.col("n") <= ACCURACY, F.col(end)).otherwise(F.col("_e")[at])).alias(name))
    return materialize(per_key.select(*named, "n", "_min", "_max", *bounds), "brackets")


def _low(p: float) -> Column:
    return F.floor(F.lit(p) * (F.col("n") - 1))


def _counted(points: DataFrame, brackets: DataFrame, keys: list[str], probs: list[float]) -> DataFrame | None:
    """(keys, _v, _c, _range, ...): values inside brackets and how often they
    occur, range-sorted by key and value and written once; a NULL _v stands for
    all rows outside. None if a bracket misses the ranks around its quantile."""
    named = [F.col(q(k)) for k in keys]
    at = range(len(probs))
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    inside = F.lit(False)
    for i in at:
        inside = inside | _within("_x", i)
    counts = (stats_join(points, brackets, keys, "inner").groupBy(*named, F.when(inside, F.col("_x")).alias("_v"))
              .agg(F.count(F.lit(1)).alias("_c"), *[F.count_if(F.col("_x") < F.col(f"_lo{i}")).alias(f"_below{i}") for i in at],
                   *[F.count_if(F.col("_x") <= F.col(f"_hi{i}")).alias(f"_upto{i}") for i in at]))
    ranged = materialize(counts.repartitionByRange(parts, *named, "_v").withColumn("_range", F.spark_partition_id()), "value_counts")
    per_key = ranged.groupBy(*named).agg(F.sum("_c").alias("n"), *[F.sum(f"{c}{i}").alias(f"{c}{i}") for i in at for c in ("_below", "_upto")])
    missed = F.lit(False)
    for i, p in enumerate(probs):
        missed = missed | (F.col(f"_below{i}") > _low(p)) | (F.col(f"_upto{i}") <= F.least(_low(p) + 1, F.col("n") - 1))
    return ranged if per_key.where(missed).isEmpty() else None


def _within(x: str, i: int) -> Column:
    return (F.col(x) >= F.col(f"_lo{i}")) & (F.col(x) <= F.col(f"_hi{i}"))


def _ranked(ranged: DataFrame, brackets: DataFrame, keys: list[str], probs: list[float]) -> DataFrame:
    """Per key: n, _min, _max and, of each quantile i, the values of the two
    ranks around it (_a{i}, _b{i})."""
    named = [F.col(q(k)) for k in keys]
    at = range(len(probs))
    values = ranged.where(F.col("_v").isNotNull())
    totals = values.groupBy(*named, "_range").agg(F.sum("_c").alias("_t"))
    earlier = Window.partitionBy(*named).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*named, "_range", F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_off"))
    before = Window.partitionBy(*named, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    placed = stats_join(values.select(*named, "_range", "_v", "_c", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_in")),
                        offsets, [*keys, "_range"], "inner")
    outside = ranged.where(F.col("_v").isNull()).select(*named, *[F.col(f"_below{i}") for i in at])
    known = stats_join(brackets, outside, keys)
    both = stats_join(placed, known, keys, "inner")

    def value_at(rank: Column, i: int) -> Column:
        first = F.col("_off") + F.col("_in") + F.coalesce(F.col(f"_below{i}"), F.lit(0))
        return F.max(F.when(_within("_v", i) & (first <= rank) & (rank < first + F.col("_c")), F.col("_v")))
    stats = []
    for i, p in enumerate(probs):
        stats += [value_at(_low(p), i).alias(f"_a{i}"), value_at(F.least(_low(p) + 1, F.col("n") - 1), i).alias(f"_b{i}")]
    return both.groupBy(*named, "n", "_min", "_max").agg(*stats)


def exact_quantiles(df: DataFrame, keys, value: str, probs: list[float], out: str = "q") -> DataFrame:
    """Per group of ``keys`` (one at least): array ``out`` of exact quantiles of
    ``value`` (NULLs ignored) at ``probs``, interpolated as DuckDB
    ``quantile_cont`` and pandas ``quantile`` do. Also returns ``n``. A NULL key
    is a group; NaN is the greatest value."""
    keys = as_list(keys)
    named = [F.col(q(k)) for k in keys]
    points = df.select(*named, F.col(q(value)).cast("double").alias("_x")).where(F.col("_x").isNotNull())
    inner = sorted({p for p in probs if 0 < p < 1})
    got = _brackets(points, named, inner, False)
    if inner:
        ranged = _counted(points, got, keys, inner)
        if ranged is None:
            got = _brackets(points, named, inner, True)
            ranged = _counted(points, got, keys, inner)
        got = _ranked(ranged, got, keys, inner)
    qs = []
    for p in probs:
        if p in inner:
            a, b, place = F.col(f"_a{inner.index(p)}"), F.col(f"_b{inner.index(p)}"), F.lit(p) * (F.col("n") - 1)
            # equal neighbours need no interpolation (infinite ones allow none)
            qs.append(F.when(a == b, a).otherwise(a + (place - F.floor(place)) * (b - a)))
        else:
            qs.append(F.col("_min" if p <= 0 else "_max"))
    return got.select(*named, "n", F.array(*qs).alias(out))
