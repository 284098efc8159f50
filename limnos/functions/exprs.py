"""Column expressions shared by the operators. All are native Spark
expressions (no Python UDFs), so they stay inside whole-stage codegen."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from limnos.functions.constants import WQI_CLASS_ELSE, WQI_CLASS_LIMITS

__all__ = [
    "col_of", "to_double", "nan_to_null", "weighted_sum", "classify",
    "clamp", "format_2dp", "hash_percent", "r6",
]


def col_of(c: str | Column) -> Column:
    return F.col("`" + c.replace("`", "``") + "`") if isinstance(c, str) else c


def to_double(c: str | Column) -> Column:
    """Numeric coercion: text that is not a number, and NaN, become NULL
    (never raises)."""
    return nan_to_null(col_of(c).try_cast("double"))


def nan_to_null(c: str | Column) -> Column:
    """NaN -> NULL so aggregates and comparisons follow SQL null rules."""
    x = col_of(c)
    return F.when(F.isnan(x), F.lit(None).cast("double")).otherwise(x)


def weighted_sum(weights: dict[str, float], present: list[str]) -> Column:
    """Σ w·c over the weighted columns present; a NULL term counts as 0 and the
    weights are not re-normalised when a column is absent."""
    terms = [F.coalesce(col_of(c).cast("double"), F.lit(0.0)) * F.lit(float(w))
             for c, w in weights.items() if c in present]
    return reduce(add, terms) if terms else F.lit(0.0)


def classify(x: str | Column) -> Column:
    """Index class by upper bounds; NULL falls through to the last class."""
    v = col_of(x)
    out = None
    for bound, label in WQI_CLASS_LIMITS:
        out = (F.when(v < bound, label) if out is None else out.when(v < bound, label))
    return out.otherwise(WQI_CLASS_ELSE)


def clamp(x: str | Column, lo: float = 0.0, hi: float = 100.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), col_of(x)))


def format_2dp(x: str | Column) -> Column:
    """Two-decimal text, 'N/A' for NULL (format_string alone would print 'null')."""
    v = col_of(x)
    return F.when(v.isNull(), F.lit("N/A")).otherwise(F.format_string("%.2f", F.round(v, 2)))


def hash_percent(key: Column, seed: int = 42) -> Column:
    """Stable 0..99 bucket of a key: first 32 bits of md5(seed|key).
    Independent of partitioning and task retries (unlike rand())."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") % 100


def r6(c: str | Column) -> Column:
    return F.round(col_of(c).cast("double"), 6)
