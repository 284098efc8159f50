"""Index, classification and value formatting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.functions.constants import FALLBACK_INDEX, WQI_ADVICE, WQI_WEIGHTS
from limnos.functions.exprs import classify, clamp, col_of, format_2dp, weighted_sum
from limnos.operators.common import attach_row, materialize
from limnos.operators.timeseries import number_rows_global


def weighted_index(df: DataFrame, weights: dict[str, float] | None = None, out: str = "WQI",
                   renormalise: bool = False) -> DataFrame:
    """Σ weight·column over the weighted columns that exist (NULL term
    = 0). Weights are not re-normalised for absent columns unless asked."""
    weights = dict(weights or WQI_WEIGHTS)
    present = [c for c in weights if c in df.columns]
    expr = weighted_sum(weights, present)
    if renormalise and present:
        expr = expr / F.lit(sum(weights[c] for c in present))
    return df.withColumn(out, expr)


def index_class(df: DataFrame, col: str = "WQI", out: str = "wqi_class", advice: str | None = "advice") -> DataFrame:
    """Class by the fixed limits (NULL -> last class), plus advice text
    from a fixed four-entry lookup (a literal map, no join)."""
    res = df.withColumn(out, classify(col))
    if advice:
        m = F.create_map(*[x for k, v in WQI_ADVICE.items() for x in (F.lit(k), F.lit(v))])
        res = res.withColumn(advice, m[F.col(out)])
    return res


def clamp_col(df: DataFrame, col: str, lo: float = 0.0, hi: float = 100.0, out: str | None = None) -> DataFrame:
    """Clamp to [lo, hi]."""
    return df.withColumn(out or col, clamp(col, lo, hi))


def format_col(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Null-safe two-decimal text ('N/A' for NULL)."""
    return df.withColumn(out or col, format_2dp(col))


def round_upper(df: DataFrame, numeric: list[str], label: str, digits: int = 6) -> DataFrame:
    """Round numeric columns, upper-case the label."""
    return df.withColumns({**{c: F.round(col_of(c), digits) for c in numeric}, label: F.upper(col_of(label))})


def one_hot(df: DataFrame, col: str, max_values: int = 1000, values: list[str] | None = None,
            drop_source: bool = True) -> DataFrame:
    """One 0/1 INT column ``{col}_{value}`` per distinct value (sorted).
    The distinct values are a bounded, checked list (at most ``max_values``;
    more raises instead of building an unbounded schema: see
    ``one_hot_sparse``)."""
    if values is None:
        vals = (df.select(col_of(col)).where(col_of(col).isNotNull()).distinct()
                  .limit(max_values + 1).collect())
        if len(vals) > max_values:
            raise ValueError(f"{col}: more than {max_values} distinct values")
        values = sorted(str(r[0]) for r in vals)
    res = df.withColumns({f"{col}_{v}": F.when(col_of(col) == v, 1).otherwise(0) for v in values})
    return res.drop(col) if drop_source else res


def one_hot_many(df: DataFrame, cols: list[str], max_values: int = 1000, keep: tuple = ()) -> DataFrame:
    """B13 for several label columns: the distinct (column, value) pairs of
    all of them come from ONE bounded distinct pass (at most ``max_values``
    per column, checked); sources are dropped except those in ``keep``."""
    if not cols:
        return df
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), col_of(c).cast("string").alias("v")) for c in cols]))
    found = (df.select(pairs.alias("p")).select("p.c", "p.v").where(F.col("v").isNotNull()).distinct()
               .limit(max_values * len(cols) + 1).collect())
    by_col: dict[str, list[str]] = {c: [] for c in cols}
    for r in found:
        by_col[r["c"]].append(r["v"])
    res = df
    for c in cols:
        if len(by_col[c]) > max_values:
            raise ValueError(f"{c}: more than {max_values} distinct values")
        res = one_hot(res, c, values=sorted(by_col[c]), drop_source=c not in keep)
    return res


def label_codes(df: DataFrame, cols: list[str]) -> DataFrame:
    """B13 without a bound: (column, value, code), a dense code from 0 for every
    distinct value of every column, by column in the order given, then value.
    The dictionary is a table: it is numbered by ranges and never collected."""
    pairs = F.inline(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(c).alias("column"), col_of(c).cast("string").alias("value")) for i, c in enumerate(cols)]))
    found = df.select(pairs).where(F.col("value").isNotNull()).distinct()
    return materialize(number_rows_global(found, "place", ["value"], "code").select("column", "value", "code"), "codes")


def one_hot_sparse(df: DataFrame, cols: list[str], out: str = "one_hot", codes: DataFrame | None = None) -> DataFrame:
    """B13 for any number of labels: ``out`` is a sparse 0/1 vector as a struct
    (size, indices ascending, values); a NULL or unknown value sets nothing.
    ``codes``: a dictionary of ``label_codes`` made before, e.g. of the
    training rows. Sources are dropped."""
    codes = label_codes(df, cols) if codes is None else codes
    coded = df
    for i, c in enumerate(cols):
        own = codes.where(F.col("column") == c).select(F.col("value").alias(f"_v{i}"), F.col("code").alias(f"_c{i}"))
        coded = coded.join(own, col_of(c).cast("string") == F.col(f"_v{i}"), "left").drop(f"_v{i}")
    hits = F.array_sort(F.array_compact(F.array(*[F.col(f"_c{i}") for i in range(len(cols))])))
    sized = attach_row(coded, codes.agg(F.count(F.lit(1)).alias("_size")))
    made = F.struct(F.col("_size").alias("size"), hits.alias("indices"), F.array_repeat(F.lit(1.0), F.size(hits)).alias("values"))
    return sized.withColumn(out, made).drop("_size", *[f"_c{i}" for i in range(len(cols))], *cols)


def mean_impute(df: DataFrame, cols: list[str]) -> DataFrame:
    """Fill NULLs with the column mean over the (already filtered) rows;
    the means are a one-row aggregate attached as a scalar subquery."""
    means = df.agg(*[F.avg(col_of(c)).alias(f"_m{i}") for i, c in enumerate(cols)])
    j = attach_row(df, means)
    return j.withColumns({c: F.coalesce(col_of(c), F.col(f"_m{i}")) for i, c in enumerate(cols)}) \
            .drop(*[f"_m{i}" for i in range(len(cols))])


def mean_prediction(pred: DataFrame, model: str = "model", prediction: str = "prediction",
                    out: str = "mean_prediction", fallback: float = FALLBACK_INDEX) -> DataFrame:
    """Mean prediction per model, clamped to [0, 100]; a model with no
    prediction gets the fallback value."""
    m = pred.groupBy(model).agg(F.avg(col_of(prediction)).alias("_m"))
    return m.select(model, clamp(F.coalesce(F.col("_m"), F.lit(fallback))).alias(out))
