"""Aggregations and profiles.

All profiles are one or two aggregation passes with partial (map-side)
aggregation; wide results are unpivoted with ``stack`` so the output is
long form (one row per column / pair / bin).
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnos.functions.constants import HIST_BINS, TOP_PAIRS
from limnos.functions.exprs import col_of
from limnos.operators.common import as_list, attach_row, q, stats_join


def _stack(wide: DataFrame, keys: list[str], groups: list[tuple[str, list[str]]], names: list[str]) -> DataFrame:
    """Unpivot ``wide`` (one row per key) to one row per group: label + values."""
    rows = [F.struct(F.lit(label).alias(names[0]), *[F.col(q(c)).alias(n) for c, n in zip(cols, names[1:], strict=True)])
            for label, cols in groups]
    return wide.select(*[F.col(q(k)) for k in keys], F.inline(F.array(*rows)))


def location_counts(df: DataFrame, key: str = "location", out: str = "records") -> DataFrame:
    """Records per location, most first."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(out)).orderBy(F.desc(out), key)


def avg_records_per_location(df: DataFrame, key: str = "location") -> DataFrame:
    """Rows, distinct locations (nulls excluded), rows per location."""
    return df.agg(F.count(F.lit(1)).alias("n_records"),
                  F.count_distinct(col_of(key)).alias("n_locations")) \
             .withColumn("avg_records", F.col("n_records") / F.col("n_locations"))


def null_profile(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Non-null and null count per column, long form, in one pass."""
    cols = cols or df.columns
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(cols):
        aggs.append(F.count(col_of(c)).alias(f"_c{i}"))
    wide = df.agg(*aggs)
    long = _stack(wide, ["_n"], [(c, [f"_c{i}"]) for i, c in enumerate(cols)], ["column", "non_null"])
    return long.select("column", F.col("non_null").cast("bigint").alias("non_null"),
                       (F.col("_n") - F.col("non_null")).cast("bigint").alias("nulls"))


def missing_profile(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Column, missing count, missing percent (2 places), only > 0."""
    p = null_profile(df, cols)
    return (p.where(F.col("nulls") > 0)
             .select("column", F.col("nulls").alias("missing_count"),
                     F.round(F.col("nulls") * 100.0 / (F.col("nulls") + F.col("non_null")), 2).alias("missing_pct")))


def describe(df: DataFrame, cols: list[str], exact: bool = True, accuracy: int = 10000) -> DataFrame:
    """Count, mean, sample std, min, 25/50/75 % (linear interpolation)
    and max per column, long form.

    Moments come from one aggregation pass over the wide table. Quartiles:
    ``exact=True`` runs the bounded exact selection of
    ``limnos.operators.quantiles`` over the stacked (column, value) table;
    ``exact=False`` uses ``percentile_approx`` (one pass, bounded sketch).
    """
    from limnos.operators.quantiles import exact_quantiles
    aggs = []
    for i, c in enumerate(cols):
        x = col_of(c).cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"mean{i}"), F.stddev_samp(x).alias(f"std{i}"),
                 F.min(x).alias(f"min{i}"), F.max(x).alias(f"max{i}")]
        if not exact:
            aggs.append(F.percentile_approx(x, [0.25, 0.5, 0.75], accuracy).alias(f"q{i}"))
    wide = df.agg(*aggs)
    names = ["n", "mean", "std", "min", "max"] + ([] if exact else ["q"])
    moments = _stack(wide, [], [(c, [f"{nm}{i}" for nm in names]) for i, c in enumerate(cols)],
                     ["column", "count", "mean", "std", "min", "max"] + ([] if exact else ["q"]))
    if exact:
        long = _stack(df.select(*[col_of(c).cast("double").alias(f"v{i}") for i, c in enumerate(cols)]), [],
                      [(c, [f"v{i}"]) for i, c in enumerate(cols)], ["column", "x"])
        qs = exact_quantiles(long, ["column"], "x", [0.25, 0.5, 0.75]).drop("n")
        moments = moments.join(qs, ["column"], "left")
    return moments.select("column", F.col("count").cast("bigint").alias("count"), "mean", "std", "min",
                          F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"), "max")


def box_stats(df: DataFrame, key: str, col: str, exact: bool = True, accuracy: int = 10000) -> DataFrame:
    """Five-number summary per location (exact, bounded memory; or
    approximate), 1.5·IQR fences and the count of points outside them (a
    further scan of key and value against the fences, one row a location).
    Rows without a location are a group."""
    from limnos.operators.common import materialize
    from limnos.operators.quantiles import exact_quantiles
    x = col_of(col).cast("double")
    points = df.select(key, x.alias("_x")).where(F.col("_x").isNotNull())
    if exact:
        # one row a location; read twice, so written once
        q = materialize(exact_quantiles(df, [key], col, [0.0, 0.25, 0.5, 0.75, 1.0]).drop("n"), "box")
    else:
        q = df.groupBy(key).agg(F.array(F.min(x), *[F.percentile_approx(x, p, accuracy) for p in (0.25, 0.5, 0.75)],
                                        F.max(x)).alias("q"))
    st = q.select(key, F.col("q")[0].alias("min"), F.col("q")[1].alias("q1"), F.col("q")[2].alias("median"),
                  F.col("q")[3].alias("q3"), F.col("q")[4].alias("max"))
    st = st.withColumns({"lower_fence": F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")),
                         "upper_fence": F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))})
    outside = (F.col("_x") < F.col("lower_fence")) | (F.col("_x") > F.col("upper_fence"))
    out = (stats_join(points, st.select(key, "lower_fence", "upper_fence"), [key], "inner")
             .groupBy(key).agg(F.count_if(outside).alias("outliers")))
    return stats_join(st, out, [key]).withColumn("outliers", F.coalesce("outliers", F.lit(0)).cast("bigint"))


def histogram(df: DataFrame, col: str, bins: int = HIST_BINS) -> DataFrame:
    """Equal-width histogram over [min, max]; the max falls in the last
    bin. Output: bin (0-based), lower/upper edge, count."""
    x = col_of(col).cast("double")
    rng = df.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    j = attach_row(df.select(x.alias("_x")).where(F.col("_x").isNotNull()), rng)
    width = (F.col("_hi") - F.col("_lo")) / bins
    b = F.when(F.col("_hi") == F.col("_lo"), F.lit(0)).otherwise(
        F.least(F.floor((F.col("_x") - F.col("_lo")) / width), F.lit(bins - 1)))
    return (j.groupBy(b.cast("int").alias("bin"), "_lo", "_hi").agg(F.count(F.lit(1)).alias("count"))
             .select("bin", (F.col("_lo") + F.col("bin") * width).alias("lower"),
                     (F.col("_lo") + (F.col("bin") + 1) * width).alias("upper"), "count"))


def corr_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson r for every column pair over the rows where both are set
    (pairwise-complete); a constant column gives NULL (never a division
    error). Long form (col_a, col_b, r), full matrix incl. the diagonal.

    Two passes of plain sums (fast, codegen'd; no per-row divisions):
      1. one-row aggregate: count, mean, min, max per column;
      2. sums of mean-shifted values and their products (the shifted-data
         formulas, numerically stable). Null-free input needs only the
         Gram sums; with nulls each pair gets its own pairwise-complete sums.
    The k² expressions are built as SQL text (one JVM call each).
    """
    k = len(cols)
    x = [f"cast({q(c)} as double)" for c in cols]
    r1 = df.selectExpr(*[f"{x[i]} as c{i}" for i in range(k)]).agg(
        F.expr("count(1)").alias("n"),
        *[F.expr(f"count(c{i})").alias(f"n{i}") for i in range(k)],
        *[F.expr(f"avg(c{i})").alias(f"m{i}") for i in range(k)],
        *[F.expr(f"min(c{i}) = max(c{i})").alias(f"k{i}") for i in range(k)]).first()
    mean = [r1[f"m{i}"] if r1[f"m{i}"] is not None else 0.0 for i in range(k)]
    const = [r1[f"k{i}"] is None or bool(r1[f"k{i}"]) for i in range(k)]
    null_free = all(r1[f"n{i}"] == r1["n"] for i in range(k))
    d = [f"(c{i} - {mean[i]!r})" for i in range(k)]
    pairs = list(combinations(range(k), 2))
    if null_free:
        aggs = ([f"sum({d[i]}) as s{i}" for i in range(k)] + [f"sum({d[i]} * {d[i]}) as q{i}" for i in range(k)]
                + [f"sum({d[i]} * {d[j]}) as p{i}_{j}" for i, j in pairs])
    else:
        aggs = []
        for i, j in pairs:
            both = f"(c{i} is not null and c{j} is not null)"
            aggs += [f"count_if({both}) as n{i}_{j}", f"sum(if({both}, {d[i]}, null)) as sa{i}_{j}",
                     f"sum(if({both}, {d[j]}, null)) as sb{i}_{j}", f"sum(if({both}, {d[i]} * {d[i]}, null)) as qa{i}_{j}",
                     f"sum(if({both}, {d[j]} * {d[j]}, null)) as qb{i}_{j}", f"sum({d[i]} * {d[j]}) as p{i}_{j}"]
    sums = df.selectExpr(*[f"{x[i]} as c{i}" for i in range(k)]).agg(*[F.expr(a.rsplit(" as ", 1)[0]).alias(a.rsplit(" as ", 1)[1]) for a in aggs])

    def r_sql(i, j):
        if const[i] or const[j]:
            return "cast(null as double)"
        if null_free:
            n, sa, sb, qa, qb = f"{float(r1['n'])!r}", f"s{i}", f"s{j}", f"q{i}", f"q{j}"
        else:
            n, sa, sb, qa, qb = f"cast(n{i}_{j} as double)", f"sa{i}_{j}", f"sb{i}_{j}", f"qa{i}_{j}", f"qb{i}_{j}"
        cov, va, vb = f"(p{i}_{j} - {sa} * {sb} / {n})", f"({qa} - {sa} * {sa} / {n})", f"({qb} - {sb} * {sb} / {n})"
        return f"case when {n} > 0 and {va} > 0 and {vb} > 0 then {cov} / sqrt({va} * {vb}) end"

    def lit(v: str) -> str:
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    entries = []
    for i, j in pairs:
        r = r_sql(i, j)
        entries += [(cols[i], cols[j], r), (cols[j], cols[i], r)]
    entries += [(c, c, "cast(null as double)" if const[i] else "1.0D") for i, c in enumerate(cols)]
    body = ", ".join(f"named_struct('col_a', {lit(a)}, 'col_b', {lit(b)}, 'r', cast({r} as double))" for a, b, r in entries)
    return sums.selectExpr(f"inline(array({body}))")


def top_correlations(corr: DataFrame, cols: list[str], k: int = TOP_PAIRS) -> DataFrame:
    """The k strongest pairs of the upper triangle by |r|."""
    pos = {c: i for i, c in enumerate(cols)}
    idx = F.create_map(*[x for c, i in pos.items() for x in (F.lit(c), F.lit(i))])
    upper = corr.where(idx[F.col("col_a")] < idx[F.col("col_b")]).where(F.col("r").isNotNull())
    return upper.orderBy(F.desc(F.abs("r")), "col_a", "col_b").limit(k)


def value_range(df: DataFrame, col: str) -> DataFrame:
    """Min and max of a column."""
    return df.agg(F.min(col_of(col)).alias(f"min_{col}"), F.max(col_of(col)).alias(f"max_{col}"))


def regression_metrics(pred: DataFrame, label: str = "y", prediction: str = "prediction",
                       by=("model",)) -> DataFrame:
    """MSE, RMSE, MAE and R² = 1 - SSE/SST per group in one pass
    (SST = n·var_pop(label); R² NULL when the label is constant)."""
    e = col_of(prediction) - col_of(label)
    ok = pred.where(col_of(label).isNotNull() & col_of(prediction).isNotNull())
    agg = ok.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(e * e).alias("mse"),
                              F.avg(F.abs(e)).alias("mae"), F.sum(e * e).alias("_sse"),
                              (F.count(F.lit(1)) * F.var_pop(col_of(label))).alias("_sst"))
    return agg.select(*by, "n", "mse", F.sqrt("mse").alias("rmse"), "mae",
                      F.when(F.col("_sst") > 0, 1 - F.col("_sse") / F.col("_sst")).alias("r2"))


#: long metric names, letters and digits only -> short ones
METRIC_NAMES = {"meansquarederror": "mse", "meanabsoluteerror": "mae", "rootmeansquarederror": "rmse",
                "r2score": "r2", "r²": "r2"}


def metric_name(text: str) -> str:
    """One name per metric, however it is spelt."""
    plain = "".join(c for c in text.lower() if c.isalnum())
    return METRIC_NAMES.get(plain, plain)


def pick_best(metrics: DataFrame, metric: str = "mse", model: str = "model",
              higher_is_better: bool | None = None) -> DataFrame:
    """The best model by ``metric`` with its direction (aggregate
    ``min_by``/``max_by``, ties broken by model name)."""
    from limnos.functions.constants import HIGHER_IS_BETTER
    wanted = metric_name(metric)
    name = min((c for c in metrics.columns if metric_name(c) == wanted), default=None)
    if name is None:
        raise ValueError(f"metric {metric!r} not found")
    hib = higher_is_better if higher_is_better is not None else wanted in map(metric_name, HIGHER_IS_BETTER)
    v = col_of(name)
    ok = metrics.where(v.isNotNull() & ~F.isnan(v))
    # top-1 (TakeOrdered), ties broken by model name
    return (ok.orderBy(F.desc(v) if hib else F.asc(v), col_of(model)).limit(1)
              .select(col_of(model).alias("best_model"), v.alias(f"best_{name}")))


def pivot_wide(long: DataFrame, row: str, col: str, value: str, values: list[str]) -> DataFrame:
    """One row per ``row`` value, one column per ``col`` value."""
    return long.groupBy(row).pivot(col, values).agg(F.first(col_of(value), ignorenulls=True))
