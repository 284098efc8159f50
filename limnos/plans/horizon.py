"""Forecasts over a horizon.

Models predict the next row from a look-back window. Here each prediction is
appended to the window and the oldest row leaves it, as often as there are
future dates. Linear models are folded inside one expression; others are
applied step by step. Results are in the measures' own units.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from limnos.functions.exprs import col_of
from limnos.operators import forecast as fc
from limnos.operators import timeseries as ts
from limnos.operators.common import materialize, q, stats_join
from limnos.plans.training import DEFAULT_PARAMS


def future_date(last: Column, step: Column, unit: str) -> Column:
    """The date of a step after ``last``: the days that follow, or the
    ends of the months that follow."""
    if unit == "day":
        return F.date_add(F.to_date(last), step.cast("int"))
    if unit == "month":
        return F.last_day(F.add_months(F.to_date(last), step.cast("int")))
    raise ValueError(f"unknown unit {unit}")


def seeds(rows: DataFrame, key: str, order: str, features: list[str], look_back: int) -> DataFrame:
    """(key, _last, _window): each key's last ``look_back`` rows of
    ``features``, in order. A key with fewer rows, or with a NULL among them,
    has no seed: it can't be forecast."""
    w = Window.partitionBy(q(key)).orderBy(F.col(q(order)).desc())
    step = F.array(*[col_of(f).cast("double") for f in features])
    last = rows.where(col_of(order).isNotNull()).withColumn("_turn", F.row_number().over(w)).where(F.col("_turn") <= look_back)
    got = last.groupBy(col_of(key)).agg(F.max(order).alias("_last"), F.sort_array(F.collect_list(F.struct(F.col(q(order)).alias("o"), step.alias("x")))).alias("_rows"))
    got = got.select(col_of(key), "_last", F.col("_rows.x").alias("_window"))
    whole = F.forall(F.flatten("_window"), lambda v: v.isNotNull())
    return got.where((F.size("_window") == look_back) & whole)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def fold_linear(windows: DataFrame, weights: Column, intercepts: Column, targets: list[int], n_features: int, horizon: int) -> DataFrame:
    """``windows`` with ``_steps``: for each of ``horizon`` steps the array of
    all features. ``weights`` is an array, per target, of one weight for each
    value of the flattened window, ``intercepts`` an array; both may differ by
    row. A feature that is no target keeps its last value."""
    of_target = {f: i for i, f in enumerate(targets)}

    def follow(window):
        flat, newest = F.flatten(window), F.element_at(window, -1)
        row = [F.element_at(intercepts, of_target[f] + 1) + _dot(flat, F.element_at(weights, of_target[f] + 1)) if f in of_target else newest[f] for f in range(n_features)]
        return F.concat(F.slice(window, F.lit(2), F.greatest(F.size(window) - 1, F.lit(0))), F.array(F.array(*row)))
    start = F.struct(F.col("_window").alias("w"), F.slice("_window", 1, 0).alias("out"))

    def one(state, _):
        after = follow(state["w"])
        return F.struct(after.alias("w"), F.concat(state["out"], F.slice(after, -1, 1)).alias("out"))
    return windows.withColumn("_steps", F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), start, one)["out"])


def roll_models(windows: DataFrame, models: dict[int, PipelineModel], n_features: int, horizon: int) -> DataFrame:
    """As ``fold_linear`` for any fitted models, by the place of their target
    among the features. Every step is written before the next one."""
    state = windows.withColumn("_steps", F.slice("_window", 1, 0))
    for _ in range(horizon):
        kept = state.columns
        state = state.withColumn("features", array_to_vector(F.flatten("_window")))
        for f, model in models.items():
            state = model.transform(state).withColumnRenamed("prediction", f"_p{f}")
        row = F.array(*[F.col(f"_p{f}") if f in models else F.element_at("_window", -1)[f] for f in range(n_features)])
        state = state.withColumns({"_window": F.concat(F.slice("_window", F.lit(2), F.size("_window") - 1), F.array(row)), "_steps": F.concat("_steps", F.array(row))})
        state = materialize(state.select(*kept), "rolled")
    return state


def dated(steps: DataFrame, key: str, features: list[str], targets: list[str], unit: str) -> DataFrame:
    """One row per key and future date: key, step (from 1), forecast_date and
    the targets."""
    long = steps.select(col_of(key), "_last", F.posexplode("_steps").alias("_i", "_row"))
    step = F.col("_i") + 1
    return long.select(col_of(key), step.alias("step"), future_date(F.col("_last"), step, unit).alias("forecast_date"),
                       *[F.element_at("_row", features.index(t) + 1).alias(t) for t in targets])


def unscaled(forecast: DataFrame, stats: DataFrame, key: str | None, targets: list[str]) -> DataFrame:
    """Back to the measures' units by the statistics that scaled them: a table
    of (column, lo, hi) or, with ``key``, of _lo and _hi columns by key."""
    if key is None:
        return ts.invert_minmax(forecast, stats, targets)
    wide = stats_join(forecast, stats.select(col_of(key), *[F.col(q(p + t)) for t in targets for p in ("_lo", "_hi")]), [key])
    back = {t: F.col(q(t)) * (F.col(q("_hi" + t)) - F.col(q("_lo" + t))) + F.col(q("_lo" + t)) for t in targets}
    return wide.withColumns(back).select(*forecast.columns)


def forecast_least_squares(scaled: DataFrame, key: str, order: str, value: str, horizon: int, unit: str = "day") -> DataFrame:
    """Per key y = a + b x of a row on the row before it (least squares over
    the key's rows), folded over the horizon. A key whose values don't vary
    has no slope: it keeps its last value."""
    w = Window.partitionBy(q(key)).orderBy(q(order))
    pairs = scaled.select(col_of(key), col_of(value).cast("double").alias("_y"), F.lag(col_of(value).cast("double")).over(w).alias("_x"))
    fit = pairs.where(F.col("_x").isNotNull() & F.col("_y").isNotNull()).groupBy(col_of(key)).agg(
        F.when(F.var_pop("_x") > 0, F.covar_pop("_x", "_y") / F.var_pop("_x")).alias("_b"), F.avg("_x").alias("_mx"), F.avg("_y").alias("_my"))
    start = stats_join(seeds(scaled, key, order, [value], 1), fit, [key])
    slope = F.coalesce("_b", F.lit(1.0))
    intercept = F.when(F.col("_b").isNull(), F.lit(0.0)).otherwise(F.col("_my") - F.col("_b") * F.col("_mx"))
    # materialised weights keep the fold's expression small
    start = start.withColumns({"_weights": F.array(F.array(slope)), "_intercepts": F.array(intercept)})
    return dated(fold_linear(start, F.col("_weights"), F.col("_intercepts"), [0], 1, horizon), key, [value], [value], unit)


def fit_targets(rows: DataFrame, key: str, order: str, features: list[str], targets: list[str], family: str, look_back: int,
                params: dict | None = None) -> dict[int, PipelineModel]:
    """A model per target over the same windows, which are built and written
    once. Windows with a NULL are left out."""
    names = [f"_f{i}" for i in range(len(features))]  # a measure may be named x or y
    win = ts.sliding_windows(rows.select(key, order, *[F.col(q(c)).alias(n) for c, n in zip(features, names, strict=True)]), key, order, names, names[0], look_back)
    whole = F.forall(F.flatten("x"), lambda v: v.isNotNull())
    labels = [F.col(names[features.index(t)]).cast("double").alias(f"_y{i}") for i, t in enumerate(targets)]
    table = materialize(fc.with_features(win.where(whole)).select("features", *labels), "target_windows")
    return {features.index(t): fc.fit_final(table.where(F.col(f"_y{i}").isNotNull()).withColumnRenamed(f"_y{i}", "y"), family,
                                            DEFAULT_PARAMS.get(family, {}) if params is None else params, validation_col=None) for i, t in enumerate(targets)}


def forecast(rows: DataFrame, key: str, order: str, features: list[str], targets: list[str], family: str = "linear", look_back: int = 12,
             horizon: int = 12, unit: str = "day", stats: DataFrame | None = None, stats_key: str | None = None) -> DataFrame:
    """Per key and future date the forecast of every target, models
    fitted on ``rows`` (scaled measures, a row per key and ``order``). With
    ``stats`` the result is in the measures' units (see ``unscaled``)."""
    missing = [t for t in targets if t not in features]
    used = [*features, *missing]
    models = fit_targets(rows, key, order, used, targets, family, look_back)
    start = seeds(rows, key, order, used, look_back)
    if family == "linear":
        fitted = [models[used.index(t)].stages[-1] for t in targets]
        weights = F.array(*[F.array(*[F.lit(float(c)) for c in m.coefficients.toArray()]) for m in fitted])
        intercepts = F.array(*[F.lit(float(m.intercept)) for m in fitted])
        start = start.withColumns({"_weights": weights, "_intercepts": intercepts})
        steps = fold_linear(start, F.col("_weights"), F.col("_intercepts"), [used.index(t) for t in targets], len(used), horizon)
    else:
        steps = roll_models(start, models, len(used), horizon)
    out = dated(steps, key, used, targets, unit)
    return out if stats is None else unscaled(out, stats, stats_key, targets)
