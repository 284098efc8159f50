"""Forecasting operators (I01-I08): SQL baselines, Spark ML regressors on the
look-back windows, seeded random search with early stopping, bulk scoring,
multi-target forecasts and the model comparison.

The reference trains small neural nets on one machine; here the same job
shape — train on windows, search settings, stop early, score in bulk,
compare — runs as distributed Spark ML fits over the window table.
"""

from __future__ import annotations

import json
import math
import random
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException, IllegalArgumentException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from limnos.functions.exprs import col_of
from limnos.operators.common import as_list, attach_row
from limnos.operators.profile import regression_metrics

# ----------------------------------------------------------------- baselines


def _step_value(i: int, feature: int = 1):
    return F.element_at(F.element_at("x", i), feature)


def baseline_last_value(samples: DataFrame, feature: int = 1) -> DataFrame:
    """Predict the last observed value of the target feature."""
    return samples.withColumn("prediction", _step_value(-1, feature))


def baseline_window_mean(samples: DataFrame, feature: int = 1) -> DataFrame:
    """Predict the mean of the target feature over the look-back window."""
    s = F.aggregate("x", F.lit(0.0), lambda acc, st: acc + F.element_at(st, feature))
    return samples.withColumn("prediction", s / F.size("x"))


def baseline_ar1(samples: DataFrame, key: str | None, split: str = "split", feature: int = 1) -> DataFrame:
    """Per-key AR(1): y ≈ a + b·x_last, least squares on the training rows
    (b = cov(x, y) / var(x), a = mean(y) - b·mean(x)). Keys without a
    usable fit (constant x, no training rows) fall back to the last value.
    The fit is a window aggregate per key (no join back)."""
    keys = as_list(key)
    x_last = _step_value(-1, feature)
    tr = F.col(split) == "train"
    xt, yt = F.when(tr, F.col("_xl")), F.when(tr, F.col("y"))
    d = samples.withColumn("_xl", x_last)
    fit = {"_cov": F.covar_pop(xt, yt), "_var": F.var_pop(xt), "_mx": F.avg(xt), "_my": F.avg(yt)}
    if keys:
        w = Window.partitionBy(*keys)
        d = d.withColumns({k: v.over(w) for k, v in fit.items()})
    else:  # one global fit: a one-row aggregate (scalar subquery)
        d = attach_row(d, d.agg(*[v.alias(k) for k, v in fit.items()]))
    b = F.when(F.col("_var") > 0, F.col("_cov") / F.col("_var"))
    pred = F.coalesce(F.col("_my") - b * F.col("_mx") + b * F.col("_xl"), F.col("_xl"))
    return d.withColumn("prediction", pred).drop("_xl", "_cov", "_var", "_mx", "_my")


BASELINES = {
    "last_value": lambda s, key: baseline_last_value(s),
    "mean12": lambda s, key: baseline_window_mean(s),
    "ar1": lambda s, key: baseline_ar1(s, key),
}


def baseline_predictions(samples: DataFrame, key: str | None, keep: list[str]) -> DataFrame:
    """I04 for the baselines: one long table (model, keys…, y, prediction).
    All baselines are computed as columns of ONE pass over the samples (the
    AR(1) fit is a window on the same key partitioning), then unpivoted."""
    d = samples
    for name, fn in BASELINES.items():
        d = fn(d, key).withColumnRenamed("prediction", f"_p_{name}")
    names = list(BASELINES)
    return d.select(*keep, "y", F.inline(F.array(*[
        F.struct(F.lit(n).alias("model"), F.col(f"_p_{n}").alias("prediction")) for n in names]))) \
            .select("model", *keep, "y", "prediction")


# ----------------------------------------------------------------- Spark ML


def with_features(samples: DataFrame, x: str = "x", out: str = "features") -> DataFrame:
    """Flatten the (steps × features) window into one ML vector (native)."""
    return samples.withColumn(out, array_to_vector(F.flatten(col_of(x))))


FAMILIES = {
    "linear": LinearRegression,
    "random_forest": RandomForestRegressor,
    "gbt": GBTRegressor,
}

# search spaces: name -> (kind, low, high) ; kinds: int, float, logfloat, bool
SPACES = {
    "linear": {"regParam": ("logfloat", 1e-4, 1.0), "elasticNetParam": ("float", 0.0, 1.0),
               "fitIntercept": ("bool", 0, 1)},
    "random_forest": {"numTrees": ("int", 10, 40), "maxDepth": ("int", 2, 6),
                      "subsamplingRate": ("float", 0.5, 1.0)},
    "gbt": {"maxIter": ("int", 5, 30), "maxDepth": ("int", 2, 5), "stepSize": ("logfloat", 0.01, 0.3)},
}


def sample_params(space: dict, n_trials: int, seed: int = 42) -> list[dict]:
    """Seeded random draws over int / float / log-float / bool ranges."""
    rng = random.Random(seed)
    out = []
    for _ in range(n_trials):
        p = {}
        for name, (kind, lo, hi) in space.items():
            if kind == "int":
                p[name] = rng.randint(int(lo), int(hi))
            elif kind == "float":
                p[name] = rng.uniform(lo, hi)
            elif kind == "logfloat":
                p[name] = math.exp(rng.uniform(math.log(lo), math.log(hi)))
            else:
                p[name] = bool(rng.getrandbits(1))
        out.append(p)
    return out


def make_estimator(family: str, seed: int = 42, features: str = "features", label: str = "y"):
    kw = {"featuresCol": features, "labelCol": label, "predictionCol": "prediction"}
    if family in ("random_forest", "gbt"):
        kw["seed"] = seed
    return FAMILIES[family](**kw)


# ----------------------------------------------------------------- early stopping

#: steps without a better validation score after which a fit ends
PATIENCE = 10


def stopping(scores: list[float | None], patience: int = PATIENCE) -> tuple[int, int]:
    """(best step, steps run) of a sequence of validation scores, lower
    being better: the run ends ``patience`` steps after the best one, or with
    the sequence; only a lower score is better. NULL and NaN never are; with
    no other the best step is 0."""
    best, at = math.inf, 0
    for step, value in enumerate(scores):
        if value is not None and value < best:
            best, at = value, step
        if step - at >= patience:
            return at, step + 1
    return at, len(scores)


def stopping_points(seen: DataFrame, keys: list[str], step: str, value: str, patience: int = PATIENCE) -> DataFrame:
    """I03 for score tables: per group of ``keys`` best_step, best_value and
    steps_run as ``stopping`` finds them along ``step`` (steps count by their
    place). One fold over the group's scores, which are as many as a fit has
    steps."""
    scored = F.when(~F.isnan(col_of(value)), col_of(value).cast("double"))
    rows = seen.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(col_of(step).cast("bigint").alias("step"), scored.alias("value")))).alias("s"))
    start = F.struct(F.lit(float("inf")).alias("best"), F.lit(0).alias("at"), F.lit(0).alias("n"), F.lit(False).alias("done"))

    def fold(state, x):
        better = F.coalesce(x["value"] < state["best"], F.lit(False))
        at = F.when(better, state["n"]).otherwise(state["at"])
        after = F.struct(F.when(better, x["value"]).otherwise(state["best"]).alias("best"), at.alias("at"), (state["n"] + 1).alias("n"), (state["n"] - at >= patience).alias("done"))
        return F.when(state["done"], state).otherwise(after)
    end = rows.withColumn("e", F.aggregate("s", start, fold))
    best = F.when(F.col("e.best") < float("inf"), F.col("e.best"))
    return end.select(*keys, F.element_at("s", F.col("e.at") + 1)["step"].alias("best_step"), best.alias("best_value"), F.col("e.n").cast("bigint").alias("steps_run"))


@dataclass
class Fitted:
    """A model, its score on the validation rows, the step it was taken at and
    every step's scores by metric."""

    model: object
    score: float
    best_step: int
    observations: dict[str, list[float]]


def fit_validated(train: DataFrame, family: str, params: dict, seed: int = 42, validation_col: str = "is_validation", patience: int = PATIENCE) -> Fitted:
    """Fits on the rows that are not validation rows. A boosted model is
    scored on the validation rows after every tree; the trees after the best
    one are left out (the fit is repeated up to it: trees depend on the seed
    and the earlier trees alone)."""
    est = make_estimator(family, seed)
    est = est.copy({getattr(est, k): v for k, v in params.items()})
    fit_rows, validation = train.where(~F.col(validation_col)), train.where(F.col(validation_col))
    model, at, seen = est.fit(fit_rows), 0, {}
    if family == "gbt":
        losses = [float(x) for x in model.evaluateEachIteration(validation, "squared")]
        at, run = stopping(losses, patience)
        seen["val_mse"] = losses[:run]
        if at + 1 < len(losses):
            model = est.copy({est.maxIter: at + 1}).fit(fit_rows)
    elif family == "linear":
        seen["loss"] = [float(x) for x in model.summary.objectiveHistory]
    m = regression_metrics(model.transform(validation).withColumn("model", F.lit(family))).first()
    score = math.nan if m is None or m["mse"] is None else float(m["mse"])
    seen.setdefault("val_mse", [score])
    return Fitted(model, score, at, seen)


# ----------------------------------------------------------------- search

#: draws per family
TRIALS = {"linear": 15, "random_forest": 15, "gbt": 20}


@dataclass
class Trial:
    trial_id: str
    status: str
    values: dict
    score: float | None = None
    best_step: int = 0
    message: str | None = None
    metrics: dict = field(default_factory=dict)

    def document(self) -> str:
        """The trial in the layout that ``documents.trials`` reads."""
        seen = {m: {"direction": "min", "observations": [{"value": [v], "step": i} for i, v in enumerate(values)]} for m, values in self.metrics.items()}
        return json.dumps({"trial_id": self.trial_id, "hyperparameters": {"values": self.values}, "metrics": {"metrics": seen},
                           "score": self.score, "best_step": self.best_step, "status": self.status, "message": self.message}, sort_keys=True)

    @classmethod
    def parse(cls, text: str) -> Trial:
        d = json.loads(text)
        metrics = {m: [o["value"][0] for o in v["observations"]] for m, v in d["metrics"]["metrics"].items()}
        return cls(d["trial_id"], d["status"], d["hyperparameters"]["values"], d["score"], d["best_step"], d["message"], metrics)


def committed_trials(spark, folder: str) -> dict[str, Trial]:
    """Trials that ended, by id. A trial's document appears whole or not at
    all, so what a lost job was at is not among them."""
    try:
        rows = spark.read.text(f"{folder}/trial_*").collect()  # one short line a trial
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    return {t.trial_id: t for t in (Trial.parse(r[0]) for r in rows)}


def random_search(train: DataFrame, family: str, n_trials: int | None = None, seed: int = 42, validation_col: str = "is_validation",
                  parallelism: int = 8, folder: str | None = None, draws: list[dict] | None = None) -> tuple[list[Trial], dict]:
    """Fits seeded parameter draws (TRIALS of the family unless given) and
    scores each on the validation rows (MSE). Each fit is a distributed job; up
    to ``parallelism`` are submitted at once.

    A trial that ends is written to ``folder`` at once; a search started again
    there takes the trials whose draws are the same and runs the others. A
    draw that the model does not accept, or that gives no finite score, is a
    FAILED trial; any other error is raised. No completed trial is an error.
    """
    from concurrent.futures import ThreadPoolExecutor
    spark = train.sparkSession
    draws = draws if draws is not None else sample_params(SPACES[family], TRIALS[family] if n_trials is None else n_trials, seed)
    done = committed_trials(spark, folder) if folder else {}

    def run(i_params):
        i, params = i_params
        before = done.get(f"{i:02d}")
        if before is not None and before.values == json.loads(json.dumps(params)):
            return before
        t = Trial(f"{i:02d}", "FAILED", params)
        try:
            fitted = fit_validated(train, family, params, seed, validation_col)
            t.best_step, t.metrics = fitted.best_step, fitted.observations
            if math.isfinite(fitted.score):
                t.status, t.score = "COMPLETED", fitted.score
            else:
                t.message, t.metrics = "no finite validation score", {}
        except IllegalArgumentException as e:
            t.message = f"{type(e).__name__}: {e}"
        if folder:
            spark.createDataFrame([(t.document(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/trial_{t.trial_id}")
        return t

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        trials = list(pool.map(run, enumerate(draws)))
    finished = [t for t in trials if t.status == "COMPLETED"]
    if not finished:
        raise RuntimeError(f"no trial of {family} completed: {trials[0].message if trials else 'no draws'}")
    return trials, min(finished, key=lambda t: (t.score, t.trial_id)).values


def trials_table(spark, family: str, trials: list[Trial]) -> DataFrame:
    """A11 layout: one row per trial."""
    rows = [(family, t.trial_id, t.status, t.score, t.best_step, json.dumps(t.values, sort_keys=True),
             json.dumps(t.metrics, sort_keys=True), t.message) for t in trials]
    schema = ("model string, trial_id string, status string, score double, best_step long, "
              "hyperparameters string, metrics string, message string")
    return spark.createDataFrame(rows, schema)


def fit_final(train: DataFrame, family: str, params: dict, seed: int = 42,
              validation_col: str | None = "is_validation") -> PipelineModel:
    """Refit with the best settings on the training rows. With validation
    rows these are kept out of the fit and end a boosted one (I03)."""
    if validation_col:
        return PipelineModel([fit_validated(train, family, params, seed, validation_col).model])
    est = make_estimator(family, seed)
    return Pipeline(stages=[est.copy({getattr(est, k): v for k, v in params.items()})]).fit(train)


def save_or_reuse(model_path: str, build, mode: str = "reuse", manifest: dict | None = None) -> PipelineModel:
    """``mode="reuse"`` takes the latest whole version below ``model_path``
    whose manifest is the wanted one, otherwise (or with ``"replace"``) trains
    and stores a new version."""
    from pyspark.sql import SparkSession

    from limnos.plans.store import ModelStore
    return ModelStore(SparkSession.active(), model_path).get("model", manifest or {}, build, mode)


def score(models: dict[str, PipelineModel], df: DataFrame, keep: list[str]) -> DataFrame:
    """Bulk scoring of all rows by every model, one long table."""
    from functools import reduce
    parts = [m.transform(df).select(F.lit(name).alias("model"), *keep, "y", "prediction")
             for name, m in models.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)
