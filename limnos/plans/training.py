"""Stage 3 — train, search, compare (I01-I08) on a window table.

The driver only loops over a handful of model specs; every fit, score and
metric is a distributed Spark job over the (checkpointed) sample table.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.operators import forecast as fc
from limnos.operators import timeseries as ts
from limnos.operators.common import materialize, q
from limnos.operators.profile import regression_metrics

DEFAULT_PARAMS = {
    "linear": {"regParam": 0.01},
    "random_forest": {"numTrees": 20, "maxDepth": 5},
    "gbt": {"maxIter": 20, "maxDepth": 3},
}


def training_table(samples: DataFrame, key: str = "location", order: str = "timestamp") -> DataFrame:
    """Feature vectors + split + validation flag (D10/D11), materialised once
    into the checkpoint folder: fits iterate over it many times, and a lost
    executor then re-reads it instead of recomputing the windows."""
    feats = fc.with_features(samples)
    # stored order must be total (a variant label breaks ties between the
    # cleaned and normalised rows of one day), so the split is reproducible
    tie = [c for c in ("data_type", "sample_pos") if c in samples.columns]
    train = ts.validation_tail(feats.where(F.col("split") == "train"), key, [order] + tie, each=True)
    test = feats.where(F.col("split") == "test").withColumn("is_validation", F.lit(False))
    return materialize(train.unionByName(test).select(key, order, "split", "is_validation", "features", "y"))


def train_and_compare(table: DataFrame, families=("linear", "random_forest", "gbt"), params=None,
                      key: str = "location", order: str = "timestamp") -> tuple[DataFrame, dict]:
    """Fit each family on the training rows, score the test
    rows, compute the error metrics and name the winner (lowest MSE)."""
    params = params or DEFAULT_PARAMS
    train = table.where(F.col("split") == "train")
    test = table.where(F.col("split") == "test")
    models = {f: fc.fit_final(train, f, params.get(f, {})) for f in families}
    scored = fc.score(models, test, [key, order])
    metrics = regression_metrics(scored, "y", "prediction", ("model",))
    return metrics, models


def search(table: DataFrame, families=("linear", "random_forest", "gbt"), n_trials: int | None = None,
           seed: int = 42, folder: str | None = None) -> DataFrame:
    """Seeded random search per family on (train - validation,
    validation), 15/15/20 draws unless ``n_trials`` is given; returns the trial
    table (A11 layout). ``folder``: where trials are kept as they end and
    taken up again."""
    return _searched(table, families, n_trials, seed, folder)[0]


def _searched(table, families, n_trials, seed, folder):
    train = table.where(F.col("split") == "train")
    parts, best = [], {}
    for fam in families:
        trials, best[fam] = fc.random_search(train, fam, n_trials, seed, folder=folder and f"{folder}/{fam}")
        parts.append(fc.trials_table(table.sparkSession, fam, trials))
    return reduce(DataFrame.unionByName, parts), best


def tune_and_compare(table: DataFrame, families=("linear", "random_forest", "gbt"), n_trials: int | None = None, seed: int = 42,
                     key: str = "location", order: str = "timestamp", folder: str | None = None, store=None, manifest: dict | None = None,
                     mode: str = "reuse"):
    """I02 → I06 → I08: search each family, refit it with its best draw on
    the training rows, score the test rows, compare. With a ``store`` the
    refitted models are kept there, or taken from there if one with the same
    manifest and parameters is. Returns (metrics, trials, best params per
    family)."""
    trials, best = _searched(table, families, n_trials, seed, folder)
    train, test = (table.where(F.col("split") == s) for s in ("train", "test"))
    models = {}
    for fam in families:
        def build(fam=fam):
            return fc.fit_final(train, fam, best[fam], seed)
        asked = {**(manifest or {}), "family": fam, "params": best[fam], "seed": seed}
        models[fam] = store.get(fam, asked, build, mode) if store else build()
    metrics = regression_metrics(fc.score(models, test, [key, order]), "y", "prediction", ("model",))
    return metrics, trials, best


def multi_target(norm: DataFrame, key: str, order: str, features: list[str], targets: list[str],
                 family: str = "linear", look_back: int = 12, stats: DataFrame | None = None, stats_key: str | None = None) -> DataFrame:
    """One regressor per target over the same windows. The forecast is for
    the day after each location's last one, from the ``look_back`` rows that
    end there. Output long: (location, model, parameter, value), in the scale
    of ``norm`` or, with ``stats`` (see ``horizon.unscaled``), in units."""
    from limnos.plans.horizon import forecast
    wide = forecast(norm, key, order, features, targets, family, look_back, 1, "day", stats, stats_key)
    pairs = F.array(*[F.struct(F.lit(t).alias("parameter"), F.col(q(t)).alias("value")) for t in targets])
    return wide.select(key, F.lit(family).alias("model"), F.inline(pairs))


def model_results(metrics: DataFrame, best: dict[str, dict]) -> DataFrame:
    """(model, hyperparameters as JSON text, batch_size, metrics) for
    ``documents.write_model_documents``; the fits here have no batches."""
    params = metrics.sparkSession.createDataFrame([(f, json.dumps(p, sort_keys=True)) for f, p in best.items()], "model string, hyperparameters string")
    names = ("mse", "rmse", "mae", "r2")
    values = F.map_from_arrays(F.array(*[F.lit(c) for c in names]), F.array(*names))
    return metrics.join(params, "model").select("model", "hyperparameters", F.lit(None).cast("int").alias("batch_size"), values.alias("metrics"))
