"""Early stopping, durable search, model store and forecasts over a horizon."""
import datetime as dt
import json
import math
import random

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from limnos.operators import forecast as fc
from limnos.operators import timeseries as ts
from limnos.plans import horizon as hz
from limnos.plans.store import ModelStore
from tests.conftest import rows

D = dt.date


def slow_stopping(scores, patience):
    best, at, step = None, 0, -1
    for step, v in enumerate(scores):
        good = v is not None and not math.isnan(v) and (best is None or v < best)
        if good:
            best, at = v, step
        if step - at >= patience:
            break
    return at, step + 1


def test_stopping_equals_brute_force(spark):
    rng = random.Random(4)
    lists = [[], [0.5], [None], [math.nan, 0.2], [1.0] * 30, list(range(30, 0, -1)), [0.1, *[0.2] * 9, 0.05], [0.1, *[0.2] * 10, 0.05]]
    lists += [[rng.choice([None, math.nan, *[rng.random() for _ in range(6)]]) for _ in range(rng.randint(1, 60))] for _ in range(60)]
    lists = [[None if v is None else float(v) for v in x] for x in lists]
    for patience in (1, 3, 10):
        want = [slow_stopping(x, patience) for x in lists]
        assert [fc.stopping(x, patience) for x in lists] == want
        df = spark.createDataFrame([(i, s * 2, v) for i, x in enumerate(lists) for s, v in enumerate(x)], "k int, step int, v double")
        got = {r["k"]: (r["best_step"] // 2, r["steps_run"], r["best_value"]) for r in fc.stopping_points(df, ["k"], "step", "v", patience).collect()}
        for i, x in enumerate(lists):
            if x:
                best = [v for v in x[:want[i][1]] if v is not None and not math.isnan(v)]
                assert got[i] == (*want[i], min(best) if best else None)


def learning_table(spark, n=300):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(n, 3))
    y = np.sin(x[:, 0] * 3) + 0.4 * rng.normal(size=n)
    return spark.createDataFrame([(Vectors.dense(a.tolist()), float(b), i % 5 == 0, "test" if i % 7 == 0 else "train", f"l{i % 3}", i) for i, (a, b) in enumerate(zip(x, y))],
                                 ["features", "y", "is_validation", "split", "location", "timestamp"]).repartition(3).cache()


def test_boosting_keeps_the_best_iteration(spark):
    table = learning_table(spark)
    params = {"maxIter": 25, "maxDepth": 5, "stepSize": 0.9}
    fitted = fc.fit_validated(table, "gbt", params, patience=3)
    whole = fc.make_estimator("gbt").copy({}).setParams(**params).fit(table.where("NOT is_validation"))
    losses = whole.evaluateEachIteration(table.where("is_validation"), "squared")
    at, run = slow_stopping(losses, 3)
    assert (fitted.best_step, fitted.model.getNumTrees) == (at, at + 1) and run < 25
    assert fitted.observations["val_mse"] == pytest.approx(losses[:run])
    assert fitted.score == pytest.approx(losses[at])  # the model kept is the one of that iteration


def test_search_is_taken_up_again(spark, tmp_path, monkeypatch):
    table = learning_table(spark, 120)
    folder = str(tmp_path / "linear")
    draws = [{"regParam": 0.1 * (i + 1)} for i in range(4)]
    ran = []
    fit = fc.fit_validated

    def lost(train, family, params, *a, **k):
        ran.append(params["regParam"])
        if len(ran) == 3:
            raise ConnectionError("executor lost")
        return fit(train, family, params, *a, **k)
    monkeypatch.setattr(fc, "fit_validated", lost)
    with pytest.raises(ConnectionError):  # not a failed draw
        fc.random_search(table, "linear", draws=draws, folder=folder, parallelism=1)
    assert sorted(fc.committed_trials(spark, folder)) == ["00", "01", "03"][:len(fc.committed_trials(spark, folder))]
    before = set(fc.committed_trials(spark, folder))
    ran.clear()
    monkeypatch.setattr(fc, "fit_validated", lambda *a, **k: ran.append(a[2]["regParam"]) or fit(*a, **k))
    trials, best = fc.random_search(table, "linear", draws=draws, folder=folder, parallelism=1)
    assert len(ran) == 4 - len(before) and [t.status for t in trials] == ["COMPLETED"] * 4
    assert best == min(trials, key=lambda t: t.score).values
    # another draw under an old id is run, not taken over
    ran.clear()
    fc.random_search(table, "linear", draws=[{"regParam": 0.7}, *draws[1:]], folder=folder, parallelism=1)
    assert ran == [0.7]


def test_search_failures(spark):
    table = learning_table(spark, 60)
    trials, _ = fc.random_search(table, "random_forest", draws=[{"maxDepth": 2, "numTrees": 2}, {"maxDepth": 99, "numTrees": 2}], parallelism=1)
    assert [t.status for t in trials] == ["COMPLETED", "FAILED"] and trials[1].message
    assert fc.Trial.parse(trials[0].document()) == trials[0]
    with pytest.raises(RuntimeError, match="no trial"):
        fc.random_search(table.where("NOT is_validation"), "linear", draws=[{"regParam": 0.1}])
    assert fc.TRIALS == {"linear": 15, "random_forest": 15, "gbt": 20}


def test_model_store_versions(spark, tmp_path):
    df = spark.createDataFrame([(Vectors.dense([float(i)]), 2.0 * i) for i in range(20)], ["features", "y"])
    store, made = ModelStore(spark, str(tmp_path)), []

    def build(reg=0.0):
        made.append(reg)
        return fc.fit_final(df, "linear", {"regParam": reg}, validation_col=None)
    manifest = {"features": ["a", "b"], "scaler": [("a", 0.0, 1.0)], "params": {"regParam": 0.0}}
    assert store.find("m") is None
    store.get("m", manifest, build)
    store.get("m", manifest, build)
    assert made == [0.0]
    other = {**manifest, "features": ["b", "a"]}
    store.get("m", other, lambda: build(5.0))          # another feature order: not the same model
    store.get("m", manifest, build, "replace")
    assert made == [0.0, 5.0, 0.0] and [v for v, _, _ in store.versions("m")] == [1, 2, 3]
    version, model, found = store.find("m", other)
    assert version == 2 and found == json.loads(json.dumps(other)) and model.stages[-1].getRegParam() == 5.0
    # a version that was never finished is not seen
    half = tmp_path / "m" / "000009-half"
    build().write().save(str(half / "model"))
    (half / "manifest").mkdir()
    (half / "manifest" / "part-0.txt").write_text(json.dumps(manifest))
    assert store.find("m", manifest)[0] == 3 and store.save("m", build(), manifest) == 4
    with pytest.raises(ValueError):
        store.get("m", manifest, build, "whatever")


def series(spark):
    rng = np.random.default_rng(5)
    data = [(k, D(2024, 1, 1) + dt.timedelta(days=i), float(i % 7 + rng.normal() / 5), float((i * 3) % 5)) for k in ("a", "b", None) for i in range(60)]
    data += [("short", D(2024, 1, 1), 1.0, 2.0)] + [("flat", D(2024, 3, i + 1), 3.0, 4.0) for i in range(20)]
    return spark.createDataFrame(data, "location string, timestamp date, x double, z double"), data


@pytest.mark.parametrize("family", ["linear", "random_forest"])
def test_forecast_feeds_predictions_back(spark, family):
    df, data = series(spark)
    look_back, horizon = 4, 6
    models = hz.fit_targets(df, "location", "timestamp", ["x", "z"], ["x"], family, look_back)
    got = hz.forecast(df, "location", "timestamp", ["x", "z"], ["x"], family, look_back, horizon)
    by = {}
    for r in got.collect():
        by.setdefault(r["location"], {})[r["step"]] = (r["forecast_date"], r["x"])
    assert set(by) == {"a", "b", None, "flat"}  # too short a series is not forecast
    model = models[0].stages[-1]
    for k in by:
        own = sorted([(d, x, z) for loc, d, x, z in data if loc == k])
        window = [[x, z] for _, x, z in own[-look_back:]]
        for step in range(1, horizon + 1):
            p = model.predict(Vectors.dense([v for s in window for v in s]))
            assert by[k][step][0] == own[-1][0] + dt.timedelta(days=step)
            assert by[k][step][1] == pytest.approx(p, rel=1e-9)
            window = [*window[1:], [p, window[-1][1]]]  # z is no target: it keeps its last value


def test_forecast_in_units_and_at_month_ends(spark):
    df, data = series(spark)
    stats = ts.minmax_stats(df, "location", ["x", "z"])
    scaled = ts.minmax_per_key(df, "location", ["x", "z"])
    plain = hz.forecast(scaled, "location", "timestamp", ["x", "z"], ["x", "z"], horizon=3, unit="month")
    units = hz.forecast(scaled, "location", "timestamp", ["x", "z"], ["x", "z"], horizon=3, unit="month", stats=stats, stats_key="location")
    a = {(r["location"], r["step"]): r for r in plain.collect()}
    for r in units.collect():
        own = [z for k, _, _, z in data if k == r["location"]]
        assert r["z"] == pytest.approx(a[(r["location"], r["step"])]["z"] * (max(own) - min(own)) + min(own))
    assert rows(units.where("location = 'a'"), "forecast_date") == [(D(2024, 3, 31),), (D(2024, 4, 30),), (D(2024, 5, 31),)]
    assert hz.forecast(scaled, "location", "timestamp", ["x"], ["x"], horizon=1).where("location = 'flat'").first()["x"] is not None


def test_least_squares_fold(spark):
    df, data = series(spark)
    got = hz.forecast_least_squares(df, "location", "timestamp", "x", 5)
    by = {(r["location"], r["step"]): r["x"] for r in got.collect()}
    for k in ("a", "b", None, "flat", "short"):
        own = [x for _, x in sorted((d, x) for loc, d, x, _ in data if loc == k)]
        b, a = np.polyfit(own[:-1], own[1:], 1) if len(set(own)) > 1 else (1.0, 0.0)
        v = own[-1]
        for step in range(1, 6):
            v = a + b * v
            assert by[(k, step)] == pytest.approx(v, rel=1e-6)
    assert hz.forecast_least_squares(df.limit(0), "location", "timestamp", "x", 5).count() == 0
