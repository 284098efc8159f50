"""Schema, filter, join, index and profile operators on hand-made frames."""
import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from limnos.operators import filters as flt
from limnos.operators import index as ix
from limnos.operators import joins as jn
from limnos.operators import profile as pf
from limnos.operators import schema as sc
from limnos.operators.quantiles import exact_quantiles
from tests.conftest import rows

D = dt.date


def test_canonical_names_location_time_and_coercion(spark):
    df = spark.createDataFrame(
        [("x", "2024", "1", " 1.5", "n/a"), ("y", "2024", "13", "2", "3"), (None, "2024", "2", "4", "5")],
        "` SITE ` string, `YEAR ` string, `MONTH` string, ` Nitrate-N/Nitrite-N  (mg/L) ` string, `pH Level` string")
    df = sc.canonical_names(df)
    assert "Nitrate-N/Nitrite-N (mg/L)" in df.columns
    df = sc.canonical_location(df)
    df = sc.canonical_time(df, as_date=True)
    assert "YEAR" not in df.columns and "MONTH" not in df.columns
    df = flt.drop_null_location(flt.drop_null_time(sc.coerce_numeric(df)))
    assert rows(df, "location", "timestamp", "pH Level", "Nitrate-N/Nitrite-N (mg/L)") == [
        ("x", D(2024, 1, 1), None, 1.5)]


def test_canonical_time_from_text_column(spark):
    df = spark.createDataFrame([("2024-01-02", 1.0), ("bad", 2.0)], "Date string, v double")
    out = flt.drop_null_time(sc.canonical_time(df))
    assert rows(out, "timestamp", "v") == [(dt.datetime(2024, 1, 2), 1.0)]


def test_no_location_column_is_single_dataset(spark):
    df = sc.canonical_location(spark.createDataFrame([(1.0,)], "v double"))
    assert df.first()["location"] is None


def test_drop_all_null_columns_before_dropna(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, None, None), (3, 3.0, None)], "id int, a double, b double")
    kept, dropped = flt.drop_all_null_columns(df, keep=["id"])
    assert dropped == ["b"]
    assert rows(flt.drop_any_null(kept), "id") == [(1,), (3,)]


def test_keep_alive_variants(spark):
    src = spark.createDataFrame([("a", 1.0), ("b", None)], "location string, v double")
    out = flt.keep_alive(src, src, "location", ["v"])
    assert rows(out, "location", "v") == [("a", 1.0), ("b", None)]
    marked = spark.createDataFrame([("a", D(2024, 1, 1), 1.0, True), ("b", D(2024, 1, 1), 2.0, False),
                                    ("b", D(2024, 1, 2), 2.0, False)],
                                   "location string, timestamp date, v double, k boolean")
    out = flt.keep_alive_marked(marked, "location", "k", ["v"])
    assert rows(out, "location", "timestamp", "v") == [("a", D(2024, 1, 1), 1.0), ("b", None, None)]


def test_location_filter_forms(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "location string, v int")
    assert rows(flt.location_filter(df, ["a", "c"]), "v") == [(1,), (3,)]
    assert flt.location_filter(df, []).count() == 0
    sel = spark.createDataFrame([("b",)], "location string")
    assert rows(flt.location_filter(df, sel), "v") == [(2,)]
    assert rows(flt.location_filter(df, ["a", "b"], max_inline=1), "v") == [(1,), (2,)]


def test_index_weights_classes_and_format(spark):
    from limnos.functions.constants import WQI_WEIGHTS
    assert math.isclose(sum(WQI_WEIGHTS.values()), 0.90)
    df = spark.createDataFrame([(100.0, None)], "`pH Level` double, `Dissolved Oxygen (mg/L)` double")
    r = ix.weighted_index(df).first()
    assert math.isclose(r["WQI"], 15.0)
    vals = spark.createDataFrame([(49.99,), (50.0,), (75.0,), (90.0,), (None,)], "WQI double")
    got = [r["wqi_class"] for r in ix.index_class(vals).collect()]
    assert got == ["Excellent", "Good", "Fair", "Poor", "Poor"]
    c = ix.clamp_col(spark.createDataFrame([(-5.0,), (50.0,), (150.0,)], "x double"), "x")
    assert [r["x"] for r in c.collect()] == [0.0, 50.0, 100.0]
    f = ix.format_col(spark.createDataFrame([(1.005,), (None,), (2.0,)], "x double"), "x")
    assert [r["x"] for r in f.collect()] == ["1.01", "N/A", "2.00"]


def test_one_hot_mean_impute_round_upper(spark):
    df = spark.createDataFrame([(1, "b", 1.0), (2, "a", None), (3, "b", 5.0)], "id int, t string, v double")
    oh = ix.one_hot(df, "t")
    assert oh.columns == ["id", "v", "t_a", "t_b"]
    assert rows(oh, "id", "t_a", "t_b") == [(1, 0, 1), (2, 1, 0), (3, 0, 1)]
    with pytest.raises(ValueError):
        ix.one_hot(df, "t", max_values=1)
    assert rows(ix.mean_impute(df, ["v"]), "id", "v") == [(1, 1.0), (2, 3.0), (3, 5.0)]
    ru = ix.round_upper(df.withColumn("v", F.col("v") / 3), ["v"], "t")
    assert rows(ru, "t", "v")[0] == ("A", None)


def test_joins_tags_suffixes_means_positions(spark):
    w = spark.createDataFrame([("a", D(2024, 1, 1), 1.0), ("a", D(2024, 1, 2), 2.0)],
                              "location string, timestamp date, value double")
    c = spark.createDataFrame([(D(2024, 1, 1), 10.0)], "timestamp date, value double")
    j = jn.left_join_tagged(w, c, ["timestamp"])
    assert rows(j, "timestamp", "value_water", "value_climate", "data_source") == [
        (D(2024, 1, 1), 1.0, 10.0, "water_climate_combined"), (D(2024, 1, 2), 2.0, None, "water_only")]
    empty = c.limit(0)
    assert {r["data_source"] for r in jn.left_join_tagged(w, empty, ["timestamp"]).collect()} == {"water_only"}
    m = jn.attach_means(w, c.withColumnRenamed("value", "rain"), ["rain"])
    assert {r["rain_climate"] for r in m.collect()} == {10.0}
    a = spark.createDataFrame([(D(2024, 1, i), float(i)) for i in range(1, 4)], "da date, x double").withColumn("p", F.lit(1))
    b = spark.createDataFrame([(D(2025, 1, i), float(i)) for i in range(1, 3)], "db date, y double").withColumn("q", F.lit(1))
    z = jn.zip_by_position(a, b, ["da"], ["db"], "p", "q")
    assert rows(z, "row_pos", "x", "y") == [(0, 1.0, 1.0), (1, 2.0, 2.0), (2, 3.0, None)]


def test_union_by_name_and_variants(spark):
    a = spark.createDataFrame([(1, 2.0)], "id int, x double")
    b = spark.createDataFrame([(2, 3.0)], "id int, y double")
    u = jn.union_by_name([a, b])
    assert rows(u, "id", "x", "y") == [(1, 2.0, None), (2, None, 3.0)]
    v = jn.union_variants(a, a)
    assert sorted(r["data_type"] for r in v.collect()) == ["cleaned", "normalized"]
    assert jn.union_variants(a, None).first()["data_type"] == "cleaned_only"


def test_sequence_and_scaling_metadata(spark):
    df = spark.createDataFrame([("b", D(2024, 1, 1), "cleaned", 1.0), ("a", D(2024, 1, 2), "normalized", 0.5),
                                ("a", D(2024, 1, 2), "cleaned", 2.0)],
                               "location string, timestamp date, data_type string, v double")
    s = sc.scaling_metadata(sc.sequence_metadata(df))
    got = [(r["location"], r["data_type"], r["sequence_id"], r["total_sequences"]) for r in s.orderBy("sequence_id").collect()]
    assert got == [("a", "cleaned", 0, 3), ("a", "normalized", 1, 3), ("b", "cleaned", 2, 3)]
    r = s.first()
    assert r["numeric_columns_count"] == 4 and r["scaling_method"] == "MinMaxScaler_0_to_1"
    assert r["window_size_recommended"] == 30 and r["sliding_window_ready"] is True


def test_profiles(spark):
    df = spark.createDataFrame([(1.0, None, "a"), (2.0, 1.0, "a"), (4.0, 2.0, "b"), (None, 3.0, None)],
                               "x double, y double, location string")
    npf = {r["column"]: (r["non_null"], r["nulls"]) for r in pf.null_profile(df).collect()}
    assert npf == {"x": (3, 1), "y": (3, 1), "location": (3, 1)}
    mp = {r["column"]: r["missing_pct"] for r in pf.missing_profile(df).collect()}
    assert mp == {"x": 25.0, "y": 25.0, "location": 25.0}
    d = {r["column"]: r for r in pf.describe(df, ["x", "y"]).collect()}
    assert d["x"]["count"] == 3 and d["x"]["p50"] == 2.0 and d["x"]["p25"] == 1.5 and d["x"]["max"] == 4.0
    assert math.isclose(d["x"]["std"], np.std([1.0, 2.0, 4.0], ddof=1))
    a = pf.avg_records_per_location(df).first()
    assert (a["n_records"], a["n_locations"], a["avg_records"]) == (4, 2, 2.0)
    c = [(r["location"], r["records"]) for r in pf.location_counts(df).collect()]
    assert c[0] == ("a", 2)


def test_corr_pairwise_complete_and_constant(spark):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(200, 3))
    data[:, 1] += data[:, 0]
    rows_ = [tuple(None if (i % 11 == 0 and j == 1) else float(v) for j, v in enumerate(r)) + (1.0,)
             for i, r in enumerate(data)]
    df = spark.createDataFrame(rows_, "a double, b double, c double, k double")
    got = {(r["col_a"], r["col_b"]): r["r"] for r in pf.corr_matrix(df, ["a", "b", "c", "k"]).collect()}
    import pandas as pd
    exp = pd.DataFrame(rows_, columns=["a", "b", "c", "k"]).astype(float).corr()
    for p in ["a", "b", "c"]:
        for q in ["a", "b", "c"]:
            assert math.isclose(got[(p, q)], exp.loc[p, q], rel_tol=1e-9, abs_tol=1e-12)
    assert got[("a", "k")] is None and got[("k", "k")] is None
    top = pf.top_correlations(pf.corr_matrix(df, ["a", "b", "c"]), ["a", "b", "c"], 1).first()
    assert (top["col_a"], top["col_b"]) == ("a", "b")


def test_histogram_and_box(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(31)] + [("a", 100.0)], "location string, x double")
    h = pf.histogram(df, "x", 30)
    assert sum(r["count"] for r in h.collect()) == 32
    assert h.where("bin = 29").first()["count"] == 1
    b = pf.box_stats(df, "location", "x").first()
    assert (b["min"], b["median"], b["max"], b["outliers"]) == (0.0, 15.5, 100.0, 1)


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(11)
    vals = np.concatenate([rng.exponential(size=400), np.full(100, 0.5)])
    df = spark.createDataFrame([("g" + str(i % 3), float(v)) for i, v in enumerate(vals)], "g string, x double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r["g"]: r["q"] for r in exact_quantiles(df, ["g"], "x", probs).collect()}
    for k in range(3):
        exp = np.quantile(vals[k::3], probs)
        assert np.allclose(got["g" + str(k)], exp, rtol=0, atol=1e-12)


def test_regression_metrics_and_best(spark):
    df = spark.createDataFrame([("m1", 1.0, 1.5), ("m1", 2.0, 2.0), ("m2", 1.0, 1.0), ("m2", 2.0, 2.0)],
                               "model string, y double, prediction double")
    m = {r["model"]: r for r in pf.regression_metrics(df).collect()}
    assert math.isclose(m["m1"]["mse"], 0.125) and math.isclose(m["m1"]["mae"], 0.25)
    assert math.isclose(m["m1"]["r2"], 1 - 0.25 / 0.5) and m["m2"]["r2"] == 1.0
    assert pf.pick_best(pf.regression_metrics(df), "mse").first()["best_model"] == "m2"
    assert pf.pick_best(pf.regression_metrics(df), "r2").first()["best_model"] == "m2"
    aliased = pf.regression_metrics(df).withColumnRenamed("mse", "mean_squared_error")
    assert pf.pick_best(aliased, "mse").first()["best_model"] == "m2"


def test_model_reuse_or_retrain(spark, tmp_path):
    from limnos.operators import forecast as fc
    from pyspark.ml.linalg import Vectors
    df = spark.createDataFrame([(Vectors.dense([float(i)]), 2.0 * i) for i in range(20)], ["features", "y"])
    calls = []

    def build():
        calls.append(1)
        return fc.fit_final(df, "linear", {}, validation_col=None)
    path = str(tmp_path / "m")
    m1 = fc.save_or_reuse(path, build, mode="reuse")     # nothing saved yet -> train
    m2 = fc.save_or_reuse(path, build, mode="reuse")     # loads
    m3 = fc.save_or_reuse(path, build, mode="replace")   # retrains
    assert len(calls) == 2
    p1, p2 = (m.transform(df).agg(F.sum("prediction")).first()[0] for m in (m1, m2))
    assert math.isclose(p1, p2) and m3 is not None


def test_streaming_daily_means(spark, tmp_path):
    from limnos.streaming import daily as sd
    src = tmp_path / "src"
    data = [(1, dt.datetime(2024, 1, 1, 3), 7, "x", 2.0, "{}"), (2, dt.datetime(2024, 1, 1, 9), 7, "x", 4.0, "{}"),
            (3, dt.datetime(2024, 1, 2, 1), 7, "x", None, "{}"), (4, dt.datetime(2024, 1, 2, 1), 8, "x", 1.0, "{}")]
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame(data[:2], schema).write.parquet(str(src / "a"))
    spark.createDataFrame(data[2:], schema).write.parquet(str(src / "b"))
    s = sd.daily_stream(spark, str(src) + "/*", schema, "user_id", "ts", ["value"], max_files_per_trigger=1)
    sd.run_to_table(s, str(tmp_path / "t"), str(tmp_path / "c"))
    got = rows(sd.current_means(spark, str(tmp_path / "t"), ["value"]), "location", "timestamp", "value")
    assert got == [("7", D(2024, 1, 1), 3.0), ("7", D(2024, 1, 2), None), ("8", D(2024, 1, 2), 1.0)]


def test_streaming_keeps_late_days(spark, tmp_path):
    from limnos.streaming import daily as sd
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    src = tmp_path / "src"
    spark.createDataFrame([(1, dt.datetime(2024, 1, 10, 8), 1, "x", 5.0, "{}")], schema).write.parquet(str(src / "a"))
    spark.createDataFrame([(2, dt.datetime(2024, 1, 1, 8), 1, "x", 7.0, "{}")], schema).write.parquet(str(src / "b"))
    s = sd.daily_stream(spark, str(src) + "/*", schema, "user_id", "ts", ["value"],
                        max_files_per_trigger=1)
    sd.run_to_table(s, str(tmp_path / "t"), str(tmp_path / "c"))
    got = rows(sd.current_means(spark, str(tmp_path / "t"), ["value"]), "location", "timestamp", "value")
    assert got == [("1", D(2024, 1, 1), 7.0), ("1", D(2024, 1, 10), 5.0)]     # in whatever order they arrive


def test_exact_quantiles_with_ties_and_null_keys(spark):
    import numpy as np
    values = [5.0] * 900 + [float(i) for i in range(10)] * 7 + [None]
    df = spark.createDataFrame([(None if i % 3 else "a", v) for i, v in enumerate(values)], "g string, x double")
    got = {r["g"]: (r["n"], r["q"]) for r in exact_quantiles(df, ["g"], "x", [0.0, 0.03, 0.5, 0.97, 1.0]).collect()}
    for g in ("a", None):
        x = [v for i, v in enumerate(values) if v is not None and (None if i % 3 else "a") == g]
        assert got[g][0] == len(x) and np.allclose(got[g][1], np.quantile(x, [0.0, 0.03, 0.5, 0.97, 1.0]))
    plan = exact_quantiles(df, ["g"], "x", [0.5])._jdf.queryExecution().toString()
    assert "collect_list" not in plan


def test_dates_and_nan_as_text(spark):
    from limnos.operators.schema import canonical_time, coerce_numeric
    texts = ["2020-01-15", "1/15/2020", "15-Jan-2020", "Jan 15, 2020", "2020/01/15", "20200115", "1/15/2020 13:05", "soon", None]
    got = [r[0] for r in canonical_time(spark.createDataFrame([(t,) for t in texts], "Date string"), as_date=True).collect()]
    assert got == [D(2020, 1, 15)] * 7 + [None, None]
    df = coerce_numeric(spark.createDataFrame([("NaN", float("nan")), ("2.0", 2.0), ("x", None)], "a string, b double"))
    assert df.agg(F.avg("a"), F.avg("b")).first() == (2.0, 2.0)


def test_rows_without_location_are_numbered(spark):
    from limnos.operators import timeseries as ts
    df = spark.createDataFrame([(None, D(2024, 1, i + 1), i) for i in range(9)] + [("a", D(2024, 1, 1), 0)], "location string, timestamp date, v int")
    got = rows(ts.number_rows_global(df, "location", ["timestamp"]), "rn")
    assert got == [(i,) for i in range(10)]


def test_free_text_column_names(spark):
    names = ["Temp, surface", "St. Ann's", "a`b"]
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (2.0, 1.0, 5.0), (3.0, 0.5, 4.0)], "x double, y double, z double").toDF(*names)
    assert {r["column"] for r in pf.describe(df, names).collect()} == set(names)
    assert pf.corr_matrix(df, names).count() == 9


def test_exact_quantiles_of_more_rows_than_the_sketch_has_steps(spark):
    from limnos.operators import quantiles as qt
    rng = np.random.default_rng(11)
    big = 40 * qt.ACCURACY
    values = {"flat": rng.random(big), "ties": rng.integers(0, 7, big).astype(float), "tail": np.exp(rng.normal(0, 6, big)),
              None: np.concatenate([np.zeros(big // 2), rng.normal(0, 1, big // 4)]), "edge": rng.random(qt.ACCURACY + 1), "few": rng.random(5), "one": np.array([2.5])}
    data = pd.concat([pd.DataFrame({"g": [g] * len(x), "x": x}) for g, x in values.items()])
    df = spark.createDataFrame(data, "g string, x double").unionByName(spark.createDataFrame([("flat", None), ("empty", None)], "g string, x double"))
    probs = [0.0, 0.001, 0.25, 0.5, 0.75, 0.9999, 1.0]
    got = {r["g"]: (r["n"], r["q"]) for r in exact_quantiles(df.repartition(9), ["g"], "x", probs).collect()}
    assert set(got) == set(values)
    for g, x in values.items():
        assert got[g][0] == len(x) and np.allclose(got[g][1], np.quantile(x, probs), rtol=1e-12), g


def test_exact_quantiles_when_the_sketch_misses(spark, monkeypatch):
    """Brackets that miss their ranks are found out and all values are ranked."""
    from limnos.operators import quantiles as qt
    monkeypatch.setattr(qt, "_REACH", -200)
    x = np.random.default_rng(4).random(30000)
    df = spark.createDataFrame(pd.DataFrame({"g": 1, "x": x}))
    assert np.allclose(exact_quantiles(df, ["g"], "x", [0.25, 0.5]).first()["q"], np.quantile(x, [0.25, 0.5]), rtol=1e-12)


def test_exact_quantiles_shuffle_little(spark):
    """Only brackets' values are range-sorted: far fewer than the rows."""
    from limnos.operators import quantiles as qt
    seen = {}
    write = qt.materialize

    def spy(df, name="stage"):
        seen[name] = write(df, name)
        return seen[name]
    qt.materialize = spy
    try:
        n = 200000
        exact_quantiles(spark.range(n).select(F.lit("k").alias("g"), F.xxhash64("id").alias("x")), ["g"], "x", [0.25, 0.5, 0.75]).collect()
    finally:
        qt.materialize = write
    assert seen["value_counts"].count() < n * 3 * 2 * 6 / qt.ACCURACY and seen["brackets"].count() == 1
