"""Edge rows of the time-series operators (grid, fill, outliers, scaling, windows)."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from limnos.operators import timeseries as ts
from tests.conftest import rows

D = dt.date


def frame(spark, data, schema="location string, ts timestamp_ntz, v double"):
    return spark.createDataFrame(data, schema)


def t(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


def test_daily_grid_means_duplicates_and_expands_gaps(spark):
    df = frame(spark, [("a", t(1), 2.0), ("a", t(1, 5), 4.0), ("a", t(4), 9.0)])
    g = ts.daily_resample(df, "location", "ts", ["v"])
    assert rows(g, "timestamp", "v") == [(D(2024, 1, 1), 3.0), (D(2024, 1, 2), None), (D(2024, 1, 3), None),
                                         (D(2024, 1, 4), 9.0)]
    f = ts.ffill_bfill(g, "location", "timestamp", ["v"])
    assert [r[1] for r in rows(f, "timestamp", "v")] == [3.0, 3.0, 3.0, 9.0]


def test_daily_grid_single_day_and_null_time(spark):
    df = frame(spark, [("a", t(5), 1.0), ("a", None, 7.0), ("b", t(2), 2.0), ("b", t(3), None)])
    g = ts.daily_resample(df, "location", "ts", ["v"])
    assert rows(g, "location", "timestamp", "v") == [("a", D(2024, 1, 5), 1.0), ("b", D(2024, 1, 2), 2.0),
                                                     ("b", D(2024, 1, 3), None)]


@pytest.mark.parametrize("bucketed", [False, True])
def test_fill_leading_and_trailing_nulls(spark, bucketed):
    vals = [None, 1.0, None, 3.0, None]
    df = spark.createDataFrame([("a", D(2024, 1, 31) + dt.timedelta(days=i * 20), v) for i, v in enumerate(vals)],
                               "location string, timestamp date, v double")
    b = F.trunc("timestamp", "month") if bucketed else None
    f = ts.ffill_bfill(df, "location", "timestamp", ["v"], bucket=b)
    assert [r[1] for r in rows(f, "timestamp", "v")] == [1.0, 1.0, 1.0, 3.0, 3.0]


def test_fill_global_series_two_phase_equals_simple(spark):
    import random
    rnd = random.Random(7)
    data = [(D(2023, 1, 1) + dt.timedelta(days=i), None if rnd.random() < 0.4 else float(i)) for i in range(400)]
    data[0] = (data[0][0], None)
    df = spark.createDataFrame(data, "timestamp date, v double")
    got = rows(ts.ffill_bfill(df, None, "timestamp", ["v"]), "timestamp", "v")
    # reference: plain python ffill then bfill
    vals = [v for _, v in data]
    last = None
    ff = []
    for v in vals:
        last = v if v is not None else last
        ff.append(last)
    first = next(v for v in ff if v is not None)
    exp = [v if v is not None else first for v in ff]
    assert [v for _, v in got] == exp


def test_fill_all_null_series_stays_null(spark):
    df = spark.createDataFrame([("a", D(2024, 1, 1), None), ("a", D(2024, 1, 2), None)],
                               "location string, timestamp date, v double")
    assert [r[0] for r in rows(ts.ffill_bfill(df, "location", "timestamp", ["v"]), "v")] == [None, None]


def test_zscore_constant_location_keep_vs_drop(spark):
    data = [("c", D(2024, 1, i), 5.0) for i in range(1, 6)]
    data += [("x", D(2024, 1, i), float(i)) for i in range(1, 21)] + [("x", D(2024, 1, 21), 1000.0)]
    df = spark.createDataFrame(data, "location string, timestamp date, v double")
    kept = ts.zscore_filter(df, "location", ["v"], constant="keep")
    dropped = ts.zscore_filter(df, "location", ["v"], constant="drop")
    assert kept.where("location = 'c'").count() == 5
    assert dropped.where("location = 'c'").count() == 0
    assert kept.where("location = 'x'").count() == 20        # the 1000 day is an outlier
    scaled = ts.minmax_per_key(kept, "location", ["v"])
    assert {r[0] for r in rows(scaled.where("location = 'c'"), "v")} == {0.0}
    vals = [r[0] for r in rows(scaled, "v")]
    assert min(vals) >= 0.0 and max(vals) <= 1.0


def test_zscore_null_measure_does_not_vote(spark):
    data = [("a", D(2024, 1, i), float(i), None) for i in range(1, 11)]
    df = spark.createDataFrame(data, "location string, timestamp date, v double, w double")
    assert ts.zscore_filter(df, "location", ["v", "w"]).count() == 10


@pytest.mark.parametrize("n,expected", [(12, 0), (13, 1), (0, 0), (20, 8)])
def test_window_counts(spark, n, expected):
    data = [("a", D(2024, 1, 1) + dt.timedelta(days=i), float(i)) for i in range(n)]
    df = spark.createDataFrame(data, "location string, timestamp date, v double")
    w = ts.sliding_windows(df, "location", "timestamp", ["v"], "v", 12)
    assert w.count() == expected
    if expected:
        r = w.orderBy("timestamp").first()
        assert [s[0] for s in r["x"]] == [float(i) for i in range(12)] and r["y"] == 12.0


def test_windows_blocked_equal_per_key(spark):
    data = [(k, D(2024, 1, 1) + dt.timedelta(days=i), float(i * (j + 1)))
            for j, k in enumerate(["a", "b"]) for i in range(50)]
    df = spark.createDataFrame(data, "location string, timestamp date, v double")
    a = ts.sliding_windows(df, "location", "timestamp", ["v"], "v", 12)
    b = ts.sliding_windows(df, "location", "timestamp", ["v"], "v", 12, block=16)
    key = ("location", "timestamp", "sample_pos", "y", "x")
    assert rows(a, *key) == rows(b, *key)


def test_number_rows_two_phase_matches_row_number(spark):
    data = [(k, D(2023, 1, 1) + dt.timedelta(days=i)) for k in ["a", "b", "c"] for i in range(0, 300, 3)]
    df = spark.createDataFrame(data, "location string, timestamp date")
    g = ts.number_rows_global(df, "location", ["timestamp"], "rn", total="n")
    got = [(r["location"], r["timestamp"], r["rn"]) for r in g.orderBy("rn").collect()]
    exp = sorted(data)
    assert [(a, b) for a, b, _ in got] == exp
    assert [c for _, _, c in got] == list(range(len(exp)))
    assert {r["n"] for r in g.select("n").collect()} == {len(exp)}
    bucketed = ts.number_rows(df, "location", ["timestamp"], "rn", bucket=F.trunc("timestamp", "month"))
    plain = ts.number_rows(df, "location", ["timestamp"], "rn")
    assert rows(bucketed, "location", "timestamp", "rn") == rows(plain, "location", "timestamp", "rn")


def test_split_is_deterministic_disjoint_complete(spark):
    data = [(f"l{i % 7}", D(2024, 1, 1) + dt.timedelta(days=i)) for i in range(500)]
    df = spark.createDataFrame(data, "location string, timestamp date")
    s1 = rows(ts.hash_split(df, ["location", "timestamp"]), "location", "timestamp", "split")
    s2 = rows(ts.hash_split(df.repartition(7), ["location", "timestamp"]), "location", "timestamp", "split")
    assert s1 == s2 and len(s1) == 500
    share = sum(1 for r in s1 if r[2] == "test") / 500
    assert 0.12 < share < 0.28
    tsplit = ts.time_split(df, "location", "timestamp")
    last = tsplit.groupBy("location").agg(F.max(F.when(F.col("split") == "train", F.col("timestamp"))).alias("a"),
                                          F.min(F.when(F.col("split") == "test", F.col("timestamp"))).alias("b"))
    assert all(r["a"] < r["b"] for r in last.collect())


def test_validation_tail_is_last_fifth(spark):
    data = [(f"l{i // 10}", D(2024, 1, 1) + dt.timedelta(days=i % 10)) for i in range(100)]
    df = spark.createDataFrame(data, "location string, timestamp date")
    v = ts.validation_tail(df, "location", ["timestamp"])
    flagged = sorted((r["location"], r["timestamp"]) for r in v.where("is_validation").collect())
    assert flagged == sorted(data)[80:]


def test_minmax_fit_apply_invert_roundtrip(spark):
    df = spark.createDataFrame([(float(i), float(i * i)) for i in range(10)], "a double, b double")
    stats = ts.fit_minmax(df, ["a", "b"])
    scaled = ts.apply_minmax(df, stats, ["a", "b"], suffix="_s")
    assert {(r["a_s"] >= 0 and r["a_s"] <= 1) for r in scaled.collect()} == {True}
    back = ts.invert_minmax(scaled.select(F.col("a_s").alias("a"), F.col("b_s").alias("b")), stats, ["a", "b"])
    assert sorted(round(r["a"], 9) for r in back.collect()) == [float(i) for i in range(10)]


def test_shape_fit_pad_and_truncate(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],)], "a array<double>")
    r = df.select(ts.fit_shape(F.col("a"), 2, 5).alias("p"), ts.fit_shape(F.col("a"), 1, 2).alias("t")).first()
    assert r["p"] == [[1.0, 2.0, 3.0, 0.0, 0.0]] * 2 and r["t"] == [[1.0, 2.0]]
    s = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0]],)], "s array<array<double>>")
    r = s.select(ts.fit_sequence(F.col("s"), 4, 3).alias("f"), ts.fit_sequence(F.col("s"), 1, 1).alias("g")).first()
    assert r["f"] == [[1.0, 2.0, 0.0], [3.0, 4.0, 0.0], [3.0, 4.0, 0.0], [3.0, 4.0, 0.0]]
    assert r["g"] == [[1.0]]


def test_month_end_dates_and_rollup(spark):
    df = spark.createDataFrame([("a", dt.datetime(2024, 1, 15), 1.0), ("a", dt.datetime(2024, 1, 20), 3.0)],
                               "location string, ts timestamp_ntz, v double")
    m = ts.month_end_dates(df, "location", "ts", 3)
    assert [r["forecast_date"] for r in m.orderBy("step").collect()] == [D(2024, 2, 29), D(2024, 3, 31), D(2024, 4, 30)]
    r = ts.period_rollup(df, "location", "ts", ["v"], "month").first()
    assert (r["period"], r["n"], r["avg_v"], r["min_v"], r["max_v"]) == (D(2024, 1, 1), 2, 2.0, 1.0, 3.0)


def test_row_order_fill_bucketed_by_sequence(spark):
    vals = [None, None, 2.0, None, None, None, None, 5.0, None, None, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "sequence_id long, v double")
    f = ts.ffill_bfill(df, None, "sequence_id", ["v"], bucket=F.floor(F.col("sequence_id") / 3))
    assert [r[1] for r in rows(f, "sequence_id", "v")] == [2.0, 2.0, 2.0, 2.0, 2.0, 2.0, 2.0, 5.0, 5.0, 5.0, 5.0]


def test_part_offsets_range_split_equals_single(spark, monkeypatch):
    sizes = spark.range(0, 3000).select(F.format_string("p%05d", F.col("id")).alias("part"),
                                        (F.col("id") % 5 + 1).alias("n"))
    single = rows(ts.part_offsets(sizes, "part", "n", "total"), "part", "_poff", "total")
    monkeypatch.setattr(ts, "SINGLE_TASK_PARTS", 80)
    ranged = rows(ts.part_offsets(sizes, "part", "n", "total"), "part", "_poff", "total")
    assert single == ranged
    assert single[0][1] == 0 and single[-1][2] == sum(i % 5 + 1 for i in range(3000))


def test_unkeyed_fill_range_split_carry(spark, monkeypatch):
    import random
    rnd = random.Random(3)
    vals = [None if rnd.random() < 0.7 else float(i) for i in range(600)]
    vals[:5] = [None] * 5
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "seq long, v double")
    b = F.floor(F.col("seq") / 7)
    plain = rows(ts.ffill_bfill(df, None, "seq", ["v"], bucket=b), "seq", "v")
    monkeypatch.setattr(ts, "SINGLE_TASK_PARTS", 20)
    split = rows(ts.ffill_bfill(df, None, "seq", ["v"], bucket=b), "seq", "v")
    assert plain == split
    last, exp = None, []
    for v in vals:
        last = v if v is not None else last
        exp.append(last)
    head = next(v for v in exp if v is not None)
    assert [r[1] for r in plain] == [v if v is not None else head for v in exp]


def test_stats_join_method_equals_window(spark):
    data = [(k, D(2024, 1, 1) + dt.timedelta(days=i), float((i * 7 + j) % 11), float(i))
            for j, k in enumerate(["a", "b", "c"]) for i in range(40)]
    data.append(("a", D(2024, 3, 1), 500.0, 1.0))
    df = spark.createDataFrame(data, "location string, timestamp date, v double, w double")
    cols = ("location", "timestamp", "v", "w")
    for fn in (lambda m: ts.zscore_filter(df, "location", ["v", "w"], method=m),
               lambda m: ts.minmax_per_key(df, "location", ["v", "w"], method=m)):
        assert rows(fn("window"), *cols) == rows(fn("join"), *cols)


def test_join_tag(spark):
    from limnos.operators import joins as jn
    w = spark.createDataFrame([("a", D(2024, 1, 1), 1.0)], "location string, timestamp date, v double")
    c = spark.createDataFrame([(D(2024, 1, 1), 2.0)], "timestamp date, rain double")
    j = jn.left_join_tagged(w, c, ["timestamp"])
    assert rows(j, "v", "rain", "data_source") == [(1.0, 2.0, "water_climate_combined")]


def test_keyed_bucketed_numbering_range_split(spark, monkeypatch):
    data = [(k, i) for k in ["a", "b", "hot"] for i in range(300 if k == "hot" else 40)]
    df = spark.createDataFrame(data, "location string, seq long")
    plain = rows(ts.number_rows(df, "location", ["seq"], "rn"), "location", "seq", "rn")
    monkeypatch.setattr(ts, "SINGLE_TASK_PARTS", 8)
    split = rows(ts.number_rows(df, "location", ["seq"], "rn", bucket=F.floor(F.col("seq") / 5)),
                 "location", "seq", "rn")
    assert plain == split


def test_keyed_fill_range_split_carry(spark, monkeypatch):
    import random
    rnd = random.Random(5)
    data = []
    for k, n in [("a", 30), ("hot", 400), ("z", 25)]:
        for i in range(n):
            data.append((k, i, None if (rnd.random() < 0.75 or i < 3) else float(i)))
    df = spark.createDataFrame(data, "location string, seq long, v double")
    plain = rows(ts.ffill_bfill(df, "location", "seq", ["v"]), "location", "seq", "v")
    monkeypatch.setattr(ts, "SINGLE_TASK_PARTS", 12)
    split = rows(ts.ffill_bfill(df, "location", "seq", ["v"], bucket=F.floor(F.col("seq") / 4)),
                 "location", "seq", "v")
    assert plain == split
