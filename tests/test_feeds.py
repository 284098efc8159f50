"""Elected date formats, cleaning with report and quarantine, JSON documents
without a schema, on small hand-made feeds."""
import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from limnos.operators.dates import FORMATS, date_report
from limnos.operators.schema import canonical_time
from limnos.plans.cleaning import clean_raw, full_report
from limnos.sources import documents as docs
from tests.conftest import rows

D = dt.date


def column(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "Date string")


def read(spark, texts):
    return [r[0] for r in canonical_time(column(spark, texts).coalesce(1), as_date=True, elect=True).collect()]


@pytest.mark.parametrize("texts, want", [
    (["31/01/2020", "05/02/2020", "5/3/2020 14:30"], [D(2020, 1, 31), D(2020, 2, 5), D(2020, 3, 5)]),
    (["01/31/2020", "05/02/2020"], [D(2020, 1, 31), D(2020, 5, 2)]),
    (["05/02/2020", "06/03/2020"], [D(2020, 5, 2), D(2020, 6, 3)]),           # nothing settles it: month first
    (["15.01.2020", "2.1.2020"], [D(2020, 1, 15), D(2020, 1, 2)]),
    (["01-15-2020", "02-01-2020"], [D(2020, 1, 15), D(2020, 2, 1)]),
    (["15-01-2020", "02-01-2020"], [D(2020, 1, 15), D(2020, 1, 2)]),
    (["2020-01-15", "2020-01-16T10:00:00", " 2020-01-17 ", "", None], [D(2020, 1, 15), D(2020, 1, 16), D(2020, 1, 17), None, None]),
    (["15 Jan 2020", "1 Feb 2020"], [D(2020, 1, 15), D(2020, 2, 1)]),
    (["January 5, 2020"], [D(2020, 1, 5)]),
    (["20200115"], [D(2020, 1, 15)]),
    (["1/15/20"], [D(2020, 1, 15)]),
    (["1/15/2020 1:05 PM"], [D(2020, 1, 15)]),
    (["31/01/2020", "30/01/2020", "2020-01-29", "soon"], [D(2020, 1, 31), D(2020, 1, 30), None, None]),  # one format a column
    (["soon", None], [None, None]),
    ([], []),
])
def test_elected_format(spark, texts, want):
    assert read(spark, texts) == want


def test_date_report_counts_rows_and_texts(spark):
    df = spark.createDataFrame([("31/01/2020", "2020-01-01", "x"), ("31/01/2020", None, "y"), ("01/31/2020", " ", "x"), ("30/01/2020", "2020-01-02", None), ("never", "2020-01-03", None)],
                               "a string, `b.c` string, d string")
    got = {r["column"]: r for r in date_report(df, df.columns).collect()}
    a, b, d = got["a"], got["b.c"], got["d"]
    assert (a["format"], a["n_texts"], a["n_rows"], a["parsed_texts"], a["parsed_rows"], a["rejected_rows"], a["mixed"]) == (FORMATS[2], 4, 5, 2, 3, 2, True)
    assert (b["format"], b["n_rows"], b["rejected_rows"], b["mixed"]) == ("iso", 3, 0, False)
    assert (d["format"], d["parsed_rows"], d["rejected_rows"], d["mixed"]) == (None, 0, 3, False)
    plan = canonical_time(column(spark, ["x"]), elect=True)._jdf.queryExecution().toString()
    assert "Subquery" in plan  # elected in the same plan


def feed(spark):
    cells = [("A", "01/02/2020", "1.5", "2", 1), ("A", "13/02/2020", "n/a", "-999", 2), ("A", "soon", "3", "", 3), ("B", "14/02/2020", "7", "x", None),
             (None, "15/02/2020", "8", "9", 4), (None, None, "8", "9", 4), ("C", "never", "1", "1", 1), ("B", "16/02/2020", "NaN", None, 5)]
    return spark.createDataFrame(cells, "` Site` string, `Date ` string, ` pH` string, flow string, n int")


def test_clean_raw_accounts_for_every_row(spark):
    c = clean_raw(feed(spark), sentinels=[-999])
    assert c.totals == {"rows": 8, "accepted": 4, "without_time": 3, "without_location": 2, "cells_converted": 11, "cells_refused": 3}
    assert c.measures == ["pH", "flow", "n"] and c.table.columns == ["location", "timestamp", "pH", "flow", "n"]
    assert rows(c.table, "location", "pH", "flow", "n") == [("A", 1.5, 2.0, 1.0), ("A", None, None, 2.0), ("B", 7.0, None, None), ("B", None, None, 5.0)]
    bad = rows(c.quarantine, "reason", "location", "raw")
    assert [(r, x) for r, x, _ in bad] == [("location", None), ("time", "A"), ("time", "C"), ("time,location", None)]
    assert json.loads(bad[1][2]) == {"Site": "A", "Date": "soon", "pH": "3", "flow": "", "n": 3}


def test_full_report(spark):
    got = {r["location"]: r for r in full_report(clean_raw(feed(spark))).collect()}
    a, b, c, none = got["A"], got["B"], got["C"], got[None]
    assert (a["rows"], a["rejected"], a["cells_refused"], a["dropped_columns"]) == (3, 1, 1, [])
    assert (b["rows"], b["rejected"], b["cells_refused"], b["dropped_columns"]) == (2, 0, 2, ["flow"])
    assert (c["rows"], c["rejected"], c["rows_left"], c["dropped_columns"]) == (1, 1, 0, ["flow", "n", "pH"])
    assert (none["rows"], none["rejected"], none["gaps"]) == (2, 2, 0)
    # A: 13 days of three measures, of which 2 + 2 (-999 counts) + 1... readings are there on two days
    assert a["gaps"] == 13 * 3 - 5 and a["filled"] == a["gaps"] and a["rows_left"] + a["outliers_removed"] == 13


def test_clean_raw_without_time_or_place(spark):
    c = clean_raw(spark.createDataFrame([("1", "x"), ("2", None)], "a string, b string"))
    assert c.totals["accepted"] == 2 and c.totals["without_time"] == 0 and c.totals["cells_refused"] == 1
    assert clean_raw(spark.createDataFrame([], "Site string, Date string, v string")).totals["rows"] == 0


COMPARISON = {"cnn": {"hyperparameters": {"filters": 96, "dropout": 0.1, "deep": {"a": [1, 2]}, "on": True}, "batch_size": 32, "metrics": {"mse": 0.15, "r2": None}},
              "lstm": {"metrics": {"mse": 0.2}}, "note": "text", "odd": {"metrics": 5}, "best_model": "cnn"}


def test_comparison_document_of_any_layout(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps(COMPARISON, indent=2))
    (tmp_path / "bad.json").write_text("{ not json")
    (tmp_path / "list.json").write_text("[1, 2]")
    read = docs.read_documents(spark, str(tmp_path), glob="*.json")
    assert read.count() == 3 and read.where("doc IS NULL").count() == 1
    got = rows(docs.flatten_comparison(read), "model", "section", "name", "value", "number")
    assert got == [("cnn", "hyperparameters", "deep", '{"a":[1,2]}', None), ("cnn", "hyperparameters", "dropout", "0.1", 0.1), ("cnn", "hyperparameters", "filters", "96", 96.0),
                   ("cnn", "hyperparameters", "on", "true", None), ("cnn", "metrics", "mse", "0.15", 0.15), ("cnn", "metrics", "r2", None, None),
                   ("cnn", "settings", "batch_size", "32", 32.0), ("lstm", "metrics", "mse", "0.2", 0.2), ("odd", "settings", "metrics", "5", 5.0)]
    assert rows(docs.best_model(read), "best_model") == [("cnn",)]


def test_model_documents_are_written_as_they_are_read(spark, tmp_path):
    results = spark.createDataFrame([("b", '{"u":1}', 16, {"mse": 0.2}), ("a", '{"x":"q\\"q","u":2.5}', None, {"mse": 0.2, "mae": None})],
                                    "model string, hyperparameters string, batch_size int, metrics map<string,double>")
    docs.write_model_documents(results, str(tmp_path))
    read = docs.read_documents(spark, str(tmp_path / "model_comparison"), per_line=True)
    assert rows(docs.best_model(read), "best_model") == [("a",)]  # of equals the first by name
    flat = {(m, n): v for m, n, v in rows(docs.flatten_comparison(read), "model", "name", "value")}
    assert flat[("a", "x")] == 'q"q' and flat[("b", "u")] == "1" and flat[("b", "batch_size")] == "16" and flat[("a", "mae")] is None
    single = docs.read_documents(spark, str(tmp_path / "best_params"), glob="part-*", per_line=True)
    assert rows(single.select(F.try_variant_get("doc", "$.best_batch_size", "int").alias("n")), "n") == [(16,), (None,)]


def trial(tid, status, metrics, score=None, best=0):
    seen = {m: {"direction": d, "observations": [{"value": v, "step": s} for s, v in o]} for m, (d, o) in metrics.items()}
    return {"trial_id": tid, "status": status, "score": score, "best_step": best, "message": None if status == "COMPLETED" else "Traceback ...",
            "hyperparameters": {"space": [{"class_name": "Int"}], "values": {"units": 64, "flag": False}}, "metrics": {"metrics": seen}}


def test_trial_observations(spark, tmp_path):
    made = [trial("00", "COMPLETED", {"val_loss": ("min", [(0, [0.5]), (1, [0.2]), (2, [0.2]), (3, [0.9])]), "r2": ("max", [(0, [0.1, 0.3]), (1, [0.2, 0.2]), (2, [None])])}, 0.2, 1),
            trial("01", "FAILED", {}), trial("02", "COMPLETED", {"val_loss": ("min", [(7, [0.4])])}, 0.4, 7)]
    for d in made:
        folder = tmp_path / "proj" / f"trial_{d['trial_id']}"
        folder.mkdir(parents=True)
        (folder / "trial.json").write_text(json.dumps(d, indent=1))
    (tmp_path / "proj" / "oracle.json").write_text("{}")
    read = docs.read_documents(spark, str(tmp_path), glob="trial.json")
    t = {r["trial_id"]: r for r in docs.trials(read).collect()}
    assert {k: v["status"] for k, v in t.items()} == {"00": "COMPLETED", "01": "FAILED", "02": "COMPLETED"}
    assert t["00"]["values"] == {"units": "64", "flag": "false"} and t["01"]["message"].startswith("Traceback") and t["02"]["best_step"] == 7
    assert docs.observations(read).count() == 4 + 5 + 1
    best = rows(docs.best_steps(docs.observations(read)), "trial_id", "metric", "n_steps", "best_step", "best_value")
    assert best == [("00", "r2", 2, 0, 0.2), ("00", "val_loss", 4, 1, 0.2), ("02", "val_loss", 1, 7, 0.4)]


def test_box_stats_counts_outliers_without_location(spark):
    from limnos.operators import profile as pf
    data = [(None, float(i)) for i in range(20)] + [(None, 500.0), ("a", 1.0), ("a", 2.0)]
    got = {r["location"]: r["outliers"] for r in pf.box_stats(spark.createDataFrame(data, "location string, v double"), "location", "v").collect()}
    assert got == {None: 1, "a": 0}


def test_nan_names_and_number_order(spark):
    from limnos.operators import timeseries as ts
    day = D(2024, 1, 1)
    df = spark.createDataFrame([("a", day, float("nan")), ("a", day, 4.0)], "location string, t date, v double")
    assert ts.daily_resample(df, "location", "t", ["v"]).first()["v"] == 4.0
    names = ["St. Ann's", "a`b"]
    wide = spark.createDataFrame([(1.0, 5.0), (3.0, 9.0)], "x double, y double").toDF(*names)
    stats = ts.fit_minmax(wide, names)
    scaled = ts.apply_minmax(wide, stats, names)
    assert [tuple(r) for r in ts.invert_minmax(scaled, stats, names).orderBy("`St. Ann's`").collect()] == [(1.0, 5.0), (3.0, 9.0)]
    n = spark.createDataFrame([(i * 3, float(i)) for i in range(50)], "k long, v double").repartition(5)
    assert rows(ts.number_rows(n, None, ["k"]), "k", "rn") == [(i * 3, i) for i in range(50)]
    split = ts.time_split(n, None, "k")
    assert rows(split.where("split = 'test'"), "k") == [(i * 3,) for i in range(40, 50)]


def test_validation_tail_of_each_location(spark):
    from limnos.operators import timeseries as ts
    data = [(loc, D(2024, 1, i + 1)) for loc in "abcde" for i in range(11)]
    v = ts.validation_tail(spark.createDataFrame(data, "location string, timestamp date"), "location", ["timestamp"], each=True)
    got = rows(v.where("is_validation"), "location", "timestamp")
    assert got == [(loc, D(2024, 1, d)) for loc in "abcde" for d in (9, 10, 11)]


def test_read_csv_raises_what_is_no_missing_path(spark, tmp_path):
    from limnos.sources import files as io
    assert io.read_csv(spark, str(tmp_path / "nowhere"), "a string") is None
    (tmp_path / "x.csv").write_text("a\n1\n")
    with pytest.raises(Exception):
        io.read_csv(spark, str(tmp_path / "x.csv"), "a nonsense type")
