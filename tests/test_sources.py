"""File sources and sinks on small hand-made files."""
import json

from pyspark.sql import functions as F

from limnos.sources import files as io


def test_read_trials_in_tuner_layout(spark, tmp_path):
    # two trial folders in the tuner's JSON layout: one completed, one failed
    for tid, status, score, msg in [("00", "COMPLETED", 0.15, None), ("01", "FAILED", None, "Traceback ...")]:
        d = tmp_path / "proj" / f"trial_{tid}"
        d.mkdir(parents=True)
        doc = {"trial_id": tid, "hyperparameters": {"space": [], "values": {"units": 64, "flag": False, "lr": 0.001}},
               "metrics": {"metrics": {"val_loss": {"direction": "min",
                                                    "observations": [{"value": [0.15], "step": 12}]}}},
               "score": score, "best_step": 12 if score else 0, "status": status, "message": msg}
        (d / "trial.json").write_text(json.dumps(doc, indent=2))
    (tmp_path / "proj" / "oracle.json").write_text("{}")
    t = io.read_trials(spark, str(tmp_path / "proj"))
    got = {r["trial_id"]: r for r in t.collect()}
    assert set(got) == {"00", "01"}
    assert got["00"]["status"] == "COMPLETED" and got["00"]["score"] == 0.15
    assert got["00"]["values"]["units"] == "64"
    assert got["01"]["status"] == "FAILED" and got["01"]["message"].startswith("Traceback")


def test_csv_scan_with_time_index_and_missing_path(spark, tmp_path):
    p = tmp_path / "w.csv"
    p.write_text("Date,Location,pH Level\n2024-01-01,A,7.1\nbad,A,n/a\n2024-01-03,B,6.9\n")
    df = io.read_csv_indexed(spark, str(p), "Date string, Location string, `pH Level` string")
    rows = sorted((str(r["timestamp"]), r["Location"]) for r in df.collect())
    assert rows == [("2024-01-01 00:00:00", "A"), ("2024-01-03 00:00:00", "B"), ("None", "A")]
    assert io.read_csv(spark, str(tmp_path / "missing.csv"), "a string") is None


def test_catalogue_lists_csv_only(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "location string, v int")
    io.write_table(df, str(tmp_path / "root"), fmt="csv", partition_by="location")
    (tmp_path / "root" / "notes.txt").write_text("x")
    cat = io.file_catalogue(spark, str(tmp_path / "root"))
    files = cat.collect()
    assert len(files) == 2 and all(r["file"].endswith(".csv") for r in files)
    assert all(r["size_bytes"] > 0 and r["size"].endswith("B") for r in files)


def test_samples_roundtrip_float32(spark, tmp_path):
    df = spark.createDataFrame([("a", "2024-01-01", "train", [[0.1, 0.2]], 0.3)],
                               "location string, timestamp string, split string, x array<array<double>>, y double")
    io.write_samples(df, str(tmp_path / "s"))
    back = io.read_samples(spark, str(tmp_path / "s"), split="train")
    r = back.first()
    assert dict(back.dtypes)["y"] == "float" and abs(r["y"] - 0.3) < 1e-6 and r["split"] == "train"
    assert io.read_samples(spark, str(tmp_path / "s"), split="test").count() == 0


def test_json_doc_roundtrip(spark, tmp_path):
    m = spark.createDataFrame([("lstm", 0.15, 0.38), ("cnn", 0.16, 0.39)], "model string, mse double, mae double")
    doc = m.agg(F.map_from_entries(F.collect_list(F.struct("model", F.struct("mse", "mae")))).alias("models"))
    io.write_json_doc(doc, str(tmp_path / "d"))
    back = io.read_json_docs(spark, str(tmp_path / "d"), "models map<string, struct<mse: double, mae: double>>",
                             multiline=False)
    flat = {r["key"]: r["value"]["mse"] for r in back.select(F.explode("models")).collect()}
    assert flat == {"lstm": 0.15, "cnn": 0.16}
