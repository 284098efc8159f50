"""Stage 1 and stage 2 end to end on a hand-made water / climate pair."""
import datetime as dt

from pyspark.sql import functions as F

from limnos.plans.features import model_samples, model_table
from limnos.plans.prepare import cleaning_report, prepare


def _feeds(spark):
    water = []
    for i in range(30):
        day = dt.datetime(2024, 1, 1) + dt.timedelta(days=i)
        if i % 7 != 3:                                   # gaps
            water.append(("A", day, 7.0 + (i % 5) * 0.1, 8.0 - (i % 3) * 0.2))
        water.append(("B", day + dt.timedelta(hours=6), 6.5 + (i % 4) * 0.1, None))   # no DO at all
    water.append(("A", dt.datetime(2024, 1, 15, 12), 40.0, 8.0))                         # outlier day
    water.append(("C", dt.datetime(2024, 1, 2), None, None))                             # no values at all
    w = spark.createDataFrame(water, "Location string, ts timestamp_ntz, ph double, do double")
    climate = [(dt.datetime(2024, 1, 1) + dt.timedelta(days=i), float(i % 9)) for i in range(0, 25)]
    c = spark.createDataFrame(climate, "ts timestamp_ntz, rain double")
    return w.withColumnRenamed("Location", "location"), c


def test_prepare_end_to_end(spark):
    w, c = _feeds(spark)
    out = prepare(w, c, "location", "ts", ["ph", "do"], climate_ts="ts", climate_measures=["rain"])
    rows = out.collect()
    by = {}
    for r in rows:
        by.setdefault((r["location"], r["data_type"]), []).append(r)
    # C has no value: one keep-alive row per variant, no time
    assert [(r["timestamp"], r["ph"]) for r in by[("C", "cleaned")]] == [(None, None)]
    # A: 30 grid days, the outlier day (ph mean far off) removed; both variants present
    a = by[("A", "cleaned")]
    assert len(a) == 29 and len(by[("A", "normalized")]) == 29
    assert all(0.0 <= r["ph"] <= 1.0 for r in by[("A", "normalized")])
    # B's DO column is empty: it stays NULL and does not vote in the outlier test
    assert len(by[("B", "cleaned")]) == 30 and {r["do"] for r in by[("B", "cleaned")]} == {None}
    # climate only covers the first 25 days; the tag follows each row's own match
    tags = {r["timestamp"]: r["data_source"] for r in a}
    assert tags[dt.date(2024, 1, 2)] == "water_climate_combined" and tags[dt.date(2024, 1, 28)] == "water_only"
    # dense sequence ids over (location, timestamp, data_type), metadata
    ids = sorted(r["sequence_id"] for r in rows)
    assert ids == list(range(len(rows))) and {r["total_sequences"] for r in rows} == {len(rows)}
    assert {r["numeric_columns_count"] for r in rows} == {6}


def test_cleaning_report(spark):
    w, _ = _feeds(spark)
    rep = {r["location"]: r for r in cleaning_report(w, "location", "ts", ["ph", "do"]).collect()}
    assert rep["A"]["outliers_removed"] == 1 and rep["A"]["rows_left"] == 29
    assert rep["B"]["gaps"] == 30 and rep["B"]["filled"] == 0


def test_model_table_and_samples(spark):
    w, c = _feeds(spark)
    prepared = prepare(w, c, "location", "ts", ["ph", "do"], climate_ts="ts", climate_measures=["rain"])
    table, stats = model_table(prepared.where(F.col("location") == "A"), {"ph": 0.5, "rain": 0.5})
    cols = set(table.columns)
    assert {"WQI", "data_source_water_only", "data_source_water_climate_combined"} <= cols
    vals = table.select("WQI", "ph", "rain").collect()
    assert all(0.0 <= v <= 1.0 for r in vals for v in r)
    assert {r["column"] for r in stats.collect()} >= {"WQI", "ph", "rain"}
    samples, feats = model_samples(table, "WQI")
    # 29 rows per variant -> 17 windows each
    assert samples.count() == 2 * (29 - 12)
    assert len(samples.first()["x"][0]) == len(feats)


def test_canonicalise_sentinel_and_bad_rows(spark):
    from limnos.plans.prepare import canonicalise
    raw = spark.createDataFrame([("2013", "1", "46.2", "-999"), ("2013", "2", "-999", "29.2"), ("x", "3", "1", "2")],
                                "` YEAR` string, `MONTH ` string, `RAINFALL` string, `TMAX` string")
    out = canonicalise(raw, sentinels=[-999], as_date=True)
    got = sorted((str(r["timestamp"]), r["RAINFALL"], r["TMAX"]) for r in out.collect())
    assert got == [("2013-01-01", 46.2, None), ("2013-02-01", None, 29.2)]
    assert out.first()["location"] is None
