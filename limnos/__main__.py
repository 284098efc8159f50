"""Command-line jobs (spark-submit -m style entry point).

  python -m limnos prepare  --water W.csv [--climate C.csv] --out DIR [--sentinel -999] [--report DIR]
  python -m limnos features --prepared DIR --out DIR [--target WQI]
  python -m limnos train    --samples DIR --out DIR [--trials N] [--scaler DIR] [--features A,B] [--models reuse|replace]
  python -m limnos profile  --table DIR --out DIR

Inputs are CSV (header row) or Parquet folders; outputs are Parquet / JSON
folders. The session is the submitter's (cluster settings come from
spark-submit); locally a session is built with the defaults in
``limnos.session``.
"""

from __future__ import annotations

import argparse
import sys


def _read(spark, path: str):
    if path.endswith(".csv"):
        from limnos.sources.files import read_csv
        df = read_csv(spark, path)  # all text; numbers are coerced downstream
        if df is None:
            raise SystemExit(f"cannot read {path}")
        return df
    return spark.read.parquet(path)


def cmd_prepare(spark, a):
    from pyspark.sql.types import NumericType
    from limnos.plans.cleaning import clean_raw, full_report
    from limnos.plans.prepare import canonicalise, prepare
    sent = [a.sentinel] if a.sentinel is not None else None
    cleaned = clean_raw(_read(spark, a.water), sentinels=sent)
    water, measures = cleaned.table, cleaned.measures
    print(" ".join(f"{k}={v}" for k, v in cleaned.totals.items()))
    if a.report:
        full_report(cleaned, a.constant).write.mode("overwrite").json(a.report + "/report")
        cleaned.quarantine.write.mode("overwrite").json(a.report + "/quarantine")
    climate, cm = None, None
    if a.climate:
        climate = canonicalise(_read(spark, a.climate), sentinels=sent).drop("location")
        cm = [f.name for f in climate.schema.fields if isinstance(f.dataType, NumericType)]
    out = prepare(water, climate, "location", "timestamp", measures, climate_ts="timestamp",
                  climate_measures=cm, constant=a.constant)
    out.write.mode("overwrite").partitionBy("data_type").parquet(a.out)


def cmd_features(spark, a):
    from limnos.functions.constants import WQI_WEIGHTS
    from limnos.plans.features import model_samples, model_table
    from limnos.sources.files import write_samples, write_stats
    table, stats = model_table(spark.read.parquet(a.prepared), WQI_WEIGHTS)
    table.write.mode("overwrite").parquet(a.out + "/model_table")
    write_stats(stats, a.out + "/scaler")
    samples, _feats = model_samples(table, a.target)
    write_samples(samples, a.out + "/samples", keep=("location", "data_type", "timestamp"))


def cmd_train(spark, a):
    from pyspark.sql import functions as F
    from limnos.plans import training as tr
    from limnos.operators.common import materialize
    from limnos.plans.store import ModelStore
    from limnos.sources.documents import write_model_documents
    from limnos.sources.files import read_samples, read_stats
    s = read_samples(spark, a.samples).withColumn("x", F.col("x").cast("array<array<double>>")) \
        .withColumn("y", F.col("y").cast("double"))
    scaler = [tuple(r) for r in read_stats(spark, a.scaler).orderBy("column").collect()] if a.scaler else None  # a row a column
    shape = s.select(F.size("x").alias("steps"), F.size(F.element_at("x", 1)).alias("features")).first()
    manifest = {"steps": shape["steps"], "features": a.features.split(",") if a.features else shape["features"], "scaler": scaler}
    metrics, trials, best = tr.tune_and_compare(tr.training_table(s), n_trials=a.trials, folder=a.out + "/search", store=ModelStore(spark, a.out + "/models"),
                                                manifest=manifest, mode=a.models)
    metrics = materialize(metrics, "metrics")
    metrics.write.mode("overwrite").json(a.out + "/metrics")
    write_model_documents(tr.model_results(metrics, best), a.out + "/documents")
    trials.write.mode("overwrite").json(a.out + "/trials")


def cmd_profile(spark, a):
    from pyspark.sql.types import NumericType
    from limnos.operators import profile as pf
    df = spark.read.parquet(a.table)
    nums = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]
    pf.null_profile(df).write.mode("overwrite").parquet(a.out + "/nulls")
    pf.missing_profile(df).write.mode("overwrite").parquet(a.out + "/missing")
    pf.describe(df, nums).write.mode("overwrite").parquet(a.out + "/describe")
    pf.corr_matrix(df, nums).write.mode("overwrite").parquet(a.out + "/corr")
    if "location" in df.columns:
        pf.location_counts(df).write.mode("overwrite").parquet(a.out + "/location_counts")


def main(argv=None):
    p = argparse.ArgumentParser(prog="limnos")
    sub = p.add_subparsers(dest="cmd", required=True)
    pp = sub.add_parser("prepare")
    pp.add_argument("--water", required=True)
    pp.add_argument("--climate")
    pp.add_argument("--out", required=True)
    pp.add_argument("--sentinel", type=float)
    pp.add_argument("--report")
    pp.add_argument("--constant", choices=["keep", "drop"], default="keep")
    pf_ = sub.add_parser("features")
    pf_.add_argument("--prepared", required=True)
    pf_.add_argument("--out", required=True)
    pf_.add_argument("--target", default="WQI")
    pt = sub.add_parser("train")
    pt.add_argument("--samples", required=True)
    pt.add_argument("--out", required=True)
    pt.add_argument("--trials", type=int)
    pt.add_argument("--scaler")
    pt.add_argument("--features")
    pt.add_argument("--models", choices=["reuse", "replace"], default="reuse")
    pr = sub.add_parser("profile")
    pr.add_argument("--table", required=True)
    pr.add_argument("--out", required=True)
    a = p.parse_args(argv)
    from pyspark.sql import SparkSession
    active = SparkSession.getActiveSession()
    if active is None:
        from limnos.session import build_session
        active = build_session()
    {"prepare": cmd_prepare, "features": cmd_features, "train": cmd_train, "profile": cmd_profile}[a.cmd](active, a)


if __name__ == "__main__":
    sys.exit(main())
