"""Plan properties the scale design relies on (checked on the executed plan)."""
import os
import re

import pytest

from tests.conftest import SF_SMALL

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_SMALL), reason="test tables not present")


def _plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0]


def test_per_location_chain_is_one_scan_two_exchanges(spark):
    from limnos.plans.catalog import QUERIES
    plan = _plan(QUERIES["user_daily_clean"](spark, SF_SMALL))
    assert plan.count("FileScan parquet") == 1
    # partial aggregation before the first shuffle, then one shuffle by location for all windows
    assert "partial_avg" in plan
    ex = re.findall(r"Exchange (hashpartitioning\([^)]*\)|SinglePartition|rangepartitioning)", plan)
    assert len(ex) == 2 and not any(e == "SinglePartition" for e in ex)
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,value:double>" in plan
    assert not re.search(r"(BatchEvalPython|ArrowEvalPython)", plan)


def test_no_cross_or_nested_loop_joins(spark):
    from limnos.plans.catalog import QUERIES
    for name in ["prepared_table", "join_means_broadcast", "minmax_global", "histogram30", "mean_impute"]:
        plan = _plan(QUERIES[name](spark, SF_SMALL))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_skewed_location_is_combined_before_the_shuffle(spark):
    """One location holding most raw rows: the day aggregate is partial, so
    the shuffle carries one row per (location, day, map task), and the
    result equals the plain computation."""
    import datetime as dt
    from pyspark.sql import functions as F
    from limnos.operators import timeseries as ts
    hot = spark.range(0, 20000).select(F.lit("hot").alias("location"),
                                       (F.lit(dt.datetime(2024, 1, 1)) + F.make_interval(mins=F.col("id").cast("int") % 2880)).alias("ts"),
                                       (F.col("id") % 13).cast("double").alias("v"))
    cold = spark.createDataFrame([("cold", dt.datetime(2024, 1, 1, 5), 1.0)], "location string, ts timestamp, v double")
    df = hot.unionByName(cold).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    g = ts.daily_resample(df, "location", "ts", ["v"])
    plan = _plan(g)
    assert "partial_avg" in plan
    got = {(r["location"], r["timestamp"]): r["v"] for r in g.collect()}
    exp = df.groupBy("location", F.to_date("ts").alias("d")).agg(F.avg("v").alias("v")).collect()
    assert {(r["location"], r["d"]): r["v"] for r in exp} == got
