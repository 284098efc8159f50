"""The command-line jobs end to end on CSV feeds derived from the test tables."""
import os

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_SMALL), reason="test tables not present")


def test_prepare_features_train_profile(spark, tmp_path):
    from limnos.__main__ import main
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    water = li.select(F.col("l_linestatus").alias(" Location "), F.date_format("l_shipdate", "yyyy-MM-dd").alias("Date"),
                      F.col("l_quantity").alias("pH Level"), F.col("l_discount").alias("Dissolved Oxygen (mg/L)"))
    water.coalesce(1).write.option("header", True).csv(str(tmp_path / "water.csv"))
    orders = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    climate = orders.select(F.year("o_orderdate").alias("YEAR"), F.month("o_orderdate").alias("MONTH"),
                            F.col("o_totalprice").alias("RAINFALL"))
    climate.coalesce(1).write.option("header", True).csv(str(tmp_path / "climate.csv"))
    out = str(tmp_path / "out")
    main(["prepare", "--water", str(tmp_path / "water.csv"), "--climate", str(tmp_path / "climate.csv"),
          "--out", out + "/prepared", "--sentinel", "-999"])
    prepared = spark.read.parquet(out + "/prepared")
    assert {"location", "timestamp", "pH Level", "RAINFALL", "sequence_id", "data_type"} <= set(prepared.columns)
    assert prepared.select("location").distinct().count() == 2
    main(["features", "--prepared", out + "/prepared", "--out", out + "/features"])
    table = spark.read.parquet(out + "/features/model_table")
    assert "WQI" in table.columns
    main(["train", "--samples", out + "/features/samples", "--out", out + "/train", "--trials", "1"])
    assert spark.read.json(out + "/train/metrics").count() == 3
    main(["profile", "--table", out + "/prepared", "--out", out + "/profile"])
    assert spark.read.parquet(out + "/profile/describe").count() > 0
