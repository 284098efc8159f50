"""Parquet test tables and the feeds bound to the reference's roles.

Feeds (one lazy scan each; Catalyst prunes columns and pushes filters
into the parquet reader):
  E  events   location = event_type, measures value and k (from JSON props)
  U  events   location = user_id
  W  lineitem location = l_linestatus, time = l_shipdate, 4 measures
  K  orders   global daily mean of o_totalprice ("climate" side)
  KL orders   located by o_orderstatus
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

W_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def feed_e(spark, sf_dir) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", "ts", F.col("event_type").alias("location"), "value",
                     F.get_json_object("props", "$.k").try_cast("double").alias("k"))


def feed_u(spark, sf_dir) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(F.col("user_id").cast("string").alias("location"), "ts", "value")


def feed_w(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_linestatus").alias("location"), F.col("l_shipdate").alias("ts"), *W_MEASURES)


def feed_k(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderdate").alias("ts"), "o_totalprice")


def feed_kl(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderstatus").alias("location"), F.col("o_orderdate").alias("ts"), "o_totalprice")
