"""Exact splits, page directories, stored positions, labels without a bound."""
import math

import pytest
from pyspark.sql import functions as F

from limnos.operators import index as ix
from limnos.operators import positions as pos
from tests.conftest import rows


@pytest.mark.parametrize("n", [0, 1, 4, 5, 6, 1000, 20001])
def test_exact_split_size(spark, n):
    df = spark.range(n).select((F.col("id") * 7).alias("k"), F.lit("x").alias("v")).repartition(5)
    out = pos.exact_split(df, ["k"])
    assert out.count() == n and out.where("split = 'test'").count() == math.ceil(n / 5)
    again = pos.exact_split(df.repartition(3), ["k"])
    assert rows(out.where("split = 'test'"), "k") == rows(again.where("split = 'test'"), "k")


def test_exact_split_with_equal_keys(spark):
    df = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 0)] * 30 + [(None, 5)] * 20, "k int, v int")
    for part in (0.2, 0.33, 0.5, 1.0, 0.0):
        out = pos.exact_split(df, ["k"], part)
        assert out.columns == ["k", "v", "split"] and out.count() == 100
        assert out.where("split = 'test'").count() == math.ceil(round(part * 100, 6))
        got = out.where("split = 'test'").groupBy("k").count().count()
        assert got <= 3


def test_pages_by_directory(spark):
    df = spark.range(1003).select((F.col("id") * 3).alias("k"), F.col("id").cast("string").alias("v")).repartition(4)
    directory = pos.page_directory(df, "k", 100)
    assert rows(directory, "page", "first", "n_pages") == [(p + 1, p * 300, 11) for p in range(11)]
    for p in (1, 4, 11):
        assert rows(pos.read_page(df, directory, "k", p), "k") == [(i * 3,) for i in range((p - 1) * 100, min(p * 100, 1003))]
    assert pos.read_page(df, directory, "k", 12).count() == 0
    assert pos.page_directory(df.limit(0), "k", 100).count() == 0


def test_stored_positions(spark, tmp_path):
    for i, part in enumerate(([5, 3, 9], [], [1, 8], [2])):
        spark.createDataFrame([(v,) for v in part], "v int").coalesce(1).write.parquet(str(tmp_path / f"d={i}"))
    scan = spark.read.parquet(str(tmp_path))
    assert rows(pos.stored_positions(scan), "row_pos", "v") == [(0, 5), (1, 3), (2, 9), (3, 1), (4, 8), (5, 2)]
    other = spark.read.parquet(str(tmp_path / "d=2")).withColumnRenamed("v", "w")
    both = pos.zip_stored(scan, spark.read.parquet(str(tmp_path / "d=2")).select(F.col("v").alias("w"), "_metadata"))
    assert rows(both, "row_pos", "v", "w")[:3] == [(0, 5, 1), (1, 3, 8), (2, 9, None)]
    assert other.columns == ["w"]


def test_one_hot_without_bound(spark):
    n = 100_000
    df = spark.range(n).select("id", F.concat(F.lit("label "), "id").alias("a"), F.when(F.col("id") % 2 == 0, F.col("id") % 3).alias("b"))
    out = ix.one_hot_sparse(df, ["a", "b"])
    assert out.columns == ["id", "one_hot"]
    got = out.agg(F.min("one_hot.size"), F.max("one_hot.size"), F.sum(F.size("one_hot.indices")), F.count_distinct(F.col("one_hot.indices")[0])).first()
    assert tuple(got) == (n + 3, n + 3, n + n // 2, n)
    small = ix.one_hot_sparse(spark.createDataFrame([("x", None), ("y", "z"), (None, "?")], "a string, b string"), ["a", "b"],
                              codes=ix.label_codes(spark.createDataFrame([("y", "z"), ("x", "z")], "a string, b string"), ["a", "b"]))
    assert sorted((r[0]["size"], r[0]["indices"], r[0]["values"]) for r in small.collect()) == [(3, [], []), (3, [0], [1.0]), (3, [1, 2], [1.0, 1.0])]
