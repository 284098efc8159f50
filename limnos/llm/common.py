"""Helpers of the training-data operators."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from limnos.llm.words import mix64
from limnos.operators.common import materialize, q
from limnos.session import scratch_path

__all__ = ["batches_of", "bitmap", "bitmap_has", "free", "importable", "materialize", "materialize_by", "numbered", "partitions", "q", "running_sum"]


#: of the C library in Python workers, unless the job sets its own: arrays of some megabytes go back to the system when freed,
#: and so do Arrow's buffers, which Arrow's own pool would keep
_WORKER_MEMORY = {"MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": str(1 << 22), "MALLOC_TRIM_THRESHOLD_": str(1 << 23), "ARROW_DEFAULT_MEMORY_POOL": "system"}


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it,
    unless the job ships it (--py-files) or it is installed; and has them
    return memory that they no longer use."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    for k, v in _WORKER_MEMORY.items():
        env.setdefault(k, v)


_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def batches_of(spark: SparkSession, size: int):
    """Jobs run inside give Python workers batches of about ``size`` bytes at
    most, however wide the rows are (a row at least), unless the session sets
    its own bound. Spark makes a batch, and doubles its buffers, outside the
    heap, the worker holds it again, and each task has one."""
    own = spark.conf.get(_BATCH_BYTES, None)
    if own is None:
        spark.conf.set(_BATCH_BYTES, str(size))
    try:
        yield
    finally:
        if own is None:
            spark.conf.unset(_BATCH_BYTES)


def free(columns: Sequence[str], name: str) -> str:
    """``name``, with underscores behind it until no column has it (Spark
    doesn't tell upper from lower case in names)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with columns c0, c1, ... for mapInArrow, which takes a dot in a
    name for a field of a struct."""
    return df.select(*[F.col(q(c)).alias(f"c{i}") for i, c in enumerate(df.columns)])


def partitions(df: DataFrame) -> int:
    """Shuffle partitions of the session (the cluster's choice for its data)."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def materialize_by(df: DataFrame, key: str, name: str) -> DataFrame:
    """As ``materialize``, in buckets of ``key``, one per shuffle partition: a
    later join on it reads them where they are and shuffles only its other
    side. ``df`` should come out of a shuffle by ``key`` already, so that a
    task writes few buckets."""
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex[:12]}"
    df.write.bucketBy(partitions(df), key).option("path", scratch_path(spark, name)).format("parquet").saveAsTable(table)
    return spark.table(table)


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, str]) -> DataFrame:
    """Exclusive running sums within ``keys`` along ``order``: ``values`` maps
    each new column to the column it sums. The rows are range-sorted by keys
    and order, so that a key of any size spreads over many tasks; each task
    sums its own range, and the ranges' totals, one row per key and range,
    give the offsets. Nulls sort last and are a key of their own."""
    n = partitions(df)
    sort = [F.col(q(c)).asc_nulls_last() for c in [*keys, *order]]
    ranged = materialize(df.repartitionByRange(n, *sort).withColumn("__range", F.spark_partition_id()), "ranges")
    keyed = [*map(q, keys)]
    totals = ranged.groupBy(*keyed, "__range").agg(*[F.sum(q(v)).alias(f"__t{i}") for i, v in enumerate(values.values())])
    before = Window.partitionBy(*keyed).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keyed)], F.col("__range").alias("__at"),
                            *[F.coalesce(F.sum(f"__t{i}").over(before), F.lit(0)).alias(f"__o{i}") for i in range(len(values))])
    cond = F.col("__range") == F.col("__at")
    for i, k in enumerate(keyed):
        cond = cond & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    inner = Window.partitionBy(*keyed, "__range").orderBy(*[F.col(q(c)).asc_nulls_last() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.withColumns({f"__s{i}": F.coalesce(F.sum(q(v)).over(inner), F.lit(0)) for i, v in enumerate(values.values())})
    out = out.join(offsets, cond)
    return out.select(*[F.col(q(c)) for c in df.columns if c not in values],
                      *[(F.col(f"__s{i}") + F.col(f"__o{i}")).alias(c) for i, c in enumerate(values)])


#: bits of the bitmaps below: 2 MB, whatever they are made of
BITMAP_BITS = 24
_PARTS = 16


def _places(keys: np.ndarray) -> np.ndarray:
    mixed = mix64(keys.view(np.uint64))
    return np.concatenate([mixed >> np.uint64(64 - BITMAP_BITS), mixed & np.uint64((1 << BITMAP_BITS) - 1)]).astype(np.int64)


def bitmap(keys: DataFrame) -> np.ndarray:
    """A Bloom filter of fixed size over a column of longs. It holds every
    key; others pass with a chance that grows as it fills, so what it lets
    through is checked by a join."""
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << BITMAP_BITS, bool)
        for b in batches:
            bits[_places(b.column(0).to_numpy())] = True
        for i, part in enumerate(np.split(np.packbits(bits), _PARTS)):
            if part.any():
                yield pa.RecordBatch.from_pydict({"part": [i], "bits": [part.tobytes()]}, schema)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for b in batches:
            for i, bits in zip(b.column("part").to_pylist(), b.column("bits").to_pylist(), strict=True):
                x = np.frombuffer(bits, np.uint8)
                parts[i] = parts[i] | x if i in parts else x
        yield pa.RecordBatch.from_pydict({"part": list(parts), "bits": [x.tobytes() for x in parts.values()]}, schema)
    schema = pa.schema([("part", pa.int32()), ("bits", pa.binary())])
    made = keys.mapInArrow(fill, "part int, bits binary").repartition(_PARTS, "part").mapInArrow(join, "part int, bits binary")
    out = np.zeros((_PARTS, (1 << BITMAP_BITS) // 8 // _PARTS), np.uint8)
    for r in made.collect():
        out[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def bitmap_has(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = _places(np.ascontiguousarray(keys))
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).reshape(2, -1).all(axis=0)
