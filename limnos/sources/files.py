"""File sources and sinks (A01-A11): CSV, JSON documents, sample tensors as
Parquet, scaler stats, the file catalogue and tuning-trial logs.

Paths are any Hadoop-compatible URI (shared storage on a cluster). Scratch
outputs go under ``spark.checkpoint.dir`` (see ``limnos.session.scratch_path``).
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from limnos.functions.exprs import col_of


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None,
             infer: bool = False) -> DataFrame | None:
    """CSV scan with a header row. Declare ``schema`` for known feeds;
    ``infer=True`` only for discovery. A path without files gives None (the
    caller decides); every other error is raised."""
    r = spark.read.option("header", True)
    if schema is not None:
        r = r.schema(schema)
    elif infer:
        r = r.option("inferSchema", True)
    try:
        return r.csv(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def read_csv_indexed(spark: SparkSession, path: str, schema: StructType | str | None = None,
                     out: str = "timestamp") -> DataFrame | None:
    """CSV whose first column is the time index: parsed with
    ``try_to_timestamp`` (bad text -> NULL) and renamed ``out``."""
    df = read_csv(spark, path, schema)
    if df is None:
        return None
    first = df.columns[0]
    t = F.try_to_timestamp(col_of(first).cast("string")).cast("timestamp_ntz")
    return df.withColumn(first, t).withColumnRenamed(first, out)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by=None, mode: str = "overwrite") -> str:
    """Write a table (parquet / csv with header / json), optionally
    partitioned (e.g. by location, for partition pruning on read)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)
    return path


def write_samples(samples: DataFrame, path: str, keep=("location", "timestamp")) -> str:
    """Sample tensors as Parquet, partitioned by split, stored as float32
    (``x ARRAY<ARRAY<FLOAT>>``, ``y FLOAT``)."""
    out = samples.select(*keep, "split", F.col("x").cast("array<array<float>>").alias("x"),
                         F.col("y").cast("float").alias("y"))
    return write_table(out, path, partition_by="split")


def read_samples(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """A07 read: a split filter is a partition filter (directory pruning)."""
    df = spark.read.parquet(path)
    return df.where(F.col("split") == split) if split else df


def write_stats(stats: DataFrame, path: str) -> str:
    """Persist a fitted scaler ``(column, lo, hi)``; one small file."""
    return write_table(stats.coalesce(1), path)


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("column string, lo double, hi double").parquet(path)


def write_json_doc(doc: DataFrame, path: str) -> str:
    """Write documents (one JSON object per row)."""
    doc.coalesce(1).write.mode("overwrite").json(path)
    return path


def read_json_docs(spark: SparkSession, path: str, schema: StructType | str | None = None,
                   multiline: bool = True, recursive: bool = False, glob: str | None = None) -> DataFrame:
    """JSON documents (pretty-printed files: ``multiline``); nested
    objects become structs / maps."""
    r = spark.read.option("multiLine", multiline)
    if recursive:
        r = r.option("recursiveFileLookup", True)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if schema is not None:
        r = r.schema(schema)
    return r.json(path)


def _human_size(n):
    units = ["B", "KB", "MB", "GB", "TB"]
    out = None
    for i, u in enumerate(units):
        lo = F.pow(F.lit(1024.0), i)
        hi = F.pow(F.lit(1024.0), i + 1)
        txt = F.concat(F.format_number(n / lo, 1), F.lit(" " + u))
        cond = (n < hi) if i < len(units) - 1 else F.lit(True)
        out = F.when(cond, txt) if out is None else out.when(cond, txt)
    return out


def file_catalogue(spark: SparkSession, root: str, pattern: str = "*.csv") -> DataFrame:
    """Every file matching ``pattern`` below ``root`` (recursive),
    de-duplicated and sorted, with its directory, size (bytes and readable)
    and modification time. The file content column is never read (pruned)."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .option("pathGlobFilter", pattern).load(root)
             .select("path", "length", "modificationTime").distinct())
    return (files.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("dir"),
                         F.regexp_extract("path", r"([^/]*)$", 1).alias("file"),
                         F.col("length").alias("size_bytes"), _human_size(F.col("length")).alias("size"),
                         F.col("modificationTime").alias("modified"))
                 .orderBy("dir", "file"))


TRIAL_SCHEMA = ("trial_id string, status string, score double, best_step long, "
                "hyperparameters struct<values: map<string, string>>, "
                "metrics struct<metrics: map<string, struct<direction: string, "
                "observations: array<struct<value: array<double>, step: long>>>>>, message string")


def read_trials(spark: SparkSession, root: str, glob: str = "trial.json", multiline: bool = True) -> DataFrame:
    """Tuning-trial logs (``trial.json`` files below ``root``) as a table:
    one row per trial with its values, score, status and error text."""
    df = read_json_docs(spark, root, TRIAL_SCHEMA, multiline=multiline, recursive=True, glob=glob)
    return df.select("trial_id", "status", "score", "best_step",
                     F.col("hyperparameters.values").alias("values"), "message",
                     F.input_file_name().alias("source"))
