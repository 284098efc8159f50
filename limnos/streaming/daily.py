"""Daily per-location means over a growing file feed (D01 as a stream).

The reference reads whole files; its first aggregation (mean per location
and calendar day) is the one step that is correct on a stream too. The
streaming job keeps per-(location, day) running sums and counts in Spark's
state store and, in ``update`` mode, hands each micro-batch's changed rows
to ``foreachBatch``, which appends them with the batch id to a Parquet table
under the checkpoint folder (idempotent per batch id on replay). The current
daily means are the newest row per (location, day) of that table.

Late data: there is no watermark, so a reading counts whenever it arrives
and the result does not depend on file order. The state holds one row per
location and day. Gap expansion, fill, outliers and scaling need the whole
history and stay batch jobs over the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limnos.functions.exprs import nan_to_null


def daily_stream(spark: SparkSession, source_dir: str, schema: str, key: str, ts: str,
                 measures: list[str], glob: str | None = None,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming DataFrame of running daily sums/counts per (key, day)."""
    r = spark.readStream.schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    # Event time must be TIMESTAMP. Readings are wall-clock (timestamp_ntz):
    # take the instant whose UTC clock shows that wall-clock, so the 1-day
    # windows (aligned to UTC midnight) are exactly the calendar days in any
    # session time zone.
    ntz = F.col(ts).cast("timestamp_ntz")
    sod = F.hour(ntz) * 3600 + F.minute(ntz) * 60 + F.second(ntz)
    evt = F.timestamp_seconds(F.unix_date(F.to_date(ntz)).cast("long") * 86400 + sod)
    s = r.parquet(source_dir).where(F.col(ts).isNotNull()).withColumn("_evt", evt)
    day = F.window(F.col("_evt"), "1 day")
    aggs = []
    for m in measures:
        x = nan_to_null(F.col(m).try_cast("double"))
        aggs += [F.sum(x).alias(f"sum_{m}"), F.count(x).alias(f"n_{m}")]
    return (s.groupBy(F.col(key).cast("string").alias("location"), day.alias("w")).agg(*aggs)
             .select("location",
                     F.date_from_unix_date(F.floor(F.unix_seconds(F.col("w.start")) / 86400).cast("int"))
                      .alias("timestamp"),
                     *[c for m in measures for c in (f"sum_{m}", f"n_{m}")]))


def run_to_table(stream: DataFrame, table_path: str, checkpoint: str) -> None:
    """Drain the available input (``availableNow``) into ``table_path``:
    each micro-batch appends its updated rows tagged with the batch id."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("batch_id", F.lit(batch_id))
              .write.mode("append").partitionBy("batch_id").parquet(table_path))

    q = (stream.writeStream.outputMode("update").foreachBatch(sink)
               .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def current_means(spark: SparkSession, table_path: str, measures: list[str]) -> DataFrame:
    """Latest state per (location, day) -> daily means (NULL when no value)."""
    t = spark.read.parquet(table_path)
    values = [c for m in measures for c in (f"sum_{m}", f"n_{m}")]
    latest = (t.groupBy("location", "timestamp").agg(F.max_by(F.struct(*values), "batch_id").alias("_v"))
               .select("location", "timestamp", "_v.*"))
    return latest.select("location", "timestamp",
                         *[(F.col(f"sum_{m}") / F.when(F.col(f"n_{m}") > 0, F.col(f"n_{m}"))).alias(m)
                           for m in measures])
