"""Small helpers shared by the operator modules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_list(x) -> list:
    if x is None:
        return []
    return list(x) if isinstance(x, (list, tuple)) else [x]


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Cut lineage by writing the table (Parquet) under the shared
    ``spark.checkpoint.dir`` and reading it back: one job, the upstream is
    computed once, later readers get column pruning and filter pushdown, and
    a lost executor re-reads files instead of recomputing the lineage."""
    from limnos.session import scratch_path
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def stats_join(df: DataFrame, stats: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Attach a per-key aggregate back to the rows it was computed from.

    * No key: the aggregate is one row — attached as a scalar subquery.
    * Keyed: a plain equi-join. The broadcast decision is left to the
      runtime: AQE measures the materialised aggregate and turns the join
      into a broadcast hash join only when it is below
      ``spark.sql.adaptive.autoBroadcastJoinThreshold``; above that it stays
      a shuffle join whose skewed partitions AQE splits. No extra job, and
      nothing is broadcast on an estimate.
    """
    if not keys:
        return attach_row(df, stats)
    named = {k: f"_stat_{i}" for i, k in enumerate(keys)}
    side = stats.select(*[F.col(q(k)).alias(v) for k, v in named.items()],
                        *[F.col(q(c)) for c in stats.columns if c not in named])
    cond = F.lit(True)
    for k, v in named.items():  # a NULL key is a group like any other
        cond = cond & F.col(q(k)).eqNullSafe(F.col(v))
    return df.join(side, cond, how).drop(*named.values())


def attach_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate to every row as a scalar
    subquery (computed once, its value shipped to the tasks) — no join."""
    cols = one_row.columns
    r = one_row.select(F.struct(*[F.col(q(c)) for c in cols]).alias("_r")).scalar()
    return df.withColumns({c: r.getField(c) for c in cols})


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    """Names of numeric-typed columns, in schema order."""
    from pyspark.sql.types import NumericType
    ex = set(exclude)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NumericType) and f.name not in ex]


def q(name: str) -> str:
    """Backtick-quote a column name for SQL expressions."""
    return "`" + name.replace("`", "``") + "`"
