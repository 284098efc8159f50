"""Row positions: exact splits (D10), page directories (H05) and positions in
the stored order (E05). Nothing here sorts a table or numbers it in one task.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.functions.constants import TEST_FRACTION
from limnos.functions.exprs import col_of
from limnos.operators.common import attach_row, materialize, q, stats_join
from limnos.operators.timeseries import number_rows, part_offsets

#: bits of the hash that orders rows, and counts asked for at once
_BITS, _FAN = 60, 1 << 12


def row_hash(key_cols: list[str], seed: int = 42):
    """60 bits of md5(seed|key...), NULL parts left out."""
    text = F.concat_ws("|", F.lit(str(seed)), *[col_of(c).cast("string") for c in key_cols])
    return F.conv(F.substring(F.md5(text), 1, _BITS // 4), 16, 10).cast("bigint")


def exact_split(df: DataFrame, key_cols: list[str], test_fraction: float = TEST_FRACTION, seed: int = 42, out: str = "split") -> DataFrame:
    """A shuffled split in which exactly ceil(test_fraction * n) rows are
    ``test``: those with the smallest hashes of their key.

    The greatest hash among them is found by counting rows in ranges of
    hashes, then in parts of the range that holds it; each pass reads the key
    columns alone and brings at most 4,096 counts to the driver. Rows that
    share that hash (rows of one key) are told apart by all their columns and,
    if equal, by any numbering: equal rows are interchangeable.
    """
    h = row_hash(key_cols, seed)
    hashes = df.select(h.alias("_h"))
    n = hashes.count()
    wanted = math.ceil(Fraction(str(test_fraction)) * n)
    lo, width, below = 0, 1 << _BITS, 0  # rows under lo are test rows, below of them; the rest are in [lo, lo + width)
    while width > 1 and below < wanted:
        step = max(1, width // _FAN)
        inside = hashes.where((F.col("_h") >= lo) & (F.col("_h") < lo + width))
        counts = inside.groupBy(F.expr(f"(_h - {lo}L) div {step}L").alias("b")).count().orderBy("b").collect()
        for r in counts:
            if below + r["count"] > wanted or (below + r["count"] == wanted and r["b"] == counts[-1]["b"]):
                lo, width = lo + r["b"] * step, step
                if below + r["count"] == wanted:
                    lo, width, below = lo + step, 1, wanted
                break
            below += r["count"]
            if below == wanted:
                lo, width = lo + (r["b"] + 1) * step, 1
                break
    flag = F.when(F.col("_h") < lo, "test").otherwise("train")
    marked = df.withColumn("_h", h)
    if below == wanted:
        return marked.withColumn(out, flag).drop("_h")
    tied = materialize(marked.where(F.col("_h") == lo).withColumn("_tie", F.xxhash64(*[col_of(c) for c in df.columns])), "tied")
    tied = number_rows(tied, None, ["_tie"], "_rn").withColumn(out, F.when(F.col("_rn") < wanted - below, "test").otherwise("train"))
    return marked.where(F.col("_h") != lo).withColumn(out, flag).drop("_h").unionByName(tied.drop("_h", "_tie", "_rn"))


def page_directory(df: DataFrame, order: str, size: int) -> DataFrame:
    """(page from 1, first: its first key, n_pages), written once. Keys
    of ``order`` are unique and not NULL. Rows are counted by ranges of keys,
    and numbered inside each."""
    numbered = number_rows(df.select(F.col(q(order))), None, [order], "_rn")
    firsts = numbered.where(F.col("_rn") % size == 0).select((F.floor(F.col("_rn") / size) + 1).alias("page"), F.col(q(order)).alias("first"))
    firsts = materialize(firsts, "pages")
    return attach_row(firsts, firsts.agg(F.count(F.lit(1)).alias("n_pages")))


def read_page(df: DataFrame, directory: DataFrame, order: str, page: int) -> DataFrame:
    """The rows of one page: a range of keys, which reaches the scan as a
    filter; no row before it is read or counted. A page that does not exist
    has no rows."""
    ends = {r["page"]: r["first"] for r in directory.where(F.col("page").isin(page, page + 1)).collect()}
    if page not in ends:
        return df.limit(0)
    rows = df.where(F.col(q(order)) >= F.lit(ends[page]))
    return rows.where(F.col(q(order)) < F.lit(ends[page + 1])) if page + 1 in ends else rows


def stored_positions(scan: DataFrame, out: str = "row_pos") -> DataFrame:
    """``scan``, which reads files and nothing else, with each row's place
    in the stored order: files by name, rows as they lie in their file. Only
    one count per file is added up."""
    at = scan.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_index"))
    counts = scan.select(F.col("_metadata.file_path").alias("_file")).groupBy("_file").agg(F.count(F.lit(1)).alias("_pn"))
    return stats_join(at, part_offsets(counts, "_file"), ["_file"], "inner").withColumn(out, F.col("_poff") + F.col("_index")).drop("_file", "_index", "_poff", "_metadata")


def zip_stored(a: DataFrame, b: DataFrame, out: str = "row_pos") -> DataFrame:
    """Two scans side by side by stored row; the shorter one is padded
    with NULL."""
    return stored_positions(a, out).join(stored_positions(b, out), [out], "full")
