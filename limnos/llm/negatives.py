"""Hard-negative mining by BOND vertical scans.

Rows are held by columns, a block at a time. An anchor reads the columns in
descending order of its own components' magnitude and adds up partial scores
of the rows that are still candidates. What the columns not yet read can add
lies between the sums of their least and greatest contributions in the block;
a row leaves the candidate bitmap when its score can no longer fall into a
wanted window or among the window's first k. The scores of those that stay
are exact at the end.

The anchors visit every block: an anchor is sent to each block once, a row to
one block. Blocks are dealt by a hash of the row, so a label of any size
spreads over all of them; the best of all blocks are merged by anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from limnos.llm.common import materialize, partitions

#: components that a block holds, at most and at least, about (4 bytes each)
BLOCK_COMPONENTS, LEAST_COMPONENTS = 1 << 23, 1 << 18
#: columns read between two prunings of the bitmap
STRIDE = 8


def vertical_scan(columns: np.ndarray, least: np.ndarray, most: np.ndarray, anchor: np.ndarray, candidates: np.ndarray,
                  windows: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window of scores (both ends included) the ``candidates`` (places
    of rows) whose score lies in it and may be among its first ``k``, with
    their scores: the first k, and all that tie with the last of them.
    ``columns`` is (dimensions, rows) of integers, ``least`` and ``most`` its
    bounds by dimension, ``anchor`` 64-bit integers."""
    order = np.argsort(-np.abs(anchor), kind="stable")
    ends = np.stack([anchor * least, anchor * most])
    # least and greatest sum of what is unread before each step
    low, high = (np.append(np.cumsum(e[order][::-1])[::-1], 0) for e in (ends.min(axis=0), ends.max(axis=0)))
    rows = np.asarray(candidates)
    score = np.zeros(len(rows), np.int64)
    inside = np.ones((len(windows), len(rows)), bool)
    for step in range(0, len(order) + 1, STRIDE):
        for d in order[step - STRIDE:step] if step else ():
            score += anchor[d] * columns[d, rows]
        inside = _prune(inside, score + low[step], score + high[step], windows, k)
        live = inside.any(axis=0)
        # the bitmap is packed once it is thin, so that later columns touch fewer rows
        if 4 * np.count_nonzero(live) < 3 * len(rows):
            rows, score, inside = rows[live], score[live], inside[:, live]
        if not len(rows):
            break
    else:
        for d in order[len(order) // STRIDE * STRIDE:]:
            score += anchor[d] * columns[d, rows]
        inside = _prune(inside, score, score, windows, k)
    return [(rows[i], score[i]) for i in inside]


def _prune(inside: np.ndarray, low: np.ndarray, high: np.ndarray, windows: list[tuple[int, int]], k: int) -> np.ndarray:
    out = np.empty_like(inside)
    for i, (a, z) in enumerate(windows):
        out[i] = inside[i] & (high >= a) & (low <= z)
        sure = low[out[i] & (low >= a) & (high <= z)]
        if len(sure) > k:  # k rows of the window are known to score this much
            out[i] &= high >= np.partition(sure, -k)[-k]
    return out


def _numbered(rows: DataFrame, scale: int) -> DataFrame:
    """__row, __id, __label, __anchor, __v: the rows that take part, with
    integer components. To be written before it is read twice."""
    x, scaled = F.col("embedding"), (lambda c: F.lit(float(scale)) * c.cast("double"))
    # a score, the sum of so many products, must fit 62 bits; a NaN is the greatest double
    bound = F.lit(float(1 << 31)) / F.sqrt(F.greatest(F.size(x), F.lit(1)))
    usable = F.coalesce(F.forall(x, lambda c: c.isNotNull() & (F.abs(scaled(c)) + 1 < bound)), F.lit(False))
    return rows.filter(F.col("label").isNotNull() & usable).select(
        F.monotonically_increasing_id().alias("__row"), F.col("vec_id").alias("__id"), F.col("label").cast("long").alias("__label"),
        "__anchor", F.transform(x, lambda c: F.floor(scaled(c)).cast("int")).alias("__v"))


def _scan_blocks(rows: DataFrame, asked: DataFrame, blocks: int, k: int, same: bool) -> DataFrame:
    """anchor, window, row, id, score: what ``vertical_scan`` finds in each
    block, k and ties at most once more cut to k by id, for ``asked`` (__row,
    __label, __v, __lo, __hi: arrays of window ends). ``same``: among rows of
    the anchor's label other than itself, else among those of other labels."""
    dealt = rows.select(F.pmod(F.xxhash64("__row"), F.lit(blocks)).cast("int").alias("block"), F.size("__v").alias("dims"), F.lit(0).alias("kind"),
                        "__row", "__id", "__label", "__v", F.lit(None).cast("array<long>").alias("__lo"), F.lit(None).cast("array<long>").alias("__hi"))
    copies = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.size("__v").alias("dims"), F.lit(1).alias("kind"),
                          "__row", F.lit(None).cast("long").alias("__id"), "__label", "__v", "__lo", "__hi")

    def block_of(held: list[pa.RecordBatch], dims: int):
        whole = pa.Table.from_batches(held)
        flat = whole.column("__v").combine_chunks().flatten().to_numpy().astype(np.int32)
        columns = np.ascontiguousarray(flat.reshape(whole.num_rows, dims).T)
        ids = whole.column("__id")
        # a null id stands behind all others
        order = np.lexsort((ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        label = whole.column("__label").to_numpy()
        by_label = np.argsort(label, kind="stable")
        return whole.column("__row").to_numpy(), ids, label, by_label, label[by_label], place, columns, columns.min(axis=1).astype(np.int64), columns.max(axis=1).astype(np.int64)

    def found(block, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        row, ids, label, by_label, sorted_label, place, columns, least, most = block
        every = np.arange(len(row))
        out: list[tuple] = []
        for uid, own, v, lo, hi in zip(*[batch.column(c).to_pylist() for c in ("__row", "__label", "__v", "__lo", "__hi")], strict=True):
            if same:
                a, z = np.searchsorted(sorted_label, [own, own + 1])
                candidates = by_label[a:z]
                candidates = candidates[row[candidates] != uid]
            else:
                candidates = every[label != own]
            windows = list(zip(lo, hi, strict=True))
            for w, (at, score) in enumerate(vertical_scan(columns, least, most, np.array(v, np.int64), candidates, windows, k)):
                best = np.lexsort((row[at], place[at], -score))[:k]
                out.append((np.full(len(best), uid), np.full(len(best), w), at[best], score[best]))
        if out:
            anchor, window, at, score = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(window.astype(np.int32)), pa.array(row[at]), ids.take(pa.array(at)).combine_chunks(), pa.array(score)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, block = None, [], None
        for whole in batches:
            key = np.stack([whole.column(c).to_numpy() for c in ("block", "dims", "kind")], axis=1)
            cut = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            for a, z in zip([0, *cut], [*cut, whole.num_rows], strict=True):
                if a == z:
                    continue
                name, kind, part = tuple(key[a, :2]), key[a, 2], whole.slice(a, z - a)
                if name != current:
                    current, held, block = name, [], None
                if kind == 0:
                    held.append(part)
                    continue
                if held:
                    block, held = block_of(held, int(name[1])), []
                if block is not None:
                    yield from found(block, part)
    names = ["anchor", "window", "row", "id", "score"]
    both = dealt.unionByName(copies).repartition(blocks, "block").sortWithinPartitions("block", "dims", "kind", "__row")
    return both.mapInArrow(run, "anchor long, window int, row long, id long, score long")


def _first(found: DataFrame, k: int, by: list[str]) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor, positives: int = 5, k: int = 10, percent: tuple[int, int] = (30, 90), scale: int = 256) -> DataFrame:
    """Hard negatives of the anchors among ``rows`` (vec_id, label, embedding):
    anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components x become floor(``scale`` x), scores are integer inner products;
    higher ones come first, then smaller vec_ids. An anchor's positives are its
    first ``positives`` other rows of its label; the negatives of each are the
    first ``k`` rows of other labels whose score is from percent[0] to
    percent[1] per cent of the positive's. ``is_anchor`` is a condition on the
    columns of ``rows``.

    Defined cases: rows take no part if the label, the vector or a component
    is null, or a component not finite or so large that scores might pass 62
    bits (scale |x| sqrt(dimensions) from 2**31); vectors of another length
    are not compared; a null vec_id comes last among ties, is an anchor only
    if the condition says so; rows with one vec_id are rows of their own, as
    anchors too; an anchor without positives, or a positive with a negative
    score (an empty window), gives no rows; equal rows tie and may both be
    returned; an empty table gives no rows; other columns are not read.
    """
    marked = rows.select("vec_id", "label", "embedding", F.coalesce(is_anchor, F.lit(False)).alias("__anchor"))
    own = materialize(_numbered(marked, scale), "vectors")
    size = own.agg(F.count(F.lit(1)).alias("n"), F.count_if("__anchor").alias("anchors"), F.coalesce(F.max(F.size("__v")), F.lit(1)).alias("dims")).first()
    components = size["n"] * max(1, size["dims"])
    # more blocks than memory asks for, for the sake of parallel work, as long as copies of anchors are fewer than rows
    spread = min(partitions(rows), components // LEAST_COMPONENTS, size["n"] // max(1, size["anchors"]))
    blocks = max(1, spread, -(-components // BLOCK_COMPONENTS))
    anchors = own.filter("__anchor").select("__row", "__id", "__label", "__v")
    wide = anchors.select("__row", "__label", "__v", F.array(F.lit(-(1 << 62))).alias("__lo"), F.array(F.lit(1 << 62)).alias("__hi"))
    near = _first(_scan_blocks(own, wide, blocks, positives, same=True), positives, ["anchor"])
    near = materialize(near.select("anchor", F.col("rank").alias("turn"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # 100 n from percent[0] p to percent[1] p, in whole numbers
    low = F.ceil(F.col("positive_score").cast("decimal(38,0)") * percent[0] / F.lit(100)).cast("long")
    high = F.floor(F.col("positive_score").cast("decimal(38,0)") * percent[1] / F.lit(100)).cast("long")
    windows = near.withColumns({"__l": low, "__h": high}).filter("__l <= __h")
    grouped = windows.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("turn", "__l", "__h", "positive_id", "positive_score"))).alias("__w"))
    asked = anchors.join(grouped, F.col("__row") == F.col("anchor"))
    asked = materialize(asked.select("__row", "__id", "__label", "__v", F.col("__w.__l").alias("__lo"), F.col("__w.__h").alias("__hi"), "__w"), "asked")
    found = _first(_scan_blocks(own, asked.select("__row", "__label", "__v", "__lo", "__hi"), blocks, k, same=False), k, ["anchor", "window"])
    said = asked.select("__row", F.col("__id").alias("anchor_id"), F.posexplode("__w").alias("window", "__p"))
    out = found.join(said, (F.col("anchor") == F.col("__row")) & (found["window"] == said["window"]))
    return out.select("anchor_id", F.col("__p.positive_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
                      F.col("__p.positive_score").alias("positive_score"), F.col("score").alias("negative_score"))
