"""N-gram Jaccard join by T-occurrence search.

Two sets of sizes m and n that are similar enough share at least T shingles.
Inverted lists are divided as in DivideSkip: the long ones come last in each
set's order, so that of its first (size - T + k) shingles, nearly all from
short lists, a similar set shares at least k. Short lists are merged and
occurrences counted (pairs below k are out); long lists are not merged but
probed, by binary search in the candidates' sorted sets.

A set with fewer short lists than that asks for fewer shared ones, down to
one. Only sets whose long lists alone could make them similar (large groups of
near copies) are found through long lists, the rarest ones first: rounds link
each to random members of its lists, then sets that are still in different
components are compared inside their list, in blocks of bounded size that are
joined block by block. Only components are asked for, so linked sets need no
more pairs. Equal sets are one class throughout.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limnos.llm.common import batches_of, bitmap, bitmap_has, materialize, partitions
from limnos.llm.components import connected
from limnos.llm.words import Words, mix64, sequence_hashes, shingle_sets, slices

#: a list with at least so many documents is long
LONG = 64
#: the longest lists, of those at least LONG, that come last in every set's
#: order: 12 MB; others of LONG and more are found while short ones are merged
LONG_LISTS = 1 << 20
#: sets of a list, and shingles of these, that are compared with as many others at once
BLOCK, BLOCK_SHINGLES = 1 << 10, 1 << 20
#: long lists in which a set meets a random member in a round
MEETINGS = 12
#: bytes of shingles that are dealt to blocks at once
DEALT_BYTES = 1 << 22
#: bytes of rows that a task hands to its Python worker at once: pairs carry both sets, so 10,000 of them can be far more
BATCH_BYTES = 1 << 23


def least_overlap(n: int | np.ndarray, percent: int):
    """The least overlap of a set of size n with any similar one."""
    return (percent * n + 99) // 100


def needed(n: int | np.ndarray, percent: int):
    """Occurrences that two similar sets share among their first shingles, k."""
    return 1 + least_overlap(n, percent) // 32


def class_ids(sets: list[np.ndarray]) -> np.ndarray:
    """A hash of each set: equal sets, equal ids."""
    if not sets:
        return np.zeros(0, np.int64)
    size = np.array([len(s) for s in sets])
    end = np.cumsum(size)
    return sequence_hashes(np.concatenate(sets), end - size, end).view(np.int64)


def profile(s: np.ndarray) -> bytes:
    """How many shingles fall into each of 2**b bins by hash, 2**b about a
    quarter of the set's size; two profiles bound the overlap from above."""
    bits = max(4, (len(s) // 4).bit_length())
    count = np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return count.astype("u1" if count.max(initial=0) < 256 else "<u4").tobytes()


def overlap_bound(a: bytes, b: bytes, m: int, n: int) -> int:
    """At least the overlap of the sets of sizes m and n with profiles a, b."""
    def read(x: bytes, size: int) -> np.ndarray:
        bins = 1 << max(4, (int(size) // 4).bit_length())
        return np.frombuffer(x, "u1" if len(x) == bins else "<u4").astype(np.int64)
    x, y = read(a, m), read(b, n)
    if len(x) > len(y):
        x, y = y, x
    return int(np.minimum(x, y.reshape(len(x), -1).sum(axis=1)).sum())


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    """How many shingles of the smaller set are in the larger one."""
    x, y = (a, b) if len(a) <= len(b) else (b, a)
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    return int((y[at] == x).sum())


def _similar(overlap, m, n, percent: int):
    return 100 * overlap >= percent * (m + n - overlap)


def _sized(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], np.ndarray]]:
    for whole in batches:
        for b in slices(whole):
            # words and their hashes take many times a text's bytes, so they are made of a quarter at a time
            sets = [s for part in slices(b, most=1 << 21) for s in shingle_sets(Words(part.column("text"), lower=True), k)]
            yield b, sets, class_ids(sets)


def _planes(x: np.ndarray) -> bytes:
    """Differences of ascending 32-bit numbers by byte planes; high ones are
    mostly zero, which Spark's shuffle compression takes out."""
    return np.diff(x, prepend=np.uint32(0)).astype("<u4").view("u1").reshape(-1, 4).T.tobytes()


def _unplanes(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(blob, "u1").reshape(4, -1).T.copy().view("<u4").ravel(), dtype=np.uint32)


class _Lists:
    """Which shingles have long lists. A list is named by its hash's first
    bits (32, and those that pick one of 2**bits pieces); lists that share a
    name count as one, which affects their order only."""

    def __init__(self, bits: int):
        self.bits, self.long = bits, np.zeros(0, np.uint64)
        #: places of ``long`` by length, shortest first
        self.rank: np.ndarray | None = None

    def name(self, s: np.ndarray) -> np.ndarray:
        return s >> np.uint64(32 - self.bits)

    def is_long(self, s: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.long, self.name(s))
        return self.long[np.minimum(at, len(self.long) - 1)] == self.name(s) if len(self.long) else np.zeros(len(s), bool)

    def rarest(self, s: np.ndarray) -> np.ndarray:
        """Ascending shingles with long lists, those of the shortest first."""
        return s if self.rank is None else s[np.argsort(self.rank[np.searchsorted(self.long, self.name(s))], kind="stable")]


def _measure(docs: DataFrame, k: int, lists: _Lists) -> DataFrame:
    """Kind 0: doc_id, n, class of each row. Kind 1: names of lists, ascending,
    once for each document that has the shingle."""
    def run(batches):
        for b, sets, classes in _sized(batches, k):
            size = np.array([len(s) for s in sets], np.int64)
            none = pa.nulls(len(size), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(size), np.int32)), b.column("doc_id"), pa.array(size), pa.array(classes), pa.array(np.full(len(size), -1)), none], names)
            every = np.sort(np.concatenate(sets)) if sets else np.zeros(0, np.uint64)
            name = lists.name(every)
            piece = (name >> np.uint64(32)).astype(np.int64)
            ends = np.searchsorted(piece, np.arange((1 << lists.bits) + 1))
            sub = name.astype(np.uint32)
            rows = [(p, _planes(sub[a:z])) for p, (a, z) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if z > a]
            n = len(rows)
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int32)), pa.nulls(n, b.schema.field("doc_id").type), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()),
                                              pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names)
    names = ["kind", "doc_id", "n", "class", "piece", "blob"]
    schema = T.StructType([T.StructField("kind", T.IntegerType()), docs.schema["doc_id"], T.StructField("n", T.LongType()), T.StructField("class", T.LongType()),
                           T.StructField("piece", T.LongType()), T.StructField("blob", T.BinaryType())])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _long_lists(measured: DataFrame, lists: _Lists) -> np.ndarray:
    def run(batches):
        current, held = None, []

        def decide():
            name, n = np.unique(np.concatenate([_unplanes(x) for x in held]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array((np.int64(current) << 32 | name[n >= LONG].astype(np.int64))), pa.array(n[n >= LONG])], ["name", "n"])
        for b in batches:
            for piece, blob in zip(b.column("piece").to_pylist(), b.column("blob").to_pylist(), strict=True):
                if piece != current and held:
                    yield decide()
                    held = []
                current = piece
                held.append(blob)
        if held:
            yield decide()
    n = partitions(measured)
    dealt = measured.filter("kind = 1").select("piece", "blob").repartition(n, "piece").sortWithinPartitions("piece")
    longest = dealt.mapInArrow(run, "name long, n long").orderBy(F.desc("n"), "name").limit(LONG_LISTS)
    found = longest.toArrow()
    name, size = found.column("name").to_numpy().astype(np.uint64), found.column("n").to_numpy()
    order = np.argsort(name)
    lists.rank = np.empty(len(name), np.uint32)
    lists.rank[np.lexsort((name[order], size[order]))] = np.arange(len(name))
    return name[order]


def _post(docs: DataFrame, k: int, percent: int, lists: _Lists, pieces: int) -> DataFrame:
    """Kind 0: for a piece, first shingles from short lists with class, size and
    how many of them a similar set shares (255 stands for more).
    Kind 1: a class's size and profile, and its first shingles from long lists
    (classes once a slice)."""
    shared = docs.sparkSession.sparkContext.broadcast(lists)

    def run(batches):
        for _, sets, classes in _sized(batches, k):
            short, owner, size, need, rows = [], [], [], [], []
            _, once = np.unique(classes, return_index=True)
            for i in once.tolist():
                s = sets[i]
                n = len(s)
                if not n:
                    continue
                far = shared.value.is_long(s)
                near, spare, times = s[~far], n - least_overlap(n, percent), needed(n, percent)
                # a similar set lacks ``spare`` of the shingles at most
                if len(near) > spare:
                    times = min(times, len(near) - spare)
                near = near[:spare + times]
                more = shared.value.rarest(s[far])[:spare + times - len(near)]
                short.append(near)
                need.append(np.full(len(near), min(times, 255), np.uint8))
                owner.append(np.full(len(near), classes[i]))
                size.append(np.full(len(near), n))
                rows.append((1, -1, int(classes[i]), n, more.astype("<u8").tobytes(), profile(s), None, None))
            if short:
                s, o, n, k_ = np.concatenate(short), np.concatenate(owner), np.concatenate(size), np.concatenate(need)
                piece = (s % np.uint64(pieces)).astype(np.int64)
                order = np.argsort(piece, kind="stable")
                ends = np.searchsorted(piece[order], np.arange(pieces + 1))
                for p, (a, z) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                    if z > a:
                        at = order[a:z]
                        rows.append((0, p, None, None, s[at].astype("<u8").tobytes(), o[at].astype("<i8").tobytes(), n[at].astype("<u4").tobytes(), k_[at].tobytes()))
            cols = list(zip(*rows, strict=True)) or [()] * 8
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["kind", "piece", "class", "n", "shingles", "other", "sizes", "needs"])
    return docs.select("text").mapInArrow(run, "kind int, piece int, class long, n long, shingles binary, other binary, sizes binary, needs binary")


def _merged(posted: DataFrame, pieces: int, each: Callable, schema: str) -> DataFrame:
    """``each`` of a piece's postings: shingles, classes, sizes, needs, sorted
    and distinct, and the first place and length of each list."""
    def run(batches):
        current, held = None, []

        def lists():
            s, o, n, k = (np.concatenate([np.frombuffer(r[i], t) for r in held]) for i, t in enumerate(("<u8", "<i8", "<u4", "u1")))
            order = np.lexsort((o, s))
            s, o, n, k = s[order], o[order], n[order].astype(np.int64), k[order]
            fresh = np.ones(len(s), bool)
            fresh[1:] = (s[1:] != s[:-1]) | (o[1:] != o[:-1])
            s, o, n, k = s[fresh], o[fresh], n[fresh], k[fresh]
            head = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            return each(s, o, n, k, head, np.diff(np.append(head, len(s))))
        for batch in batches:
            for piece, *row in zip(*[batch.column(c).to_pylist() for c in ("piece", "shingles", "other", "sizes", "needs")], strict=True):
                if piece != current and held:
                    yield from lists()
                    held = []
                current = piece
                held.append(row)
        if held:
            yield from lists()
    dealt = posted.filter("kind = 0").select("piece", "shingles", "other", "sizes", "needs").repartition(pieces, "piece").sortWithinPartitions("piece")
    return dealt.mapInArrow(run, schema)


def _merge(posted: DataFrame, percent: int, pieces: int) -> DataFrame:
    """a, b: pairs of classes that meet often enough in lists of fewer than
    LONG, a piece at a time."""
    most = LONG

    def pairs(s, o, n, k, head, length):
        a, b = [], []
        for m in np.unique(length[(length > 1) & (length < most)]).tolist():
            x, y = np.triu_indices(m, 1)
            first = head[length == m]
            step = max(1, (1 << 20) // len(x))
            for lo in range(0, len(first), step):
                i, j = (first[lo:lo + step, None] + x).ravel(), (first[lo:lo + step, None] + y).ravel()
                fit = 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
                a.append(i[fit])
                b.append(j[fit])
        if not a:
            return
        i, j = np.concatenate(a), np.concatenate(b)
        x, y, need = o[i], o[j], np.minimum(k[i], k[j]).astype(np.int64)
        order = np.lexsort((y, x))
        x, y, need = x[order], y[order], need[order]
        head = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])) if len(x) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(x[head]), pa.array(y[head]), pa.array(np.diff(np.append(head, len(x)))), pa.array(need[head])], ["a", "b", "times", "need"])
    met = _merged(posted, pieces, pairs, "a long, b long, times long, need long")
    return met.groupBy("a", "b").agg(F.sum("times").alias("times"), F.max("need").alias("need")).filter("times >= need").select("a", "b")


def _crowded(posted: DataFrame, pieces: int) -> DataFrame:
    """list, class: members of lists that _merge leaves out, there only if
    there are more than LONG_LISTS long ones."""
    least = LONG

    def members(s, o, n, k, head, length):
        long = np.repeat(length >= least, length)
        yield pa.RecordBatch.from_arrays([pa.array(s[long].view(np.int64)), pa.array(o[long])], ["list", "class"])
    return _merged(posted, pieces, members, "list long, class long")


def _bounded(pairs: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    """The pairs whose profiles allow them to be similar."""
    def side(c):
        return info.select(F.col("class").alias(c), F.col("n").alias(f"n{c}"), F.col("profile").alias(f"p{c}"))

    def run(batches):
        for b in batches:
            keep = [_similar(overlap_bound(p, q, m, n), m, n, percent) for m, p, n, q in zip(*[b.column(c).to_pylist() for c in ("na", "pa", "nb", "pb")], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "pa", "nb", "pb").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that are similar: each shingle of the smaller set is probed
    for in the larger one."""
    def side(c):
        return sets.select(F.col("class").alias(c), F.col("shingles").alias(f"s{c}"))

    def run(batches):
        for b in batches:
            keep = []
            for p, q in zip(b.column("sa").to_pylist(), b.column("sb").to_pylist(), strict=True):
                x, y = np.frombuffer(p, "<u8"), np.frombuffer(q, "<u8")
                keep.append(_similar(_overlap(x, y), len(x), len(y), percent))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _dealt(rows: DataFrame, percent: int) -> DataFrame:
    """Rows with the block pairs that they belong to: block (its list and two
    block numbers) and side (0, 1, or 2 for both). A list that is too large for
    a block is divided into bands of sizes, of which only neighbours can hold
    similar sets, and these by a hash into blocks of bounded size."""
    ratio = float(np.log(100.01 / percent))
    sized = rows.select("list", "n", F.floor(F.log("n") / F.lit(ratio)).alias("band"))
    bands = sized.groupBy("list", "band").agg(F.count("n").alias("m"), F.sum("n").alias("w"))
    lists = bands.groupBy("list").agg(F.sum("m").alias("m"), F.sum("w").alias("w"), F.collect_list(F.struct("band", "m", "w")).alias("bands"))
    large = lists.filter((F.col("m") > BLOCK) | ((F.col("w") > BLOCK_SHINGLES) & (F.col("m") > 1))).select("list", "bands").collect()
    plan = {r["list"]: {b["band"]: max(-(-b["m"] // BLOCK), -(-b["w"] // BLOCK_SHINGLES)) for b in r["bands"]} for r in large}
    shared = rows.sparkSession.sparkContext.broadcast(plan)

    def deal(batches):
        for b in batches:
            row, block, side = [], [], []
            for i, (name, class_, band) in enumerate(zip(*[b.column(c).to_pylist() for c in ("list", "class", "band")], strict=True)):
                of = shared.value.get(name)
                if of is None:
                    row.append(i)
                    block.append(f"{name}")
                    side.append(2)
                    continue
                own = int(mix64(np.array([class_], np.int64).view(np.uint64))[0] % np.uint64(of[band]))
                places = [(band, j) for j in range(of[band])]
                places += [(near, j) for near in (band - 1, band + 1) for j in range(of.get(near, 0))]
                for other in places:
                    row.append(i)
                    lo, hi = sorted(((band, own), other))
                    block.append(f"{name} {lo[0]}.{lo[1]} {hi[0]}.{hi[1]}")
                    side.append(2 if lo == hi else int((band, own) == hi))
            # a row has many copies: a few at a time, as their bytes allow
            heavy = np.array([len(x) for x in b.column("shingles").to_pylist()] or [0])[row].cumsum() if row else np.zeros(0, np.int64)
            lo = 0
            while lo < len(row):
                hi = max(lo + 1, int(np.searchsorted(heavy, (heavy[lo - 1] if lo else 0) + DEALT_BYTES)))
                copies = pa.array(row[lo:hi], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(block[lo:hi], pa.string()), pa.array(side[lo:hi], pa.int32()), *[b.column(c).take(copies) for c in names]], ["block", "side", *names])
                lo = hi
    names = rows.columns
    schema = T.StructType([T.StructField("block", T.StringType()), T.StructField("side", T.IntegerType()), *rows.schema])
    return rows.withColumn("band", F.floor(F.log("n") / F.lit(ratio))).mapInArrow(deal, schema)


def _within_lists(rows: DataFrame, percent: int) -> DataFrame:
    """Links between a list's classes in different components, as many as
    connect them. A pair that shares several long lists is looked at in the
    first of them alone. Rows: list, class, component, n, profile, all (the
    class's long lists), shingles."""
    def run(batches):
        current, held = None, []

        def compare():
            held.sort(key=lambda r: (r[3], r[1]))
            size = np.array([r[3] for r in held])
            part = np.unique([r[2] for r in held], return_inverse=True)[1]
            side = np.array([r[6] for r in held])
            own = [set(np.frombuffer(r[5], "<u8").tolist()) for r in held]
            sets = [np.frombuffer(r[7], "<u8") for r in held]
            bins = np.array([1 << max(4, (int(n) // 4).bit_length()) for n in size])
            folded: dict[int, tuple[int, np.ndarray]] = {}
            first = held[0][0] % (1 << 64)
            a, b = [], []
            for i in range(len(held)):
                end = int(np.searchsorted(size, size[i] * 100 // percent, side="right"))
                other = i + 1 + np.flatnonzero((part[i + 1:end] != part[i]) & ((side[i + 1:end] != side[i]) | (side[i] == 2)))
                if not len(other):
                    continue
                if bins[i] not in folded:  # profiles of this and larger sets, by as many bins as this one's
                    rows = [np.frombuffer(r[4], "u1" if len(r[4]) == k else "<u4").reshape(bins[i], -1).sum(axis=1) for r, k in zip(held[i:], bins[i:].tolist(), strict=True)]
                    folded[bins[i]] = i, np.stack(rows).astype(np.uint32)
                base, matrix = folded[bins[i]]
                bound = np.minimum(matrix[i - base], matrix[other - base]).sum(axis=1, dtype=np.int64)
                for j in other[_similar(np.minimum(bound, size[i]), size[i], size[other], percent)].tolist():
                    if part[i] != part[j] and min(own[i] & own[j], default=-1) == first and _similar(_overlap(sets[i], sets[j]), size[i], size[j], percent):
                        a.append(held[i][1])
                        b.append(held[j][1])
                        part[part == part[j]] = part[i]
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        for batch in batches:
            for name, *row in zip(*[batch.column(c).to_pylist() for c in ("block", "list", "class", "component", "n", "profile", "all", "side", "shingles")], strict=True):
                if name != current and held:
                    yield compare()
                    held = []
                current = name
                held.append(row)
        if held:
            yield compare()
    n = partitions(rows)
    return _dealt(rows, percent).repartition(n, "block").sortWithinPartitions("block").mapInArrow(run, "a long, b long")


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    named = labels.select(F.col("node").alias("class"), "component")
    return rows.join(named, "class", "left").withColumn("component", F.coalesce("component", "class"))


def _through_long_lists(info: DataFrame, crowded: DataFrame | None, sets: DataFrame, edges: DataFrame, percent: int) -> DataFrame:
    """``edges`` with those added that components need and only long lists
    show."""
    def explode(batches):
        for b in batches:
            lists = [np.frombuffer(x, "<u8").view(np.int64) for x in b.column("shingles").to_pylist()]
            row = pa.array(np.repeat(np.arange(len(lists)), [len(x) for x in lists]))
            flat = np.concatenate(lists) if lists else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat), b.column("class").take(row)], ["list", "class"])
    users = info.filter(F.length("shingles") > 0)
    members = users.select("class", "shingles").mapInArrow(explode, "list long, class long")
    members = materialize(members if crowded is None else members.unionByName(crowded), "members")
    if members.isEmpty():
        return edges
    open_before = None
    for turn in range(64):
        labelled = materialize(_labelled(members, connected(edges)), "labelled")
        open_ = labelled.groupBy("list").agg(F.min("component").alias("least"), F.max("component").alias("most")).filter("least < most")
        rows = labelled.join(open_.select("list"), "list")
        count = rows.select("component").distinct().count()
        if count < 2:
            return edges
        if open_before is not None and count > 0.7 * open_before:
            break  # random meetings find little more
        open_before = count
        # a class meets, in some of its lists, the member that a hash picks there
        pick = F.xxhash64("list", "class", F.lit(turn))
        leader = rows.groupBy("list").agg(F.min_by(F.struct("class", "component"), pick).alias("leader"))
        order = Window.partitionBy("class").orderBy(F.xxhash64("list", F.lit(turn)), "list")
        some = rows.withColumn("turn", F.row_number().over(order)).filter(F.col("turn") <= MEETINGS)
        met = some.join(leader, "list").filter(F.col("component") != F.col("leader.component"))
        pairs = met.select(F.least("class", "leader.class").alias("a"), F.greatest("class", "leader.class").alias("b")).distinct()
        found = _verified(_bounded(pairs, info, percent), sets, percent)
        edges = materialize(edges.unionByName(found), "edges")
    every = members.groupBy("class").agg(F.collect_list("list").alias("lists")).mapInArrow(_packed, "class long, all binary")
    wide = rows.join(info.select("class", "n", "profile").join(every, "class").join(sets, "class"), "class")
    left = _within_lists(wide.select("list", "class", "component", "n", "profile", "all", "shingles"), percent)
    return edges.unionByName(left)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        blobs = [np.array(x, "<i8").tobytes() for x in b.column("lists").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("class"), pa.array(blobs, pa.binary())], ["class", "all"])


def components(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id. Documents
    link when their sets of ``k``-word shingles (of lower-cased words) have a
    Jaccard similarity of ``percent`` or more; component_id is the least doc_id
    reachable by links.

    Defined cases: a document of fewer than k words has its word sequence as
    one shingle; one without words or text has none, links with nothing and
    is its own component; rows with one doc_id are documents of their own; a
    null doc_id links as others do, but names no component (null if alone);
    an empty table gives no rows; other columns are not read.
    """
    with batches_of(docs.sparkSession, BATCH_BYTES):
        return _components(docs, k, percent)


def _components(docs: DataFrame, k: int, percent: int) -> DataFrame:
    pieces = partitions(docs)
    lists = _Lists(max(1, min(16, (pieces - 1).bit_length())))
    measured = materialize(_measure(docs, k, lists), "measured")
    lists.long = _long_lists(measured, lists)
    posted = materialize(_post(docs, k, percent, lists, pieces), "postings")
    info = posted.filter("kind = 1").select("class", "n", "shingles", F.col("other").alias("profile")).dropDuplicates(["class"])
    info = materialize(info, "classes")
    pairs = materialize(_bounded(_merge(posted, percent, pieces), info, percent), "pairs")
    crowded = materialize(_crowded(posted, pieces), "crowded") if len(lists.long) >= LONG_LISTS else None
    wanted = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).union(info.filter(F.length("shingles") > 0).select("class"))
    wanted = wanted if crowded is None else wanted.union(crowded.select("class"))
    filter_ = docs.sparkSession.sparkContext.broadcast(bitmap(wanted))

    def gather(batches):
        for _, sets, classes in _sized(batches, k):
            _, once = np.unique(classes, return_index=True)
            once = [i for i in once[bitmap_has(filter_.value, classes[once])].tolist() if len(sets[i])]
            yield pa.RecordBatch.from_arrays([pa.array(classes[once]), pa.array([sets[i].astype("<u8").tobytes() for i in once], pa.binary())], ["class", "shingles"])
    sets = materialize(docs.select("text").mapInArrow(gather, "class long, shingles binary").dropDuplicates(["class"]), "sets")
    edges = materialize(_verified(pairs, sets, percent), "edges")
    labels = connected(_through_long_lists(info, crowded, sets, edges, percent))
    rows = _labelled(measured.filter("kind = 0").select("doc_id", "n", "class"), labels)
    least = rows.filter("n > 0").groupBy("component").agg(F.min("doc_id").alias("least"))
    out = rows.join(least, "component", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))
