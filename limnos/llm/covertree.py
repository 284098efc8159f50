"""Embedding near-duplicates by dual traversal of cover trees.

Unit vectors link when their distance is at most sqrt(2 - 2 cos). Vectors go
to the nearest of a bounded set of pivots, and each cell, cut at random into
blocks of bounded size, becomes a cover tree: nested levels with halving
radii, every node covering its points within the radius it keeps. A pair of
nodes is pruned if even their closest points are too far apart, taken whole
if even their farthest ones are close enough (counts grow by the nodes'
sizes, no pair is written), and split otherwise, down to pairs of vectors,
which are decided by their cosine in double precision. Equal vectors are one
class throughout. A task compares two blocks and returns, for each class that
links, a count and one edge.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limnos.llm.common import materialize, partitions, running_sum
from limnos.llm.components import connected

#: vectors in a block, at most about twice as many
BLOCK = 8192
#: cells, at most: their pivots go to every task
PIVOTS = 1024
#: nodes that are compared with others at once
_STRIP = 256
#: pairs whose cosines are computed in double precision at once
_EXACT = 1 << 15
_SLACK = 1e-9


class Tree:
    """Cover tree over unit vectors. Points are reordered so that every node
    covers a range of them; ``levels`` holds for each level the nodes' centres
    (point numbers), first and last points, radii, and each node's children as
    a range of the next level's nodes (a leaf has none)."""

    def __init__(self, points: np.ndarray):
        mean = points.mean(axis=0)
        centre = int((points @ mean).argmax())
        order, nodes = np.arange(len(points)), [(centre, np.arange(len(points)), self._far(points, centre, np.arange(len(points))))]
        radius = 2.0 ** math.ceil(math.log2(max(nodes[0][2], 1e-12)))
        self.levels = []
        while True:
            first = np.cumsum([0, *(len(p) for _, p, _ in nodes)])
            order = np.concatenate([p for _, p, _ in nodes])
            level = {"centre": np.array([c for c, _, _ in nodes]), "begin": first[:-1], "end": first[1:], "radius": np.array([r for _, _, r in nodes])}
            self.levels.append(level)
            if not level["radius"].any():
                break
            radius /= 2
            below, kids = [], [0]
            for c, p, r in nodes:
                below += self._split(points, c, p, radius) if r > 0 else [(c, p, 0.0)]
                kids.append(len(below))
            level["kids"] = np.array(kids)
            nodes = below
        # levels refer to points by their final places
        place = np.empty(len(points), np.int64)
        place[order] = np.arange(len(points))
        for level in self.levels:
            level["centre"] = place[level["centre"]]
        self.order = order

    @staticmethod
    def _far(points: np.ndarray, centre: int, members: np.ndarray) -> float:
        if len(members) == 1:
            return 0.0
        return float(np.sqrt(((points[members] - points[centre]) ** 2).sum(axis=1).max()))

    def _split(self, points: np.ndarray, centre: int, members: np.ndarray, radius: float) -> list[tuple[int, np.ndarray, float]]:
        """Children that cover the members within the radius: the node's own
        centre first, then members that are left over. Points that radii can
        no longer tell apart become leaves."""
        out, left = [], members
        while len(left):
            if radius < 1e-7:
                return out + [(int(i), np.array([i]), 0.0) for i in left]
            near = 2 - 2 * (points[left] @ points[centre]) <= radius * radius
            near |= left == centre
            mine, left = left[near], left[~near]
            out.append((centre, mine, self._far(points, centre, mine)))
            if len(left):
                centre = int(left[0])
        return out


class Block:
    """A tree with its points, classes and how many vectors each class has."""

    def __init__(self, points: np.ndarray, classes: np.ndarray, copies: np.ndarray):
        tree = Tree(points)
        self.points, self.classes, self.copies, self.levels = points[tree.order], classes[tree.order], copies[tree.order], tree.levels
        self.total = np.concatenate([[0], np.cumsum(self.copies)])


def _groups(radius: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of ascending radii that are zero, or differ by about half."""
    cuts = np.unique(np.searchsorted(radius, [-1.0, 0.0, 0.0625, 0.125, 0.25, 0.5, 1.0, 4.0], side="right"))
    return list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))


class Traversal:
    """Links between two blocks, or inside one. Pairs of nodes of one level are
    open until they are pruned, taken whole or decided; the children of open
    pairs are compared a strip at a time, in single precision where that
    decides, else in double."""

    def __init__(self, left: Block, right: Block | None, cosine: float):
        self.a, self.b, self.same = left, right or left, right is None
        self.cosine, self.reach = cosine, math.sqrt(2 - 2 * cosine)
        # what single precision can be off by: of a cosine, of a distance
        self.off = 2e-7 * left.points.shape[1] + 1e-6
        self.slack = math.sqrt(2 * self.off)
        self.single = left.points.astype(np.float32), self.b.points.astype(np.float32)
        self.shift = 0 if self.same else len(left.points)
        size = self.shift + len(self.b.points)
        self.links, self.label = np.zeros(size, np.int64), np.arange(size)
        # differences along points: links of ranges, ranges linked inside, points joined to the next one
        self.more, self.inside, self.glued = (np.zeros(size + 1, np.int64) for _ in range(3))
        self.visit(-1, np.zeros(1, np.int64), np.zeros(1, np.int64))
        next_ = np.flatnonzero(np.cumsum(self.glued) > 0)
        self.union(next_, next_ + 1)
        copies = self.a.copies if self.same else np.concatenate([self.a.copies, self.b.copies])
        self.links = np.cumsum(self.more)[:-1] - np.cumsum(self.inside)[:-1] * copies

    def union(self, i: np.ndarray, j: np.ndarray) -> None:
        """Joins the components of i[k] and j[k] for each k."""
        while len(i):
            x, y = self.label[i], self.label[j]
            open_ = x != y
            if not open_.any():
                return
            i, j, x, y = i[open_], j[open_], x[open_], y[open_]
            low = np.minimum(x, y)
            np.minimum.at(self.label, x, low)
            np.minimum.at(self.label, y, low)
            while True:
                up = self.label[self.label]
                if (up == self.label).all():
                    break
                self.label = up

    def spread(self, begin: np.ndarray, end: np.ndarray, links: np.ndarray) -> None:
        """All points of each range link with so many vectors, and are of one
        component."""
        np.add.at(self.more, begin, links)
        np.subtract.at(self.more, end, links)
        np.add.at(self.glued, begin, 1)
        np.subtract.at(self.glued, end - 1, 1)

    def take(self, la: dict, lb: dict, u: np.ndarray, v: np.ndarray) -> None:
        """All points of nodes u[k] of a link with all of nodes v[k] of b."""
        x, y = (la["begin"][u], la["end"][u]), (lb["begin"][v], lb["end"][v])
        self.spread(*x, self.b.total[y[1]] - self.b.total[y[0]])
        self.spread(y[0] + self.shift, y[1] + self.shift, self.a.total[x[1]] - self.a.total[x[0]])
        self.union(x[0], y[0] + self.shift)

    def take_inside(self, level: dict, u: np.ndarray) -> None:
        """All points of each node link with one another."""
        begin, end = level["begin"][u], level["end"][u]
        self.spread(begin, end, self.a.total[end] - self.a.total[begin])
        np.add.at(self.inside, begin, 1)
        np.subtract.at(self.inside, end, 1)

    @staticmethod
    def level(block: Block, level: int) -> dict:
        return block.levels[min(level, len(block.levels) - 1)]

    @staticmethod
    def children(block: Block, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Children of nodes on the next level (the root's level is 0) and the
        places of their parents in ``nodes``. Below its last level a tree goes
        on as it is."""
        if level < 0 or level >= len(block.levels) - 1:
            return nodes, np.arange(len(nodes))
        kids = block.levels[level]["kids"]
        many = kids[nodes + 1] - kids[nodes]
        parent = np.repeat(np.arange(len(nodes)), many)
        return np.arange(len(parent)) - np.repeat(np.cumsum(many) - many, many) + kids[nodes][parent], parent

    def visit(self, level: int, x: np.ndarray, y: np.ndarray) -> None:
        """Open pairs of a level, ascending by x; x = y inside one block is a
        node against itself."""
        xs, at = np.unique(x, return_inverse=True)
        rows, parent = self.children(self.a, level, xs)
        # batches of nodes with about a strip of children, or one node with more
        batch = (np.searchsorted(parent, np.arange(len(xs))) // _STRIP)
        for k in np.unique(batch).tolist():
            lo, hi = np.searchsorted(batch, [k, k + 1])
            mine = slice(*np.searchsorted(at, [lo, hi]))
            ys, other = np.unique(y[mine], return_inverse=True)
            open_ = np.zeros((hi - lo, len(ys)), bool)
            open_[at[mine] - lo, other] = True
            cols, of = self.children(self.b, level, ys)
            first, last = np.searchsorted(parent, [lo, hi])
            for s in range(first, last, _STRIP):
                part = slice(s, min(s + _STRIP, last))
                left = self.compare(level + 1, rows[part], parent[part] - lo, cols, of, open_)
                if len(left[0]):
                    self.visit(level + 1, *left)

    def compare(self, level: int, rows: np.ndarray, row_of: np.ndarray, cols: np.ndarray, col_of: np.ndarray, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nodes ``rows`` against ``cols`` where their parents are open; the
        pairs that stay open."""
        la, lb = self.level(self.a, level), self.level(self.b, level)
        p, q = np.argsort(la["radius"][rows], kind="stable"), np.argsort(lb["radius"][cols], kind="stable")
        rows, row_of, cols, col_of = rows[p], row_of[p], cols[q], col_of[q]
        ra, rb, ca, cb = la["radius"][rows], lb["radius"][cols], la["centre"][rows], lb["centre"][cols]
        cos = self.single[0][ca] @ self.single[1][cb].T
        # nodes of about one radius have one bound
        found = []
        for a, b in _groups(ra):
            for c, d in _groups(rb):
                far = self.reach + self.slack + ra[b - 1] + rb[d - 1]
                least = self.cosine if ra[b - 1] + rb[d - 1] == 0 else 1 - far * far / 2 if far < 2 else -2.0
                i, j = np.nonzero(cos[a:b, c:d] >= least - self.off)
                found.append((i + a, j + c))
        i, j = (np.concatenate(f) for f in zip(*found, strict=True))
        keep = open_[row_of[i], col_of[j]]
        if self.same:
            keep &= rows[i] <= cols[j]
        i, j = i[keep], j[keep]
        if self.same:
            itself = rows[i] == cols[j]
            u = rows[i[itself]]
            i, j = i[~itself], j[~itself]
            u = u[la["end"][u] - la["begin"][u] > 1]
            whole = (la["radius"][u] == 0) | (2 * la["radius"][u] <= self.reach - self.slack)
            self.take_inside(la, u[whole])
            u = u[~whole]
        else:
            u = np.zeros(0, np.int64)
        near, radii = cos[i, j].astype(np.float64), ra[i] + rb[j]
        single = radii == 0
        linked = single & (near >= self.cosine + self.off)
        doubt = np.flatnonzero(single & ~linked & (near >= self.cosine - self.off))
        for lo in range(0, len(doubt), _EXACT):
            some = doubt[lo:lo + _EXACT]
            linked[some] = np.einsum("ij,ij->i", self.a.points[ca[i[some]]], self.b.points[cb[j[some]]]) >= self.cosine
        distance = np.sqrt(np.maximum(0, 2 - 2 * near))
        whole = linked | (~single & (distance + radii <= self.reach - self.slack))
        self.take(la, lb, rows[i[whole]], cols[j[whole]])
        split = ~single & ~whole & (distance - radii <= self.reach + self.slack)
        x, y = np.concatenate([u, rows[i[split]]]), np.concatenate([u, cols[j[split]]])
        order = np.argsort(x, kind="stable")
        return x[order], y[order]

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each class that links: class, links, a class it is joined to."""
        classes = self.a.classes if self.same else np.concatenate([self.a.classes, self.b.classes])
        some = np.flatnonzero(self.links)
        return classes[some], self.links[some], classes[self.label[some]]


def _valid(vectors: DataFrame, id_col: str, column: str) -> DataFrame:
    """vec_id, class, dim and vector (unit, as bytes) of every row; class is
    null for a vector that links with nothing."""
    schema = T.StructType([vectors.schema[id_col], T.StructField("class", T.LongType()), T.StructField("dim", T.IntegerType()), T.StructField("vector", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for v in b.column(column):
                x = np.zeros(0) if not v.is_valid else v.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
                if v.is_valid and v.values.null_count:
                    x = np.zeros(0)
                norm = math.sqrt(float(x @ x)) if len(x) and np.isfinite(x).all() else 0.0
                if len(x) and not 0 < norm < math.inf and np.isfinite(x).all() and x.any():
                    x = x / np.abs(x).max()  # squares that over- or underflow
                    norm = math.sqrt(float(x @ x))
                if 0 < norm < math.inf:
                    raw = (x + 0.0).tobytes()
                    rows.append((int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True), len(x), (x / norm).tobytes()))
                else:
                    rows.append((None, None, None))
            cols = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())], schema.names)
    return vectors.select(id_col, column).mapInArrow(run, schema)


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Vectors link at a cosine of ``cosine`` or more; n_links counts the others
    that a vector links with, copies included; component_id is the least
    vec_id reachable. Defined cases: a vector that is null, empty, zero or
    holds a null or non-finite component links with nothing and is its own
    component; vectors of different lengths do not link; rows with one vec_id
    are vectors of their own; a null vec_id links as others do but names no
    component; an empty table gives no rows; other columns are not read.
    """
    n = partitions(vectors)
    rows = materialize(_valid(vectors, id_col, column), "vectors")
    classes = materialize(rows.filter("class IS NOT NULL").groupBy("class").agg(F.count("*").alias("copies"), F.first("dim").alias("dim"), F.first("vector").alias("vector")), "classes")
    cells = max(1, min(PIVOTS, -(-classes.count() // BLOCK)))
    # classes are hashes, so the least ones are a random sample
    pivots: dict[int, np.ndarray] = {}
    for r in classes.orderBy("class").limit(cells).select("dim", "vector").collect():
        x = np.frombuffer(r["vector"])[None]
        pivots[r["dim"]] = np.concatenate([pivots[r["dim"]], x]) if r["dim"] in pivots else x
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dim, cell = b.column("dim").to_numpy(), np.full(b.num_rows, -1, np.int32)
            for d in np.unique(dim).tolist():
                if d in shared.value:
                    at = np.flatnonzero(dim == d)
                    raw = b.column("vector").take(pa.array(at)).to_pylist()
                    cell[at] = (np.frombuffer(b"".join(raw)).reshape(-1, d) @ shared.value[d].T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([b.column("class"), b.column("copies"), b.column("dim"), pa.array(cell), b.column("vector")], ["class", "copies", "dim", "cell", "vector"])
    placed = materialize(classes.select("class", "copies", "dim", "vector").mapInArrow(assign, "class long, copies long, dim int, cell int, vector binary"), "cells")
    sizes = placed.groupBy("dim", "cell").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    cut = placed.join(sizes, ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts")))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, []

        def block() -> pa.RecordBatch:
            made = Block(np.frombuffer(b"".join(r[2] for r in held)).reshape(len(held), -1), np.array([r[0] for r in held]), np.array([r[1] for r in held]))
            top = made.levels[0]
            return pa.RecordBatch.from_pylist([dict(dim=name[0], cell=name[1], part=name[2], centre=made.points[top["centre"][0]].tolist(), radius=float(top["radius"][0]), tree=pickle.dumps(made))], built)
        for b in batches:
            for dim, cell, part, *row in zip(*[b.column(c).to_pylist() for c in ("dim", "cell", "part", "class", "copies", "vector")], strict=True):
                if (dim, cell, part) != name and held:
                    yield block()
                    held = []
                name = dim, cell, part
                held.append(row)
        if held:
            yield block()
    built = pa.schema([("dim", pa.int32()), ("cell", pa.int32()), ("part", pa.int64()), ("centre", pa.list_(pa.float64())), ("radius", pa.float64()), ("tree", pa.binary())])
    dealt = cut.select("dim", "cell", "part", "class", "copies", "vector").repartition(n, "dim", "cell", "part").sortWithinPartitions("dim", "cell", "part")
    blocks = materialize(dealt.mapInArrow(build, "dim int, cell int, part long, centre array<double>, radius double, tree binary"), "blocks")
    blocks = materialize(blocks.withColumn("block", F.monotonically_increasing_id()), "numbered")
    # numbers without gaps: files' offsets, one row a file
    order = running_sum(blocks.select("block").withColumn("one", F.lit(1)), [], ["block"], {"number": "one"})
    blocks = materialize(blocks.join(order, "block").drop("block"), "blocks")
    count = blocks.count()
    meta = blocks.select("number", "dim", "centre", "radius")
    left = meta.select(F.col("number").alias("i"), F.col("dim").alias("di"), F.col("centre").alias("ci"), F.col("radius").alias("ri"))
    right = meta.select(F.col("number").alias("j"), F.col("dim").alias("dj"), F.col("centre").alias("cj"), F.col("radius").alias("rj"))
    pairs = left.withColumn("j", F.explode(F.sequence(F.col("i"), F.lit(max(0, count - 1))))).join(right, "j").filter("di = dj")
    square = F.aggregate(F.zip_with("ci", "cj", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x)
    reach = math.sqrt(2 - 2 * cosine) + _SLACK
    pairs = pairs.filter(F.sqrt(square) - F.col("ri") - F.col("rj") <= reach).select("i", "j")
    trees = blocks.select("number", "tree")
    work = pairs.join(trees.select(F.col("number").alias("i"), F.col("tree").alias("ti")), "i")
    work = work.join(trees.select(F.col("number").alias("j"), F.col("tree").alias("tj")), "j").withColumn("tj", F.when(F.col("i") != F.col("j"), F.col("tj")))

    def traverse(group: pa.Table) -> pa.Table:
        out = []
        for ti, tj in zip(group.column("ti").to_pylist(), group.column("tj").to_pylist(), strict=True):
            out.append(Traversal(pickle.loads(ti), pickle.loads(tj) if tj else None, cosine).result())
        cols = [np.concatenate(x) for x in zip(*out, strict=True)]
        return pa.table({"class": pa.array(cols[0], pa.int64()), "links": pa.array(cols[1], pa.int64()), "joined": pa.array(cols[2], pa.int64())})
    linked = materialize(work.select("i", "j", "ti", "tj").groupBy("i", "j").applyInArrow(traverse, "class long, links long, joined long"), "links")
    labels = connected(linked.select(F.col("class").alias("a"), F.col("joined").alias("b"))).withColumnRenamed("node", "class")
    total = linked.groupBy("class").agg(F.sum("links").alias("links"))
    named = classes.select("class", "copies").join(total, "class", "left").join(labels, "class", "left")
    named = named.select("class", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "class").alias("component"))
    out = rows.select(F.col(id_col).alias("vec_id"), "class").join(named, "class", "left")
    least = out.filter("class IS NOT NULL").groupBy("component").agg(F.min("vec_id").alias("least"))
    out = out.join(least, "component", "left")
    component = F.when(F.col("class").isNotNull(), F.col("least")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
