"""Quality classifier: a byte-level convolutional network.

Filters of WIDTH bytes slide over the whole text. Over blocks of STEP
positions their responses are reduced to greatest and mean values; a chunk is
two neighbouring blocks, so chunks overlap by half and cover the text. A
hidden layer reads each chunk, its units are max-pooled over all chunks, and
a logistic unit combines them into one probability.

Fitting is numpy in one task, over a bounded sample of chunks that tasks cut
out; scoring runs in all tasks over whole texts, a slice at a time. A filter
reads bytes through fixed codes, so for scoring the filters are folded into
tables by byte pair.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from limnos.llm.common import materialize
from limnos.llm.words import mix64, slices, text_bytes

#: distinct labelled texts of each class that the network is fitted on, at most
SAMPLE = 500
#: blocks of a sampled text that are fitted on, at most, in runs of two spread evenly over it
SAMPLE_BLOCKS = 8
#: bytes under a filter (even), filters, hidden units
WIDTH, FILTERS, HIDDEN = 6, 16, 16
#: positions of a block; a chunk has two
STEP = 256
#: a block with fewer positions counts as one of so many that are silent, so a few words are no evidence
LEAST = 64
EPOCHS, BATCH, RATE = 12, 32, 0.01
#: blocks that are scored at once
_RUN = 64


def _codes() -> np.ndarray:
    """What filters see of a byte: kinds of characters, then numbers that tell
    bytes apart. Byte 0 pads texts; it and all its numbers are zero."""
    b = np.arange(256)
    kinds = [(b >= 97) & (b <= 122), (b >= 65) & (b <= 90), (b >= 48) & (b <= 57), (b == 32) | (b == 10) | (b == 9),
             np.isin(b, list(b".,;:!?'\"-()")), (b > 32) & (b < 127) & ~np.isin(b, list(b".,;:!?'\"-()")) & ~np.char.isalnum(np.array([chr(x) for x in b])), b >= 128]
    spread = np.stack([(mix64(np.arange(256, dtype=np.uint64) + np.uint64(997 * (i + 1))) >> np.uint64(40)).astype(np.float64) / (1 << 23) - 1 for i in range(5)])
    out = np.concatenate([np.array(kinds, np.float64), 0.7 * spread]).T
    out[0] = 0
    return out.astype(np.float32)


CODES = _codes()


def _blocks(raw: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Padded bytes, of which each text fills whole blocks (one at least) and
    leaves WIDTH - 1 pads at its end; blocks of each text; which bytes are
    the text's (a zero byte counts as a pad)."""
    size = np.diff(borders)
    count = np.maximum(1, -(-(size + WIDTH - 1) // STEP))
    begin = (np.cumsum(count) - count) * STEP
    padded, real = np.zeros(int(count.sum()) * STEP + WIDTH - 1, np.uint8), np.zeros(int(count.sum()) * STEP, bool)
    for at, a, z in zip(begin.tolist(), borders[:-1].tolist(), borders[1:].tolist(), strict=True):
        padded[at:at + z - a] = raw[a:z]
    np.not_equal(padded[:len(real)], 0, out=real)
    return padded, count, real


def _positions(real: np.ndarray) -> np.ndarray:
    return np.maximum(LEAST, real.reshape(-1, STEP).sum(axis=1))[:, None].astype(np.float32)


def _chunks(features: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of neighbouring blocks of one text joined to chunks, and the
    first chunk of each text; a single block is a chunk."""
    last = np.cumsum(count) - 1
    pair = np.arange(len(features)) + 1
    pair[last] = last
    keep = np.ones(len(features), bool)
    keep[last[count > 1]] = False
    a, b = features[keep], features[pair[keep]]
    chunks = np.concatenate([np.maximum(a[:, :FILTERS], b[:, :FILTERS]), (a[:, FILTERS:] + b[:, FILTERS:]) / 2], axis=1)
    size = np.where(count > 1, count - 1, 1)
    return chunks, np.cumsum(size) - size


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    """filters: (WIDTH * codes, FILTERS); hidden: (2 * FILTERS, HIDDEN);
    out: HIDDEN; each with its biases. ``constant`` is the score where there
    is nothing to tell apart."""

    weights: dict[str, np.ndarray]
    constant: float | None = None

    def tables(self) -> list[np.ndarray]:
        """Responses by byte pair, a table for each pair under the filters."""
        parts = np.einsum("bc,jcf->jbf", CODES, self.weights["filters"].reshape(WIDTH, CODES.shape[1], FILTERS))
        out = [(parts[j][:, None] + parts[j + 1][None]).reshape(1 << 16, FILTERS) for j in range(0, WIDTH, 2)]
        out[0] = out[0] + self.weights["filters_bias"]
        out[0][:256] = -1e9  # silent at pads
        return [np.ascontiguousarray(t, np.float32) for t in out]

    def score(self, texts: pa.Array, tables: list[np.ndarray]) -> np.ndarray:
        """Probability of label 1 of each text, all of it read."""
        if self.constant is not None or not len(texts):
            return np.full(len(texts), self.constant or 0.0)
        padded, count, real = _blocks(*text_bytes(texts))
        pairs = padded[:-1].astype(np.uint16) << 8 | padded[1:]
        features = np.empty((int(count.sum()), 2 * FILTERS), np.float32)
        held, spare = np.empty((2, _RUN * STEP, FILTERS), np.float32)
        for lo in range(0, len(features), _RUN):
            hi = min(lo + _RUN, len(features))
            a, z = lo * STEP, hi * STEP
            seen, more = held[:z - a], spare[:z - a]
            np.take(tables[0], pairs[a:z], axis=0, out=seen, mode="clip")
            for j, t in enumerate(tables[1:], 1):
                seen += np.take(t, pairs[a + 2 * j:z + 2 * j], axis=0, out=more, mode="clip")
            np.maximum(seen, 0, out=seen)
            seen = seen.reshape(hi - lo, STEP, FILTERS)
            features[lo:hi, FILTERS:] = (np.ones((1, STEP), np.float32) @ seen)[:, 0] / _positions(real[a:z])
            half = STEP // 2
            while half:  # halving keeps the inner loops long
                seen = np.maximum(seen[:, :half], seen[:, half:])
                half //= 2
            features[lo:hi, :FILTERS] = seen[:, 0]
        chunks, first = _chunks(features, count)
        w = self.weights
        # not by matrix products, whose rounding may vary with a row's place
        hidden = np.tile(w["hidden_bias"], (len(chunks), 1))
        for feature, weight in zip(chunks.T, w["hidden"], strict=True):
            hidden += feature[:, None] * weight
        pooled = np.maximum.reduceat(np.maximum(hidden, 0), first, axis=0)
        return _sigmoid(((pooled * w["out"].T).sum(axis=1) + w["out_bias"]).astype(np.float64))


def _windows(padded: np.ndarray) -> np.ndarray:
    codes = CODES[padded]
    return np.concatenate([codes[j:len(codes) - WIDTH + 1 + j] for j in range(WIDTH)], axis=1)


def _gradients(w: dict[str, np.ndarray], texts: list[bytes], label: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Of the weighted logistic loss over some texts."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    padded, count, real = _blocks(raw, np.cumsum([0, *map(len, texts)]))
    n = int(count.sum())
    x = _windows(padded)
    seen = np.maximum(x @ w["filters"] + w["filters_bias"], 0) * real[:, None]
    blocks = seen.reshape(n, STEP, FILTERS)
    top, positions = blocks.argmax(axis=1), _positions(real)
    features = np.concatenate([blocks.max(axis=1), blocks.sum(axis=1) / positions], axis=1)
    chunks, first = _chunks(features, count)
    before = chunks @ w["hidden"] + w["hidden_bias"]
    hidden = np.maximum(before, 0)
    size = np.diff(np.append(first, len(hidden)))
    pooled = np.maximum.reduceat(hidden, first, axis=0)
    d = ((_sigmoid(pooled @ w["out"] + w["out_bias"]).ravel() - label) * weight / len(label)).astype(np.float32)[:, None]
    out = {"out": pooled.T @ d, "out_bias": d.sum(axis=0)}
    # the chunk that gave a unit's greatest value takes its gradient
    winner = hidden == np.repeat(pooled, size, axis=0)
    winner &= np.cumsum(winner, axis=0) - np.repeat((np.cumsum(winner, axis=0) - winner)[first], size, axis=0) == 1
    dh = np.repeat(d @ w["out"].T, size, axis=0) * winner * (before > 0)
    out["hidden"], out["hidden_bias"] = chunks.T @ dh, dh.sum(axis=0)
    dc = dh @ w["hidden"].T
    # chunks back to blocks: the greater of two blocks takes the maximum's part, both the mean's
    last = np.cumsum(count) - 1
    keep = np.ones(n, bool)
    keep[last[count > 1]] = False
    a = np.flatnonzero(keep)
    b = np.where(np.isin(a, last), a, a + 1)
    larger = features[a, :FILTERS] >= features[b, :FILTERS]
    db = np.zeros((n, 2 * FILTERS), np.float32)
    db[a, :FILTERS] += dc[:, :FILTERS] * larger
    db[a, FILTERS:] += dc[:, FILTERS:] / 2
    db[b] += np.concatenate([dc[:, :FILTERS] * ~larger, dc[:, FILTERS:] / 2], axis=1)
    ds = np.repeat((db[:, FILTERS:] / positions)[:, None], STEP, axis=1)
    at = np.arange(n)[:, None], top, np.arange(FILTERS)[None]
    ds[at] += db[:, :FILTERS]
    ds = ds.reshape(-1, FILTERS) * (seen > 0)
    out["filters"], out["filters_bias"] = x.T @ ds, ds.sum(axis=0)
    return out


def train(texts: list[bytes], label: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS) -> dict[str, np.ndarray]:
    """Weights by Adam, starting from fixed random values; the average over
    the last third of the steps is returned."""
    rng = np.random.default_rng(11)
    inputs = WIDTH * CODES.shape[1]
    w = {"filters": rng.normal(0, 1 / np.sqrt(inputs), (inputs, FILTERS)), "filters_bias": np.zeros(FILTERS),
         "hidden": rng.normal(0, 1 / np.sqrt(FILTERS), (2 * FILTERS, HIDDEN)), "hidden_bias": np.full(HIDDEN, 0.1),
         "out": rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 1)), "out_bias": np.zeros(1)}
    w = {k: v.astype(np.float32) for k, v in w.items()}
    first, second, mean = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(3))
    steps = epochs * -(-len(texts) // BATCH)
    done = kept = 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for lo in range(0, len(texts), BATCH):
            some = order[lo:lo + BATCH]
            done += 1
            rate = RATE * (1 - 0.9 * done / steps) / (1 - 0.9 ** done) * np.sqrt(1 - 0.99 ** done)
            for k, g in _gradients(w, [texts[i] for i in some], label[some], weight[some]).items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                w[k] -= (rate * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)
            if done > steps * 2 // 3:
                kept += 1
                for k in w:
                    mean[k] += w[k]
    return {k: v / max(1, kept) for k, v in mean.items()}


def _spread(text: bytes, blocks: int) -> bytes:
    """The text, or of one longer than ``blocks`` blocks as many, in runs of
    two spread evenly from its start to its end."""
    if len(text) <= blocks * STEP:
        return text
    run = 2 * STEP
    starts = np.linspace(0, len(text) - run, blocks // 2).astype(int)
    return b"".join(text[s:s + run] for s in starts)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> Model:
    """Fits on at most ``per_class`` distinct texts of each class, chosen by a
    hash of the text, and of each at most SAMPLE_BLOCKS blocks: the bounds of
    the sample. ``docs``: doc_id, text; ``labels``: doc_id, quality (above 0
    is class 1, null is no label); rows meet by doc_id. A text with several
    labels has the more frequent one (class 1 if equal). Errors weigh as the
    classes' shares of all distinct labelled texts ask.

    Defined cases: null texts and doc_ids give nothing to learn; without a
    labelled text every score is 0.5, with one class only the class itself.
    """
    known = labels.filter(F.col("quality").isNotNull()).select("doc_id", (F.col("quality") > 0).cast("int").alias("__q"))
    keyed = docs.filter(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("__key"))
    texts = keyed.join(known, "doc_id").groupBy("__key").agg((F.avg("__q") >= 0.5).cast("int").alias("__q"))
    texts = materialize(texts.withColumn("__hash", F.xxhash64("__key")), "labelled")
    count = {r["__q"]: r["count"] for r in texts.groupBy("__q").count().collect()}
    if len(count) < 2:
        return Model({}, float(next(iter(count), 0.5)))
    # about three times as many as are wanted are ranked, so no task ranks a class
    share = {c: min(1.0, (3 * per_class + 50) / n) for c, n in count.items()}
    thin = texts.filter((F.shiftrightunsigned("__hash", 11) / F.lit(float(1 << 53))) < F.when(F.col("__q") == 1, share[1]).otherwise(share[0]))
    order = Window.partitionBy("__q").orderBy("__hash", "__key")
    picked = thin.withColumn("__at", F.row_number().over(order)).filter(F.col("__at") <= per_class)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole):
                parts = [_spread(t.encode(), SAMPLE_BLOCKS) for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("__key"), b.column("__q"), pa.array(parts, pa.binary())], ["key", "q", "part"])
    share = {c: n / sum(count.values()) for c, n in count.items()}

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((key, q, part) for b in batches for key, q, part in zip(*[b.column(c).to_pylist() for c in ("key", "q", "part")], strict=True))
        label = np.array([q for _, q, _ in rows])
        weight = np.array([share[q] / np.mean(label == q) for q in label.tolist()])
        yield pa.RecordBatch.from_pydict({"weights": [pickle.dumps(train([part for _, _, part in rows], label, weight))]})
    # the sample is at most 2 * per_class keys; copies of a text are cut to one row
    sample = docs.select("text", F.xxhash64("text").alias("__key")).join(F.broadcast(picked.select("__key", "__q")), "__key")
    rows = sample.mapInArrow(cut, "key long, q int, part binary").dropDuplicates(["key"])
    # small and bounded, so one task fits it
    fitted = materialize(rows, "sample").repartition(1).mapInArrow(learn, "weights binary").first()
    return Model(pickle.loads(fitted["weights"]))


def predict(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 if the score is
    ``threshold`` or more). A null text is an empty one, which is scored as a
    chunk of pads; a text of any length is read whole; equal texts have equal
    scores; columns named score or predicted are replaced, others kept. Only
    the text is an input."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    cols = [c for c in docs.columns if c not in ("score", "predicted")]
    schema = docs.select(*cols).schema.add("score", "double").add("predicted", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [] if shared.value.constant is not None else shared.value.tables()
        for whole in batches:
            for b in slices(whole, most=1 << 22):
                score = shared.value.score(b.column("text"), tables)
                made = pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in cols], *made], schema.names)
    return docs.select(*cols).mapInArrow(run, schema)
