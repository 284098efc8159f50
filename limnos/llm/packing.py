"""Mixture-controlled packing by deficit round-robin over source queues.

Every window of 4,096 tokens gives each queue its share. What a queue is due
is rarely a whole number of tokens; the deficit is carried to the next
window. As shares are fixed while the same queues are backlogged, the tokens
a queue has been served after any window have a closed form, so a document's
pieces follow from its place in its queue alone: windows in different tasks
agree without passing counters on.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limnos.llm.common import materialize, running_sum
from limnos.llm.words import Words, ragged, slices

WINDOW = 4096
#: a source with a smaller share of all tokens joins the shared queue
LEAST_SHARE = 64
#: words whose ids a Python worker remembers, and that it encodes at once
CACHE, ENCODED = 1 << 20, 1 << 8
#: a word that hardly any text holds
MARK = "\x01"


class Schedule:
    """Deficit round-robin over backlogged queues of ``sizes`` tokens with
    ``weights`` (their sizes, unless given). While the same queues hold
    tokens (a phase), the first j of them have together been served
    floor(x * w_j / w) tokens after x tokens in all, w_j being their weights'
    sum: each window's parts add up exactly and deficits stay below one token.
    """

    def __init__(self, sizes: list[int], weights: list[int] | None = None, window: int = WINDOW):
        self.sizes, self.window, self.total = sizes, window, sum(sizes)
        left, at = list(sizes), 0
        self.phases: list[tuple[int, int, list[int], list[int]]] = []  # begin, length, tokens served before, tokens of the phase
        weights = list(weights or sizes)
        served = [0] * len(sizes)
        while any(left):
            open_ = [i for i in range(len(left)) if left[i] and weights[i] > 0] or [i for i in range(len(left)) if left[i]]
            w = {i: weights[i] if weights[i] > 0 else left[i] for i in open_}
            k = min(open_, key=lambda i: left[i] / w[i])
            part = [min(left[i], left[k] * w[i] // w[k]) if i in w else 0 for i in range(len(left))]
            self.phases.append((at, sum(part), list(served), part))
            at += sum(part)
            left = [a - b for a, b in zip(left, part, strict=True)]
            served = [a + b for a, b in zip(served, part, strict=True)]
        full = self.total // window
        rest, tail = self.total - full * window, []
        # what is left over fills sequences of a power of two each: no padding
        for bit in range(window.bit_length(), -1, -1):
            if rest >> bit & 1:
                tail.append(1 << bit)
        self.full, self.ends = full, [full * window + sum(tail[:i]) for i in range(len(tail) + 1)]
        self.count = full + len(tail)
        self.before = lru_cache(maxsize=1 << 14)(self._before)

    def border(self, sequence: int) -> int:
        return sequence * self.window if sequence <= self.full else self.ends[sequence - self.full]

    def _before(self, sequence: int) -> list[int]:
        """Tokens of each queue served before the sequence."""
        x = self.border(sequence)
        for begin, length, served, part in reversed(self.phases):
            if begin <= x:
                out, mark, run = [], 0, 0
                for s, p in zip(served, part, strict=True):
                    run += p
                    reach = run * min(x - begin, length) // length if length else 0
                    out.append(s + reach - mark)
                    mark = reach
                return out
        return [0] * len(self.sizes)

    def find(self, queue: int, place: int) -> int:
        """The sequence that takes the queue's token at ``place``."""
        lo, hi = 0, self.count
        for begin, length, served, part in self.phases:
            if served[queue] <= place < served[queue] + part[queue]:
                guess = (begin + (place - served[queue]) * length // part[queue]) // self.window
                lo, hi = max(0, guess - 2 - length // (self.window * max(1, part[queue]))), min(self.count, guess + 3 + length // (self.window * max(1, part[queue])))
        if self.before(lo)[queue] > place:
            lo = 0
        if self.before(hi)[queue] <= place:
            hi = self.count
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if self.before(mid)[queue] <= place else (lo, mid)
        return lo

    def pieces(self, queue: int, place: int, length: int) -> Iterator[tuple[int, int, int, int]]:
        """(start in the document, length, sequence, offset) of a document
        that stands at ``place`` in its queue."""
        done, sequence = 0, self.find(queue, place) if length else 0
        while done < length:
            a, b = self.before(sequence), self.before(sequence + 1)
            take = min(length - done, b[queue] - place - done)
            if take > 0:
                yield done, take, sequence, sum(b[:queue]) - sum(a[:queue]) + place + done - a[queue]
                done += take
            sequence += 1


class WordIds:
    """Token ids by word. The tokenizer drops white space and never joins
    characters across it, so a text's ids are its words' ids in order; each
    distinct word is encoded once and remembered, up to CACHE words."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        mark = self._each([MARK])[0]
        self.mark = int(mark[0]) if len(mark) == 1 else None
        self._keep(np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, self.dtype))

    def _keep(self, keys: np.ndarray, ends: np.ndarray, ids: np.ndarray) -> None:
        self.keys, self.ends, self.ids = keys, ends, ids

    def _each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        length = np.array([len(x) for x in lists], np.int64)
        return np.fromiter((i for x in lists for i in x), self.dtype, int(length.sum())), length

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words' ids behind one another, and how many each has. One text
        of many words takes about half of the time that a text for each takes;
        a mark between them tells where they end."""
        if self.mark is not None:
            whole = self.tokenizer.encode_batch_fast([f" {MARK} ".join(words)], add_special_tokens=False)[0]
            ids = np.array(whole.ids, self.dtype)
            at = np.flatnonzero(ids == self.mark)
            if len(at) == len(words) - 1:
                return np.delete(ids, at), np.diff(at, prepend=-1, append=len(ids)) - 1
        return self._each(words)  # some word holds the mark

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        """Adds words (their hashes ascending) to the table."""
        parts = [self._ids(words[a:a + ENCODED]) for a in range(0, len(words), ENCODED)]
        flat, length = (np.concatenate(x) for x in zip(*parts, strict=True))
        all_keys = np.concatenate([self.keys, keys])
        begin = np.concatenate([self.ends[:-1], len(self.ids) + np.cumsum(length) - length])
        size = np.concatenate([np.diff(self.ends), length])
        order = np.argsort(all_keys)
        ids = ragged(np.concatenate([self.ids, flat]), begin[order], size[order])
        self._keep(all_keys[order], np.concatenate([[0], np.cumsum(size[order])]), ids)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids behind one another and the n + 1 borders."""
        words = Words(texts)
        if not len(words):
            return np.zeros(0, self.dtype), np.zeros(len(texts) + 1, np.int64)
        distinct, at, inverse = np.unique(words.hashes(), return_index=True, return_inverse=True)
        known = np.searchsorted(self.keys, distinct)
        new = (known == len(self.keys)) | (self.keys[np.minimum(known, max(0, len(self.keys) - 1))] != distinct) if len(self.keys) else np.ones(len(distinct), bool)
        if len(self.keys) + new.sum() > CACHE and len(self.keys):
            self._keep(np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, self.dtype))
            new = np.ones(len(distinct), bool)
        if new.any():
            self._learn(distinct[new], [words.word(i).decode() for i in at[new].tolist()])
        row = np.searchsorted(self.keys, distinct)[inverse]
        size = np.diff(self.ends)[row]
        done = np.concatenate([[0], np.cumsum(size)])
        return ragged(self.ids, self.ends[row], size), done[words.first]


_encoders: dict[str, WordIds] = {}


def _encoder(path: str) -> WordIds:
    if path not in _encoders:
        _encoders[path] = WordIds(path)
    return _encoders[path]


def tokenized(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """doc_id, source, n, ids (little-endian; 2 bytes an id where the
    vocabulary allows, else 4) of each whole text with ``end_id`` behind it;
    part and before: the task that wrote the row, and the tokens of its
    source that this task wrote earlier."""
    schema = docs.select("doc_id", "source").schema.add("n", "long").add("ids", "binary").add("part", "long").add("before", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, written = _encoder(path), TaskContext.get().partitionId(), {}
        for whole in batches:
            for b in slices(whole):
                ids, borders = encoder.encode(b.column("text"))
                end = np.array([end_id], encoder.dtype).tobytes()
                blobs = [ids[a:z].tobytes() + end for a, z in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True)]
                n = (np.diff(borders) + 1).tolist()
                before = []
                for s, k in zip(b.column("source").to_pylist(), n, strict=True):
                    before.append(written.get(s, 0))
                    written[s] = before[-1] + k
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(n, pa.int64()), pa.array(blobs, pa.binary()),
                                                  pa.array([part] * len(n), pa.int64()), pa.array(before, pa.int64())], schema.names)
    return docs.select("doc_id", "source", "text").mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, end_id: int = 2, window: int = WINDOW, targets: dict[str, int] | None = None, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, and with ``keep_ids`` its ids.

    Sources with at least 1/64 of all tokens are queues, so there are at most
    64; smaller ones share one more. A queue's weight is its size, or its
    entry in ``targets`` (the shared queue: its size); a queue that runs dry
    leaves its share to the rest. All sequences are full but the last ones,
    which have lengths of powers of two: nothing is padded.

    Defined cases: a null or empty text is ``end_id`` alone; a null source is
    a source; rows with one doc_id are documents of their own; an empty table
    gives no rows; other columns are not read.
    """
    written = materialize(tokenized(docs, path, end_id), "tokens")
    sizes = written.groupBy("source", "part").agg(F.sum("n").alias("n"))
    sources = materialize(sizes.groupBy("source").agg(F.sum("n").alias("n")), "sources")
    total = sources.agg(F.sum("n").alias("n")).first()["n"] or 0
    big = sorted(((r["source"], r["n"]) for r in sources.filter(F.col("n") * LEAST_SHARE >= total).collect()), key=lambda x: (x[0] is None, x[0] or "")) if total else []
    rest = total - sum(n for _, n in big)
    queues = [n for _, n in big]
    if rest and queues and rest * LEAST_SHARE < total:
        shared = min(range(len(queues)), key=queues.__getitem__)
        queues[shared] += rest
    else:
        shared = len(queues)
        queues += [rest] * (rest > 0)
    weights = [targets.get(s, n) for s, n in big] + queues[len(big):] if targets else None
    number = F.lit(shared)
    for i, (s, _) in enumerate(big):
        number = F.when(F.col("source").eqNullSafe(F.lit(s)), F.lit(i)).otherwise(number)
    offsets = running_sum(sizes.withColumn("queue", number), ["queue"], ["part", "source"], {"place": "n"})
    offsets = offsets.select("queue", "place", F.col("source").alias("__source"), F.col("part").alias("__part"))
    placed = written.join(offsets, (F.col("part") == F.col("__part")) & F.col("source").eqNullSafe(F.col("__source")))
    placed = placed.select("doc_id", "n", "ids", "queue", (F.col("place") + F.col("before")).alias("place"))
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = docs.select("doc_id").schema
    for c in names:
        schema = schema.add(c, "long")
    if keep_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))
    sizes_, weights_ = list(queues), weights

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = Schedule(sizes_, weights_, window)
        for b in batches:
            row, out, held = [], [], []
            for i, (n, blob, queue, place) in enumerate(zip(*[b.column(c).to_pylist() for c in ("n", "ids", "queue", "place")], strict=True)):
                ids = np.frombuffer(blob, f"<u{len(blob) // n}").astype("<u4")
                for start, length, sequence, offset in plan.pieces(queue, place, n):
                    row.append(i)
                    out.append((start, length, zlib.crc32(ids[start:start + length].tobytes()), n, sequence, offset))
                    if keep_ids:
                        held.append(ids[start:start + length].astype(np.int32))
            values = np.array(out, np.int64).reshape(-1, 6)
            arrays = [b.column("doc_id").take(pa.array(row, pa.int64())), *[pa.array(values[:, k]) for k in range(6)]]
            yield pa.RecordBatch.from_arrays([*arrays, *([pa.array(held, pa.list_(pa.int32()))] if keep_ids else [])], schema.names)
    return placed.mapInArrow(cut, schema)
