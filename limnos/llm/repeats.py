"""Substring dedup by level-wise doubling.

A window of 13 words can only be repeated if a window of half its length in
it is. Level 1 looks at 7-word windows, and of those only at the one with the
least hash in each 13-word window: equal windows pick equal ones, and
neighbours mostly pick the same. Windows that hold one found in no other
document are out. Level 2 doubles the length of what survives, up to 13
words, and finds the least document of each. Doubling ends there: windows of
more words cannot change which words go.

A level is an exchange: each task sends every distinct key once, with one
document to answer to, to the task that owns the key, and is told which keys
others hold too. A key in a third of all documents is so one entry a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.llm.common import materialize_by, partitions
from limnos.llm.words import Words, slices

WINDOW = 13
#: key/document pairs that a task holds before it sends them
_HELD = 1 << 20
#: bytes of text that a task looks at at once, one document at least
_SLICE = 1 << 21
_NOBODY = -(1 << 63)
#: stands for a null doc_id, which comes after all others
_LAST = (1 << 63) - 1
_ENTRIES = "piece int, told boolean, keys binary, docs binary"


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of each run of equal keys."""
    head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return head, np.diff(np.append(head, len(keys)))


def _entry(piece: int, keys: np.ndarray, docs: np.ndarray, smaller: bool, told: bool = False) -> tuple[int, bool, bytes, bytes]:
    """Level 1 only filters, so 32 bits of a key within its piece will do."""
    return piece, told, (keys.astype("<u8") if smaller else (keys >> np.uint64(32)).astype("<u4")).tobytes(), docs.astype("<i8").tobytes()


def short_names(keys: np.ndarray, pieces: int) -> np.ndarray:
    """What level 1 calls keys: the piece and 32 bits."""
    return (keys % np.uint64(pieces)) << np.uint64(32) | keys >> np.uint64(32)


def _batch(rows: list[tuple[int, bool, bytes, bytes]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
    types = [pa.int32(), pa.bool_(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["piece", "told", "keys", "docs"])


def _send(parts: Iterator[tuple[np.ndarray, np.ndarray]], pieces: int, smaller: bool) -> Iterator[pa.RecordBatch]:
    """From (keys, documents) to entries: for each piece the distinct keys
    with a document to answer to, and as ``told`` the pairs that are decided
    here already. ``smaller``: a pair counts if a smaller document has its key;
    else if any other has."""
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        keys, docs = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((docs, keys))
        keys, docs = keys[order], docs[order]
        fresh = np.ones(len(keys), bool)
        fresh[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])
        keys, docs = keys[fresh], docs[fresh]
        head, n = _runs(keys)
        ask, answer_to = keys[head], docs[head]
        if smaller:
            known = docs > np.repeat(answer_to, n)
        else:
            known = np.repeat(n > 1, n)
            answer_to = np.where(n > 1, _NOBODY, answer_to)
        rows = []
        for k, d, told in ((ask, answer_to, False), (keys[known], docs[known], True)):
            piece = (k % np.uint64(pieces)).astype(np.int64)
            order = np.lexsort((d, piece))
            ends = np.searchsorted(piece[order], np.arange(pieces + 1))
            rows += [_entry(p, k[order[a:z]], d[order[a:z]], smaller, told) for p, (a, z) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if z > a]
        return _batch(rows)
    for keys, docs in parts:
        held.append((keys, docs))
        size += len(keys)
        if size >= _HELD:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def _answer(smaller: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []

        def decide() -> pa.RecordBatch:
            keys = np.concatenate([np.frombuffer(r[0], "<u8" if smaller else "<u4") for r in held])
            docs = np.concatenate([np.frombuffer(r[1], "<i8") for r in held])
            order = np.lexsort((docs, keys))
            keys, docs = keys[order], docs[order]
            head, n = _runs(keys)
            told = (np.repeat(n > 1, n) & (docs != _NOBODY)) if not smaller else docs > np.repeat(docs[head], n)
            return _batch([(current, True, keys[told].tobytes(), docs[told].tobytes())])
        for b in batches:
            for piece, told, keys, docs in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if told:
                    yield _batch([(piece, True, keys, docs)])
                    continue
                if piece != current and held:
                    yield decide()
                    held = []
                current = piece
                held.append((keys, docs))
        if held:
            yield decide()
    return run


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for piece, _, keys, docs in zip(*[c.to_pylist() for c in b.columns], strict=True):
            docs = np.frombuffer(docs, "<i8")
            name = np.frombuffer(keys, "<u8").view(np.int64) if len(keys) == 8 * len(docs) else np.int64(piece) << 32 | np.frombuffer(keys, "<u4").astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(name)], ["__doc", "key"])


def exchange(source: DataFrame, find: Callable, smaller: bool) -> DataFrame:
    """__doc and keys (array): the pairs that ``find`` makes of the source's
    batches and that count, by document."""
    pieces = partitions(source)
    sent = source.mapInArrow(lambda it: _send(find(it), pieces, smaller), _ENTRIES)
    told = sent.repartition(pieces, "piece").sortWithinPartitions("piece").mapInArrow(_answer(smaller), _ENTRIES)
    return told.mapInArrow(_explode, "__doc long, key long").groupBy("__doc").agg(F.collect_list("key").alias("keys"))


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    """A column of lists of keys; null is an empty one."""
    flat, ends = column.values.to_numpy().view(np.uint64), column.offsets.to_numpy()
    return [flat[a:z] for a, z in zip(ends[:-1], ends[1:], strict=True)]


def _anchor(words: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of the k-word window at each word, whether it lies in one
    document, and the least hash of the half-length windows inside it."""
    h = words.hashes()
    half = (k + 1) // 2
    short, _ = words.window_hashes(half, h)
    full, inside = words.window_hashes(k, h)
    least, span = short, 1
    while span < k - half + 1:
        step = min(span, k - half + 1 - span)
        shifted = np.concatenate([least[step:], np.full(min(step, len(least)), np.iinfo(np.uint64).max, np.uint64)])
        least, span = np.minimum(least, shifted), span + step
    return full, inside, least


def remove_repeats(docs: DataFrame, k: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256.
    Words covered by a window of ``k`` words that also starts in a document
    with a smaller doc_id are removed; the rest, joined by one space, is
    hashed. Windows are judged on the input.

    Defined cases: a null or empty text has no words; a document of fewer
    than k words keeps them all; a null doc_id is larger than all others;
    rows with one doc_id are one document to each other, so they remove
    nothing from one another; other columns are not read.
    """
    ids, pieces = docs.select("doc_id").schema, partitions(docs)
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("__doc"), "doc_id", "text")

    def anchors(batches):
        for whole in batches:
            for b in slices(whole, most=_SLICE):
                words = Words(b.column("text"))
                _, inside, least = _anchor(words, k)
                doc = b.column("__doc").to_numpy()[words.doc_of()[inside]]
                key = least[inside]
                fresh = np.ones(len(key), bool)
                fresh[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
                yield key[fresh], doc[fresh]
    shared = exchange(keyed.drop("doc_id"), anchors, smaller=False)

    kept = ids.add("__doc", "long").add("n_words", "long").add("kept_sha256", "string").add("text", "string").add("at", "binary").add("windows", "binary")

    def candidates(batches):
        for whole in batches:
            for b in slices(whole, most=_SLICE):
                words = Words(b.column("text"))
                full, inside, least = _anchor(words, k)
                data, n = words.raw.tobytes(), words.counts().tolist()
                sha, text, at, windows = [], [], [], []
                for i, keys in enumerate(_lists(b.column("keys"))):
                    a, z = words.first[i], words.first[i + 1]
                    p = np.zeros(0, np.int64)
                    if len(keys) and z - a >= k:
                        known = np.isin(short_names(least[a:z - k + 1], pieces), keys)
                        p = np.flatnonzero(known)
                    body = data[words.borders[i]:words.borders[i + 1]]
                    sha.append(None if len(p) else hashlib.sha256(b" ".join(body.split())).hexdigest())
                    text.append(body if len(p) else None)
                    at.append(p.astype("<u4").tobytes() if len(p) else None)
                    windows.append(full[a + p].astype("<u8").tobytes() if len(p) else None)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("__doc"), pa.array(n, pa.int64()), pa.array(sha, pa.string()),
                                                  pa.array(text, pa.binary()).cast(pa.string()), pa.array(at, pa.binary()), pa.array(windows, pa.binary())],
                                                 ["doc_id", "__doc", "n_words", "kept_sha256", "text", "at", "windows"])
    joined = keyed.join(shared.hint("merge"), "__doc", "left").select("__doc", "doc_id", "text", "keys")
    found = materialize_by(joined.mapInArrow(candidates, kept), "__doc", "candidates")

    def windows(batches):
        for b in batches:
            for doc, blob in zip(b.column("__doc").to_pylist(), b.column("windows").to_pylist(), strict=True):
                keys = np.frombuffer(blob, "<u8")
                yield keys, np.full(len(keys), doc, np.int64)
    open_ = found.filter("windows IS NOT NULL")
    covered = exchange(open_.select("__doc", "windows"), windows, smaller=True)
    out = docs.select("doc_id").schema.add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string")

    def cut(batches):
        for whole in batches:
            for b in slices(whole, most=_SLICE):
                removed, sha = [], []
                for text, n, at, blob, keys in zip(*[b.column(c).to_pylist() for c in ("text", "n_words", "at", "windows")], _lists(b.column("keys")), strict=True):
                    change = np.zeros(n + 1, np.int64)
                    if len(keys):
                        gone = np.frombuffer(at, "<u4")[np.isin(np.frombuffer(blob, "<u8"), keys)]
                        np.add.at(change, gone, 1)
                        np.add.at(change, gone + k, -1)
                    keep = np.cumsum(change[:n]) == 0
                    removed.append(int(n - keep.sum()))
                    sha.append(hashlib.sha256(b" ".join(compress(text.encode().split(), keep.tolist()))).hexdigest())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_words"), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], out.names)
    changed = open_.join(covered.hint("merge"), "__doc", "left").select("doc_id", "n_words", "text", "at", "windows", "keys").mapInArrow(cut, out)
    clean = found.filter("windows IS NULL").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256")
    return clean.unionByName(changed)
