"""Document fingerprints: a Merkle tree over sections, paragraphs and phrases.

A phrase is a run of words that ends at a sentence mark, at a line end or at
a word that a hash picks (one in eight), so its borders depend on the text
near them alone. Lines are paragraphs; sections end at blank lines or at
paragraphs that a hash picks (one in four). A node's digest is taken over
its children's. Equal texts have equal roots; a change alters its own branch
only, and comparing two trees skips equal sections whole.

A fingerprint is text: the root, ``:``, sections joined by ``.``, paragraphs
by ``,``, each phrase four characters.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.llm.common import partitions
from limnos.llm.words import Words, byte_hashes, mix64, sequence_hashes

_MARKS = np.zeros(256, dtype=bool)
_MARKS[[ord(c) for c in ".!?"]] = True
_PHRASE, _SECTION = 8, 4
#: bytes of text that are hashed at once
_BATCH = 1 << 22


def _groups(ends: np.ndarray, n: int) -> np.ndarray:
    """First indices of runs that end where ``ends`` holds; n items, n > 0."""
    return np.concatenate([[0], np.flatnonzero(ends[:n - 1]) + 1])


def _fingerprints(texts: pa.Array) -> list[str]:
    words = Words(texts)
    hashes, raw, borders = words.hashes(), words.raw, words.borders
    lines = np.concatenate([[0], np.cumsum(raw == 10)])
    out = []
    # line feeds between a word's end and the next word or the document's end
    until = np.append(words.start[1:], len(raw))
    until = np.minimum(until, np.repeat(borders[1:], words.counts())) if len(words) else until[:0]
    feeds = lines[until] - lines[words.end]
    phrase_end = (hashes % np.uint64(_PHRASE) == 0) | (feeds > 0)
    if len(words):
        phrase_end |= _MARKS[raw[words.end - 1]]
    # phrases over the whole batch: byte ranges that cover every document
    starts, first = [], [0]
    for i in range(len(borders) - 1):
        a, b = words.first[i], words.first[i + 1]
        if borders[i + 1] > borders[i]:
            at = _groups(phrase_end[a:b], b - a) if b > a else np.array([0])
            begin = words.start[a + at] if b > a else np.array([borders[i]])
            begin[0] = borders[i]
            starts.append(begin)
            first.append(first[-1] + len(begin))
        else:
            first.append(first[-1])
    begin = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    owner_end = np.repeat(borders[1:], np.diff(first))
    end = np.minimum(np.append(begin[1:], len(raw)), owner_end) if len(begin) else begin
    digest = byte_hashes(raw, begin, end) if len(begin) else np.zeros(0, np.uint64)
    line_feeds = lines[end] - lines[begin]
    small = np.empty((len(digest), 3), np.uint8)
    for k in range(3):
        small[:, k] = (digest >> np.uint64(8 * k)).astype(np.uint8)
    for i in range(len(borders) - 1):
        a, b = first[i], first[i + 1]
        if a == b:
            out.append(hashlib.blake2b(b"", digest_size=16).hexdigest() + ":")
            continue
        d, feed = digest[a:b], line_feeds[a:b]
        para = _groups(feed > 0, b - a)
        para_end = np.append(para[1:], b - a)
        para_hash = sequence_hashes(d, para, para_end)
        para_feeds = np.add.reduceat(feed, para)
        section = _groups((para_feeds > 1) | (mix64(para_hash) % np.uint64(_SECTION) == 0), len(para))
        section_end = np.append(section[1:], len(para))
        section_hash = sequence_hashes(para_hash, section, section_end)
        root = hashlib.blake2b(section_hash.tobytes(), digest_size=16).hexdigest()
        codes = base64.urlsafe_b64encode(small[a:b].tobytes()).decode()
        paragraphs = [codes[4 * x:4 * y] for x, y in zip(para.tolist(), para_end.tolist(), strict=True)]
        out.append(root + ":" + ".".join(",".join(paragraphs[x:y]) for x, y in zip(section.tolist(), section_end.tolist(), strict=True)))
    return out


def fingerprints(texts: list[str]) -> list[str]:
    """Fingerprints of whole texts, hashed some megabytes at a time."""
    out, held, size = [], [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= _BATCH:
            out += _fingerprints(pa.array(held, pa.large_string()))
            held, size = [], 0
    return out + (_fingerprints(pa.array(held, pa.large_string())) if held else [])


def phrases(section: str) -> list[str]:
    section = section.replace(",", "")
    return [section[i:i + 4] for i in range(0, len(section), 4)]


def likeness(a: str, b: str) -> float:
    """Twice the shared phrases over all phrases of both (0 to 1); 1 for equal
    roots. Equal sections count whole, differing ones by their phrases."""
    if a[:32] == b[:32]:
        return 1.0
    left, right = (Counter(x[33:].split(".")) for x in (a, b))
    both = left & right
    shared = sum(n * len(phrases(s)) for s, n in both.items())
    rest = []
    for side in (left - both, right - both):
        rest.append(Counter(p for s, n in side.items() for p in phrases(s) * n))
    total = 2 * shared + sum(r.total() for r in rest)
    return 2 * (shared + (rest[0] & rest[1]).total()) / total if total else 0.0


def differing(a: str, b: str) -> list[tuple[int, int]]:
    """Where a's phrases are not found in b: ranges of a's phrase numbers,
    found below the sections that differ."""
    known = set(b[33:].split("."))
    have = Counter(p for s in b[33:].split(".") for p in phrases(s))
    out, at = [], 0
    for s in a[33:].split("."):
        parts = phrases(s)
        if s not in known:
            for k, p in enumerate(parts):
                if not have[p]:
                    if out and out[-1][1] == at + k:
                        out[-1] = (out[-1][0], at + k + 1)
                    else:
                        out.append((at + k, at + k + 1))
        at += len(parts)
    return out


def with_next(docs: DataFrame, run, schema) -> DataFrame:
    """``run`` gets (doc_id, text, next text) triples, in lists, and yields
    record batches of ``schema``. The next document is that of the next
    smaller doc_id (null last; equal ids by text), the first after the last.

    Documents go to ranges of doc_id, cut at quantiles; each range's first
    document is also sent behind the range before it, so ranges are
    independent. Only the ranges' borders, one number each, reach the driver.
    """
    n = partitions(docs)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("__key")
    keys = docs.select(key)
    cuts = keys.agg(F.percentile_approx("__key", [i / (4 * n) for i in range(1, 4 * n)], 100 * n).alias("c")).first()["c"] or []
    cuts = np.unique(np.array(cuts, np.int64))
    shared = docs.sparkSession.sparkContext.broadcast(cuts)

    def bucket(k: np.ndarray) -> np.ndarray:  # larger keys, smaller buckets
        return len(shared.value) - np.searchsorted(shared.value, k, side="left")

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most: dict[int, int] = {}
        for b in batches:
            k = b.column(0).to_numpy()
            at = bucket(k)
            for i in np.unique(at).tolist():
                most[i] = max(most.get(i, -(1 << 63)), int(k[at == i].max()))
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(list(most), pa.int64()), "top": pa.array(list(most.values()), pa.int64())})
    found = keys.mapInArrow(tops, "bucket long, top long").groupBy("bucket").agg(F.max("top").alias("top")).orderBy("bucket").collect()
    before = {r["top"]: found[i - 1]["bucket"] for i, r in enumerate(found)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.column("__key").to_numpy()
            again = np.array([i for i, x in enumerate(k.tolist()) if x in before], np.int64)
            row = np.concatenate([np.arange(len(k)), again])
            at = np.concatenate([bucket(k), np.array([before[x] for x in k[again].tolist()], np.int64)])
            tail = np.arange(len(row)) >= len(k)
            rows = b.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("text"), rows.column("__key"), pa.array(at.astype(np.int64)), pa.array(tail)],
                                             ["doc_id", "text", "__key", "__bucket", "__tail"])
    slim = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), key)
    wide = slim.select("*", F.lit(0).cast("long").alias("__bucket"), F.lit(False).alias("__tail")).schema
    dealt = slim.mapInArrow(deal, wide).repartition(n, "__bucket")
    ordered = dealt.sortWithinPartitions("__bucket", "__tail", F.col("__key").desc(), "text")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # bucket, doc_id, text of the row that waits for its next
        for b in batches:
            triples = []
            for where, tail, doc, text in zip(*[b.column(c).to_pylist() for c in ("__bucket", "__tail", "doc_id", "text")], strict=True):
                if held is not None and held[0] == where:
                    triples.append((held[1], held[2], text))
                held = None if tail else (where, doc, text)
            yield from run(triples)
    return ordered.mapInArrow(walk, schema)


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next. The edited text
    has its last third replaced by the next document's first characters.

    A null text is empty; two empty texts have likeness 1. A single document
    is its own next one. An empty table gives no rows; other columns are not
    read. Very long texts are read whole.
    """
    ids = docs.select("doc_id").limit(0).toArrow().schema.field(0).type
    schema = docs.select("doc_id").schema.add("n_chars", "long")
    for name in ("edited_sha256", "fingerprint", "edited_fingerprint"):
        schema = schema.add(name, "string")
    schema = schema.add("near_edited", "double").add("near_next", "double")

    def run(triples: list[tuple]) -> Iterator[pa.RecordBatch]:
        edited = [t[:len(t) - len(t) // 3] + after[:len(t) // 3] for _, t, after in triples]
        own, changed, nxt = (fingerprints(x) for x in ([t for _, t, _ in triples], edited, [after for _, _, after in triples]))
        yield pa.RecordBatch.from_arrays([
            pa.array([d for d, _, _ in triples], ids), pa.array([len(t) for _, t, _ in triples], pa.int64()),
            pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
            pa.array(own, pa.string()), pa.array(changed, pa.string()),
            pa.array([likeness(a, b) for a, b in zip(own, changed, strict=True)], pa.float64()),
            pa.array([likeness(a, b) for a, b in zip(own, nxt, strict=True)], pa.float64())], schema.names)
    return with_next(docs, run, schema)
