"""Language-model scores by online logistic context mixing.

A text is a sequence of lower-cased words and one end. Each token starts with
a bit for the end; a word is then its bytes and a closing space, eight bits
each. A bit is predicted from several hashed contexts, the last 1 to 6 bytes
of the text, over the borders of words, and all of the word so far, each with
a count of zeros and ones seen in training. Their logits are mixed by a weight
vector that a gate picks: the bit's place in its byte and how many contexts
have been seen before. Weights are learned online, one pass over the training
texts with each byte's own occurrence taken out of the counts, and the mixed
probability is refined by an adaptive table over gate and probability. A word
in the training list can also be named by its share there, or by its share in
documents of one class (letter frequencies, clustered without labels); the mix
of the three ways is learned too, and a text's probability is summed over
classes.

Texts are dealt into sequences of bounded length that a hash makes up, so that
neither the number of partitions nor the order of rows changes a score. A
sequence sends its distinct words to the tasks that own them, which count and
answer; its text stays where it is. In a sequence each byte is predicted once
with all that it is predicted from, and what recurs is looked up. The tables
have a fixed size; counts, weights and classes cover every byte of every
training document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.llm.common import materialize, materialize_by, partitions
from limnos.llm.words import _BYTE, _LOWER, _SPACE, Words, byte_hashes, mix64, planes, slices, text_bytes, unplanes

#: slots of each context's table: a power of two
SLOT_BITS = 18
#: bytes of context of each predictor; None: the word so far
ORDERS = (1, 2, 3, 4, 6, None)
#: columns of the refining table: logits from -8 to 8 by halves
_CELLS = 33
#: mixed logits from -12 to 12 are rounded to so many steps a unit
_LAST, _FINE = 12, 64
_STEPS = 2 * _LAST * _FINE + 1
_GATES = 8 * (len(ORDERS) + 1)
_REGIONS = 8
#: bytes that are predicted at once
_BLOCK = 1 << 13
#: characters of text to a piece of the vocabulary; a task holds one piece at a time
_PIECE = 1 << 22
#: bytes of text to a sequence, one document at least; the weights of the sequences are averaged
_SLICE = 1 << 22
#: document classes; rounds that fit their centres, fewer if none moves by _STILL
CLASSES, ROUNDS, _STILL = 8, 25, 1e-4
#: shares are summed as integers of so many bits, whose order doesn't matter
_SHARE_BITS = 24
_LOW = np.uint64(0xFF)
#: letters, then bytes of longer characters by their last six bits
_LETTER = np.full(256, -1, np.int8)
_LETTER[97:123] = np.arange(26)
_LETTER[128:] = 26 + np.arange(128) % 64
_LETTERS = 90


def _closed(raw: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words' bytes with a closing space behind each, and their lengths."""
    out = np.full(len(raw) + len(length), 32, np.uint8)
    ends = np.cumsum(length + 1)
    keep = np.ones(len(out), bool)
    keep[ends - 1] = False
    out[keep] = raw
    return out, length + 1


def letter_counts(raw: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Of lower-cased texts: (documents, letters)."""
    n = len(borders) - 1
    letter = _LETTER[raw]
    doc = np.repeat(np.arange(n, dtype=np.int32), np.diff(borders))
    known = letter >= 0
    return np.bincount(doc[known].astype(np.int64) * _LETTERS + letter[known], minlength=n * _LETTERS).reshape(n, _LETTERS)


def letter_shares(counts: np.ndarray) -> np.ndarray:
    """Square roots of each document's letter frequencies."""
    return np.sqrt(counts / np.maximum(1, counts.sum(axis=1, keepdims=True)))


def classes_of(shares: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (shares @ centres.T - (centres ** 2).sum(axis=1) / 2).argmax(axis=1)


def _windows(text: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of the texts: itself and the six before it in its text,
    behind one another in the low 56 bits, with their number (6 at most) above
    them; and the hash of what stands before it in its word, 56 bits of 64."""
    at, sizes = (np.cumsum(length) - length)[length > 0], length[length > 0]
    window = text.astype(np.uint64)
    for back in (1, 2):  # of 2 bytes, then of 4
        window[back:] |= window[:-back] << np.uint64(8 * back)
    window[4:] |= (window[:-4] & np.uint64(0xFFFFFF)) << np.uint64(32)
    window[len(text) and 4:] |= np.uint64(6 << 56)
    for place in range(6):  # the first bytes of a text have fewer before them
        here = at[sizes > place] + place
        window[here] = window[here] & np.uint64((1 << 8 * (place + 1)) - 1) | np.uint64(place << 56)
    begins = np.zeros(len(text) + 1, bool)
    begins[1:] = text == 32
    begins[at] = True
    begins = np.flatnonzero(begins[:-1])
    size = np.diff(begins, append=len(text))
    word = np.zeros(len(text), np.uint64)
    # running sums give the hash of the word so far
    for a in range(0, len(begins), 1 << 14):
        z = min(a + (1 << 14), len(begins))
        lo, hi = begins[a], begins[z - 1] + size[z - 1]
        start = np.repeat(begins[a:z] - lo, size[a:z])
        word[lo:hi] = mix64(_prefix_hashes(text[lo:hi], np.arange(hi - lo) - start, start)) & ~_LOW
    return window, word


def _parts(text: np.ndarray, length: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Windows and words of as many bytes at a time as two sequences hold, one word at least."""
    ends, most, lo = np.concatenate([[0], np.cumsum(length)]), 2 * _SLICE, 0
    cuts = ends if len(text) <= most else np.union1d(ends, np.flatnonzero(text == 32) + 1)
    while lo < len(text):
        hi = len(text) if len(text) - lo <= most else int(cuts[max(np.searchsorted(cuts, lo + most, side="right") - 1, np.searchsorted(cuts, lo, side="right"))])
        # contexts reach back six bytes, or to where a word begins
        back = min(6, lo - int(ends[np.searchsorted(ends, lo, side="right") - 1]))
        window, word = _windows(text[lo - back:hi], np.diff(np.clip(ends, lo - back, hi)))
        yield slice(lo, hi), window[back:], word[back:]
        lo = hi


def _distinct(window: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places in an order that a hash makes up, equal pairs behind one
    another, and where in it other pairs begin. (A pair may begin twice where
    hashes meet by chance.)"""
    if not len(window):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bits = np.uint64(max(1, (len(window) - 1).bit_length()))
    mixed = (window * np.uint64(0xBF58476D1CE4E5B9) ^ word) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    mixed = mixed >> bits << bits | np.arange(len(window), dtype=np.uint64)
    mixed.sort()
    order = (mixed & ((np.uint64(1) << bits) - np.uint64(1))).view(np.int64)
    a, b = window[order], word[order]
    return order, np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))


def _context(k: int, window: np.ndarray, word: np.ndarray) -> np.ndarray:
    order = ORDERS[k]
    if order is None:
        value = word
    else:
        value = window >> np.uint64(8) & np.uint64((1 << 8 * order) - 1) | np.minimum(window >> np.uint64(56), np.uint64(order)) << np.uint64(56)
    return (mix64(value + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(32)).astype(np.uint32)


def _contexts(window: np.ndarray, word: np.ndarray) -> list[np.ndarray]:
    """For each order the hash of what stands before a byte: the last bytes of
    its text, over the borders of words, or those of its word."""
    return [_context(k, window, word) for k in range(len(ORDERS))]


def _prefix_hashes(text: np.ndarray, place: np.ndarray, start: np.ndarray) -> np.ndarray:
    powers = np.full(int(place.max()) + 1, 0x9E3779B97F4A7C15, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    total = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(np.take(_BYTE, text, mode="clip") * np.take(powers, place, mode="clip"), out=total[1:])
    return total[:-1] - total[start] + place.astype(np.uint64)


def _slots(context: np.ndarray, node: np.ndarray) -> np.ndarray:
    # contexts are mixed already, so one product spreads a node over the slots
    return ((context ^ node * np.uint32(0x85EBCA6B)) * np.uint32(0x9E3779B1) >> np.uint32(32 - SLOT_BITS)).astype(np.int64)


def _bits(text: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each place the bits before it in the byte, as a node, and the bit."""
    whole = text.astype(np.uint32)
    for place in range(8):
        yield place, (1 << place) | (whole >> (8 - place)), ((whole >> (7 - place)) & 1).astype(np.int64)


def _pairs(window: np.ndarray, word: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each order the different pairs of a context and the byte behind it,
    as windows and words, and how often they occur (a pair may come twice,
    with a part of its occurrences each)."""
    word = word | window & _LOW
    word.sort()
    # the byte, those before it, the nearest first, and their number: equal pairs of each order are neighbours
    window = window.byteswap()
    window.sort()
    for k, order in enumerate(ORDERS):
        pairs = word
        if order is not None:
            pairs = window >> np.uint64(8 * (7 - order)) << np.uint64(8 * (7 - order)) | np.minimum(window & _LOW, np.uint64(order))
        first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
        times, pairs = np.diff(first, append=len(pairs)).astype(np.float64), pairs[first]
        yield k, pairs if order is None else pairs.byteswap(), pairs & ~_LOW, times


def count_tables(text: np.ndarray, length: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Zeros and ones by context and slot: (orders, 2, slots). ``weight``: of each text."""
    out = np.zeros((len(ORDERS), 2 << SLOT_BITS))
    for much in np.unique(weight[length > 0]).tolist():
        some = weight == much
        for _, *part in _parts(text[np.repeat(some, length)], length[some]):
            for k, window, word, times in _pairs(*part):
                for a in range(0, len(times), _BLOCK):
                    here, n = window[a:a + _BLOCK], times[a:a + _BLOCK] * much
                    context = _context(k, here, word[a:a + _BLOCK])
                    for _, node, bit in _bits(here & _LOW):
                        np.add.at(out[k], _slots(context, node) + (bit << SLOT_BITS), n)
    return out.reshape(len(ORDERS), 2, 1 << SLOT_BITS)


def _logits(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """0 where nothing was seen, and nowhere else."""
    out = np.log((ones + np.float32(0.02)) / (zeros + np.float32(0.02)))
    out[(out == 0) & (ones > 0)] = 1e-9
    return out


@dataclass
class Model:
    """tables: zeros and ones, (orders, slots, 2); weights: (gates, orders + 1);
    refine: (gates, cells) logits; ways: shares of words named by class, named
    by the list, spelled; train_docs, train_tokens, vocabulary (the last two
    with ends); class_docs, class_words: training documents and words."""

    tables: np.ndarray
    weights: np.ndarray
    refine: np.ndarray
    ways: np.ndarray
    train_docs: int
    train_tokens: int
    vocabulary: int
    class_docs: np.ndarray
    class_words: np.ndarray

    @cached_property
    def logits(self) -> np.ndarray:
        """Of each context's slot: (orders, slots)."""
        return _logits(self.tables[..., 0], self.tables[..., 1])

    @cached_property
    def logits_without(self) -> np.ndarray:
        """With one occurrence of a bit taken out: (orders, slots * 2), the bit last."""
        zeros, ones = self.tables[..., 0], self.tables[..., 1]
        out = np.stack([_logits(np.maximum(0, zeros - 1), ones), _logits(zeros, np.maximum(0, ones - 1))], axis=-1)
        return out.reshape(len(out), -1)

    @cached_property
    def answers(self) -> np.ndarray:
        """log10 probability of a bit by place, gate of the place, step and bit."""
        steps = np.arange(_STEPS) / _FINE - _LAST
        p = np.stack([self.refined(steps, np.full(_STEPS, g)) for g in range(_GATES)])
        return np.log10(np.stack([1 - p, p], axis=-1)).reshape(-1, 8, _STEPS, 2).transpose(1, 0, 2, 3).copy()

    def inputs(self, contexts: list[np.ndarray], node: np.ndarray, bit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Logits of the predictors, a row each, a bias behind them, and how
        many contexts were seen. With ``bit`` one occurrence of it is taken out
        of the counts."""
        tables = self.logits if bit is None else self.logits_without
        x = np.empty((len(ORDERS) + 1, len(node)), np.float32)
        seen = np.zeros(len(node), np.uint8)
        for k, context in enumerate(contexts):
            slot = _slots(context, node)
            if bit is not None:
                slot += slot
                slot += bit
            np.take(tables[k], slot, out=x[k], mode="clip")
            seen += x[k] != 0
        x[-1] = 0.3
        return x, seen.astype(np.int64)

    def byte_scores(self, text: np.ndarray, length: np.ndarray) -> np.ndarray:
        """log10 probability of each byte of the texts."""
        out = np.empty(len(text))
        for here, window, word in _parts(text, length):
            order, begin = _distinct(window, word)
            scores = np.zeros(len(begin))
            for a in range(0, len(begin), _BLOCK):
                at = order[begin[a:a + _BLOCK]]
                contexts, score = _contexts(window[at], word[at]), scores[a:a + _BLOCK]
                for place, node, bit in _bits(text[here][at]):
                    x, seen = self.inputs(contexts, node)
                    step = _steps(x, seen, self.weights[place::8])
                    score += np.take(self.answers[place], (seen * _STEPS + step) * 2 + bit, mode="clip")
            out[here][order] = np.repeat(scores, np.diff(begin, append=len(order)))
        return out

    def word_scores(self, text: np.ndarray, length: np.ndarray) -> np.ndarray:
        """log10 probability of each text given that it does not end before."""
        return np.diff(np.concatenate([[0.0], np.cumsum(self.byte_scores(text, length))])[np.concatenate([[0], np.cumsum(length)])])

    def refined(self, logit: np.ndarray, gate: np.ndarray) -> np.ndarray:
        z = np.clip(logit, -12, 12)
        cell, part = _cell(z)
        flat = self.refine.ravel()
        at = gate * _CELLS + cell
        again = np.take(flat, at, mode="clip") * (1 - part) + np.take(flat, at + 1, mode="clip") * part
        return np.clip(1 / (1 + np.exp(-(z + again) / 2)), 1e-6, 1 - 1e-6)


def _cell(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.clip((z + 8) * 2, 0, _CELLS - 1.001)
    cell = at.astype(np.int64)
    return cell, at - cell


def _steps(x: np.ndarray, seen: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The mixed logit, in steps from the least. ``weights``: of the gates of one place."""
    every = weights.astype(np.float32) @ x
    logit = np.take(every, seen * len(seen) + np.arange(len(seen)), mode="clip")
    logit += np.float32(_LAST)
    logit *= np.float32(_FINE)
    return np.clip(np.rint(logit, out=logit), 0, _STEPS - 1, out=logit).astype(np.int64)


def learn(model: Model, text: np.ndarray, length: np.ndarray, rate: float = 2.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One online pass over the bytes of texts: the weights, per gate and cell
    the sums (ones, all) that the refining table is made of, and each byte's
    log probability as met. Bytes come in an order that a hash makes up, equal
    ones with all that they're predicted from at once."""
    weights, gates = model.weights.copy(), len(ORDERS) + 1
    sums = np.zeros((8, gates * _STEPS * 2))
    logit = np.arange(_STEPS) / _FINE - _LAST
    chance = 1 / (1 + np.exp(-logit))
    code = np.log(np.stack([1 - chance, chance], axis=-1)).ravel()
    error = np.stack([-chance, 1 - chance], axis=-1).ravel().astype(np.float32)
    out = np.empty(len(text))
    for part, window, word in _parts(text, length):
        order, begin = _distinct(window, word)
        times, met = np.diff(begin, append=len(order)), np.zeros(len(begin))
        for a in range(0, len(begin), _BLOCK):
            at, much = order[begin[a:a + _BLOCK]], times[a:a + _BLOCK].astype(np.float32)
            contexts, log = _contexts(window[at], word[at]), met[a:a + _BLOCK]
            for place, node, bit in _bits(text[part][at]):
                x, seen = model.inputs(contexts, node, bit)
                step = _steps(x, seen, weights[place::8]) * 2 + bit
                log += np.take(code, step, mode="clip")
                here = (seen == np.arange(gates)[:, None]).astype(np.float32)
                here *= much
                size = here.sum(axis=1, dtype=np.float64)
                here *= np.take(error, step, mode="clip")
                weights[place::8] += rate * (here @ x.T) / np.maximum(50.0, size)[:, None]
                sums[place] += np.bincount(seen * (2 * _STEPS) + step, much, sums.shape[1])
        out[part][order] = np.repeat(met, times)
    sums = sums.reshape(8, gates, _STEPS, 2).transpose(1, 0, 2, 3).reshape(_GATES, _STEPS, 2)
    cell, upper = _cell(logit)
    spread = np.zeros((_STEPS, _CELLS))
    spread[np.arange(_STEPS), cell] += 1 - upper
    spread[np.arange(_STEPS), cell + 1] += upper
    return weights, np.stack([sums[..., 1] @ spread, sums.sum(axis=2) @ spread]).reshape(2, -1), out


def shares_of_ways(logs: np.ndarray) -> np.ndarray:
    """The shares that give words the greatest probability, by expectation
    maximisation. ``logs``: (ways, words). Words whose ways compare alike, to a
    sixteenth, are taken together with their mean."""
    ratio = np.exp(np.maximum(logs - logs.max(axis=0), -20))
    _, group = np.unique(np.rint(np.log(ratio) * 16).astype(np.int64).T @ np.array([1 << 20, 1 << 10, 1]), return_inverse=True)
    n = np.bincount(group).astype(np.float64)
    way = np.stack([np.bincount(group, r) for r in ratio]) / n
    ways = np.full(len(logs), 1 / len(logs))
    for _ in range(40):
        part = ways[:, None] * way
        ways = np.clip((part / part.sum(axis=0) * n).sum(axis=1) / n.sum(), 1e-3, 1)
        ways /= ways.sum()
    return ways


_SENT = "kind int, bucket int, held long, piece int, hashes binary, counts binary, at binary, docs binary, flags binary, starts binary, text binary"


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Neighbours of one bucket with _SLICE bytes of text at most, one row at
    least, wherever batches end."""
    kept, size, current = [], 0, None

    def joined(rows):
        return current, pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
    for b in batches:
        lo, buckets, ends = 0, b.column("bucket").to_pylist(), text_bytes(b.column("text"))[1]
        for i, n in enumerate(np.diff(ends).tolist()):
            if (buckets[i] != current or size + n > _SLICE) and (kept or i > lo):
                yield joined([*kept, *([b.slice(lo, i - lo)] if i > lo else [])])
                kept, size, lo = [], 0, i
            current, size = buckets[i], size + n
        if lo < b.num_rows:
            kept.append(b.slice(lo))
    if kept:
        yield joined(kept)


def _send(docs: DataFrame, pieces: int, buckets: int, centres: np.ndarray) -> DataFrame:
    """Documents in sequences (``held``), which follow from the documents alone.
    Kind 0: for a piece, the hashes of distinct words of a sequence with their
    training occurrences by class and their numbers there (``at``). Kind 1: a
    sequence's documents (``flags``: 1 held out, 2 null id, 4 times the class;
    ``starts``: words before each) and their words, each with a space behind it."""
    schema = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("held", pa.int64()), ("piece", pa.int32()), *[(c, pa.binary()) for c in ("hashes", "counts", "at", "docs", "flags", "starts", "text")]])

    k = len(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for serial, (bucket, b) in enumerate(_sequences(batches)):
            words, held = Words(b.column("text"), lower=True), part << 32 | serial
            out = b.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            ids = b.column("doc_id")
            of = classes_of(letter_shares(letter_counts(words.raw, words.borders)), centres)
            flags = out.astype("u1") | np.where(ids.is_null().to_numpy(zero_copy_only=False), 2, 0).astype("u1") | (of << 2).astype("u1")
            hashes, number = np.unique(words.hashes(), return_inverse=True)
            doc = words.doc_of()
            counts = np.bincount(number * k + of[doc], ~out[doc], len(hashes) * k).astype("<u4").reshape(-1, k)
            rows = [dict(kind=1, bucket=bucket, held=held, docs=ids.fill_null(0).cast(pa.int64()).to_numpy().tobytes(), flags=flags.tobytes(), starts=words.first.astype("<u4").tobytes(),
                         text=_closed(words.raw[~_SPACE[words.raw]], words.end - words.start)[0].tobytes())]
            piece = (hashes % np.uint64(pieces)).astype(np.int64)
            order = np.argsort(piece, kind="stable")
            ends = np.searchsorted(piece[order], np.arange(pieces + 1))
            for p in np.unique(piece).tolist():
                at = order[ends[p]:ends[p + 1]]
                rows.append(dict(kind=0, bucket=bucket, held=held, piece=p, hashes=hashes[at].tobytes(), counts=zlib.compress(planes(counts[at].T.ravel()), 1), at=planes(np.diff(at, prepend=0))))
            yield pa.RecordBatch.from_pylist(rows, schema)
    key = F.xxhash64("doc_id", "text")
    dealt = docs.select("doc_id", "held_out", "text", key.alias("key"), F.pmod(key, F.lit(buckets)).cast("int").alias("bucket"))
    return dealt.repartition(partitions(docs), "bucket").sortWithinPartitions("bucket", "key", "doc_id", "held_out").mapInArrow(run, _SENT)


def _rows(batch: pa.RecordBatch, names: tuple[str, ...]) -> Iterator[list]:
    """Rows of a batch of large values, one at a time."""
    columns = [batch.column(c) for c in names]
    for i in range(batch.num_rows):
        yield [c[i].as_py() for c in columns]


def _answer(asked: DataFrame) -> DataFrame:
    """Kind 0: to a sequence, the training occurrences of words by class, and
    behind them 1 for one of the sequences that has a word in training. Kind 2:
    training words and distinct ones of a piece."""
    schema = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("held", pa.int64()), ("at", pa.binary()), ("counts", pa.binary()), ("tokens", pa.list_(pa.int64())), ("distinct", pa.int64())])

    def join(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        counts = np.concatenate([unplanes(zlib.decompress(r[3])).reshape(-1, len(r[2]) // 8).T for r in rows])
        distinct, number = np.unique(np.concatenate([np.frombuffer(r[2], np.uint64) for r in rows]), return_inverse=True)
        total = np.stack([np.bincount(number, c, len(distinct)) for c in counts.T], axis=1)
        met, chosen = np.flatnonzero(counts.any(axis=1)), np.zeros(len(counts))
        chosen[met[np.unique(number[met], return_index=True)[1]]] = 1
        a = 0
        for bucket, held, hashes, _, at in rows:
            z = a + len(hashes) // 8
            yield pa.RecordBatch.from_pylist([dict(kind=0, bucket=bucket, held=held, at=at, counts=zlib.compress(planes(np.column_stack([total[number[a:z]], chosen[a:z]]).T.ravel()), 1))], schema)
            a = z
        yield pa.RecordBatch.from_pylist([dict(kind=2, tokens=total.sum(axis=0).astype(np.int64).tolist(), distinct=int(total.any(axis=1).sum()))], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows = None, []
        for b in batches:
            for piece, *row in _rows(b, ("piece", "bucket", "held", "hashes", "counts", "at")):
                if piece != current and rows:
                    yield from join(rows)
                    rows = []
                current = piece
                rows.append(tuple(row))
        if rows:
            yield from join(rows)
    return asked.mapInArrow(run, "kind int, bucket int, held long, at binary, counts binary, tokens array<long>, distinct long")


class _Texts:
    """A sequence: documents i (``out``: held out, ``of``: class) of words
    first[i] .. first[i + 1] - 1; ``text``: words with a space behind each,
    ``size`` and ``length``: bytes of words and of documents."""

    def __init__(self, flags: bytes, starts: bytes, text: bytes):
        self.flags, self.first, self.text = np.frombuffer(flags, "u1"), np.frombuffer(starts, "<u4").astype(np.int64), np.frombuffer(text, np.uint8)
        self.out, self.of = self.flags & 1 > 0, self.flags >> 2
        ends = np.concatenate([[0], np.flatnonzero(self.text == 32) + 1])
        self.size, self.length = np.diff(ends), np.diff(ends[self.first])

    def words(self, told: list[dict] | None, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each word its number, and of each number what was told: training
        occurrences by class, and whether the word counts here."""
        end = np.cumsum(self.size)
        distinct, number = np.unique(byte_hashes(self.text, end - self.size, end - 1), return_inverse=True)
        counts = np.zeros((len(distinct), classes + 1))
        for r in told or []:
            counts[np.cumsum(unplanes(r["at"]))] = unplanes(zlib.decompress(r["counts"])).reshape(classes + 1, -1).T
        return number, counts[:, :-1], counts[:, -1]

    def train(self) -> tuple[np.ndarray, np.ndarray]:
        return self.text[np.repeat(~self.out, self.length)], self.length[~self.out]


def fit(texts: DataFrame, totals: DataFrame, class_docs: np.ndarray) -> Model:
    """The model of the training documents. ``totals``: words of the pieces."""
    spark, train_docs, classes = texts.sparkSession, int(class_docs.sum()), len(class_docs)
    tasks = max(min(8, partitions(texts)), partitions(texts) // 8)
    total = totals.agg(*[F.coalesce(F.sum(F.col("tokens")[i]), F.lit(0)).alias(f"n{i}") for i in range(classes)], F.coalesce(F.sum("distinct"), F.lit(0)).alias("v")).first()
    class_words = np.array([total[f"n{i}"] for i in range(classes)], np.int64)

    size = len(ORDERS) * 2 << SLOT_BITS
    width = size // _REGIONS

    def count(batches):
        tables = np.zeros(size)
        for b in batches:
            for row in _rows(b, ("flags", "starts", "text")):
                text, length = _Texts(*row).train()
                tables += count_tables(text, length, np.ones(len(length))).ravel()
        for r, part in enumerate(np.split(tables, _REGIONS)):
            at = np.flatnonzero(part)
            yield pa.RecordBatch.from_pylist([dict(region=r, slots=at.astype("<u4").tobytes(), sums=part[at].astype("<f4").tobytes())], counted)
    counted = pa.schema([("region", pa.int32()), ("slots", pa.binary()), ("sums", pa.binary())])

    def add(batches):
        regions: dict[int, np.ndarray] = {}
        for b in batches:
            for r, slots, sums in _rows(b, tuple(counted.names)):
                np.add.at(regions.setdefault(r, np.zeros(width)), np.frombuffer(slots, "<u4"), np.frombuffer(sums, "<f4"))
        for r, sums in regions.items():
            yield pa.RecordBatch.from_pylist([dict(region=r, sums=sums.astype("<f4").tobytes())], pa.schema([("region", pa.int32()), ("sums", pa.binary())]))
    sums = texts.select("flags", "starts", "text").coalesce(tasks).mapInArrow(count, "region int, slots binary, sums binary").repartition(_REGIONS, "region")
    tables = np.zeros((_REGIONS, width), np.float32)
    if total["v"]:
        for r in sums.mapInArrow(add, "region int, sums binary").collect():
            tables[r["region"]] = np.frombuffer(r["sums"], "<f4")
    tables = np.ascontiguousarray(tables.reshape(len(ORDERS), 2, 1 << SLOT_BITS).transpose(0, 2, 1))
    centre = (np.arange(_CELLS) - 16) / 2.0
    model = Model(tables, np.full((_GATES, len(ORDERS) + 1), 1.0 / len(ORDERS)), np.tile(centre, (_GATES, 1)), np.array([0.0, 0.0, 1.0]),
                  train_docs, int(class_words.sum()) + train_docs, total["v"] + (train_docs > 0), class_docs, class_words)
    if not total["v"]:
        return model
    shared = spark.sparkContext.broadcast(model)

    def train(batches):
        m, schema = shared.value, pa.schema([*[(c, pa.float64()) for c in ("n", "tokens", "bytes")], *[(c, pa.list_(pa.float64())) for c in ("ways", "weights", "cells")]])
        for b in batches:
            for *row, told in _rows(b, ("flags", "starts", "text", "told")):
                t = _Texts(*row)
                text, length = t.train()
                if not len(text):
                    continue
                weights, cells, met = learn(m, text, length)
                number, by_class, chosen = t.words(told, classes)
                here = np.repeat(~t.out, np.diff(t.first))
                at, of, sizes = number[here], np.repeat(t.of, np.diff(t.first))[here], t.size[here]
                with np.errstate(divide="ignore"):
                    logs = np.log(np.stack([(by_class[at, of] - 1) / np.maximum(1, m.class_words[of]), (by_class.sum(axis=1)[at] - 1) / max(1, m.train_tokens - m.train_docs), np.ones(len(at))]))
                logs[2] = np.add.reduceat(met, np.cumsum(sizes) - sizes)
                yield pa.RecordBatch.from_pylist([dict(n=chosen.sum(), tokens=float(len(at)), bytes=float(len(text)), ways=(shares_of_ways(logs) * len(at)).tolist(), weights=(weights * len(text)).ravel().tolist(), cells=cells.ravel().tolist())], schema)
    got = materialize(texts.select("flags", "starts", "text", "told").mapInArrow(train, "n double, tokens double, bytes double, ways array<double>, weights array<double>, cells array<double>"), "trained")

    def summed(name: str) -> np.ndarray:
        rows = got.select(F.posexplode(name).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()
        return np.array([x for _, x in sorted((r["i"], r["x"]) for r in rows)])
    learned = got.agg(*[F.sum(c).alias(c) for c in ("n", "tokens", "bytes")]).first()
    if (learned["n"], learned["tokens"]) != (total["v"], class_words.sum()):
        raise RuntimeError(f"learned from {learned['tokens']} words, {learned['n']} of them distinct; there are {class_words.sum()} and {total['v']}")
    ones, all_ = summed("cells").reshape(2, _GATES, _CELLS)
    p = (ones + 20 / (1 + np.exp(-centre))) / (all_ + 20)
    return Model(tables, summed("weights").reshape(model.weights.shape) / learned["bytes"], np.log(p / (1 - p)), summed("ways") / learned["tokens"], train_docs, model.train_tokens, model.vocabulary, class_docs, class_words)


def _classes(train: DataFrame) -> np.ndarray:
    """Centres of the document classes by k-means over all training texts. Each
    start is one text, drawn by its hash in proportion to its squared distance
    from those before; copies draw as one text would and count as often as
    they are."""
    def count(batches):
        for whole in batches:
            for b in slices(whole, most=_SLICE):
                raw, borders = text_bytes(b.column("text"))
                yield pa.RecordBatch.from_pylist([dict(keys=b.column("key").to_numpy().astype("<i8").tobytes(), counts=planes(letter_counts(_LOWER[raw], borders).ravel()))])
    counted = train.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"))
    counted = materialize(counted.mapInArrow(count, "keys binary, counts binary"), "letters")

    def documents(batches):
        for b in batches:
            for keys, counts in _rows(b, ("keys", "counts")):
                yield np.frombuffer(keys, "<i8"), letter_shares(unplanes(counts).reshape(-1, _LETTERS))

    centres = np.zeros((0, _LETTERS))
    for turn in range(CLASSES):
        def draw(batches, centres=centres, salt=_BYTE[turn]):
            best = None
            for keys, shares in documents(batches):
                far = ((shares[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1) if len(centres) else np.ones(len(keys))
                drawn = ((mix64(keys.view(np.uint64) ^ salt) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)
                late = np.where(far < 1e-9, np.inf, -np.log(drawn) / np.maximum(far, 1e-9))
                at = int(np.lexsort((keys, late))[0])
                if late[at] < np.inf and (best is None or (late[at], keys[at]) < best[:2]):
                    best = float(late[at]), int(keys[at]), shares[at].tolist()
            if best:
                yield pa.RecordBatch.from_pylist([dict(zip(("late", "key", "x"), best, strict=True))])
        first = counted.mapInArrow(draw, "late double, key long, x array<double>").agg(F.min(F.struct("late", "key", "x"))).first()[0]
        if first is None:
            break
        centres = np.vstack([centres, first["x"]])
    for _ in range(ROUNDS if len(centres) else 0):
        def add(batches, centres=centres):
            total = np.zeros((len(centres), _LETTERS + 1), np.int64)
            for _, shares in documents(batches):
                of, whole = classes_of(shares, centres), np.rint(shares * (1 << _SHARE_BITS)).astype(np.int64)
                for i in np.unique(of).tolist():
                    total[i, :-1] += whole[of == i].sum(axis=0)
                    total[i, -1] += (of == i).sum()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["i", "n"])
        rows = counted.mapInArrow(add, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()
        total = np.array([n for _, n in sorted((r["i"], r["n"]) for r in rows)], np.float64).reshape(len(centres), -1)
        moved = np.where(total[:, -1:] > 0, total[:, :-1] / np.maximum(1, total[:, -1:]) / (1 << _SHARE_BITS), centres)
        still = np.abs(moved - centres).max() < _STILL
        centres = moved
        if still:
            break
    return centres if len(centres) else np.zeros((1, _LETTERS))


def _class_docs(texts: DataFrame, classes: int) -> np.ndarray:
    """Training documents of each class."""
    def count(batches):
        total = np.zeros(classes, np.int64)
        for b in batches:
            for blob in b.column(0).to_pylist():
                flags = np.frombuffer(blob, "u1")
                total += np.bincount(flags[flags & 1 == 0] >> 2, minlength=classes)
        yield pa.RecordBatch.from_pydict({"i": np.arange(classes), "n": total})
    rows = texts.select("flags").mapInArrow(count, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()
    counts = {r["i"]: r["n"] for r in rows}
    return np.array([counts.get(i, 0) for i in range(classes)], np.int64)


def score(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, held_out) scored: doc_id, held_out, n_tokens,
    n_known, train_tokens, base_score, score. Documents that aren't held out
    are learned from; the base is the smoothed unigram model of their tokens.

    Defined cases: a null or empty text is the end alone; without a training
    document the base is 0 a token and every bit has probability one half;
    rows with one doc_id are documents of their own; a null doc_id is a
    document; an empty table gives no rows; other columns are not read. The
    number of partitions does not matter.
    """
    tasks = partitions(docs)
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    pieces, buckets = max(1, chars // _PIECE), max(1, chars * 4 // (_PIECE * 3))
    centres = _classes(docs.filter(~F.col("held_out")).select("text"))
    sent = materialize_by(_send(docs.select("doc_id", "held_out", "text"), pieces, buckets, centres), "bucket", "words")
    asked = sent.filter("kind = 0").select("piece", "bucket", "held", "hashes", "counts", "at").repartition(tasks, "piece").sortWithinPartitions("piece")
    answers = materialize(_answer(asked), "vocabulary")
    told = answers.filter("kind = 0").groupBy(F.col("bucket").alias("to"), F.col("held").alias("asker")).agg(F.collect_list(F.struct("at", "counts")).alias("told"))
    texts = sent.filter("kind = 1").select("bucket", "held", "docs", "flags", "starts", "text")
    # texts stay in their buckets: their number alone is the key
    texts = texts.join(told, (F.col("bucket") == F.col("to")) & F.col("held").between(F.col("asker"), F.col("asker")), "left")
    model = fit(texts, answers.filter("kind = 2"), _class_docs(texts, len(centres)))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = docs.select("doc_id").schema.add("held_out", "boolean").add("n_tokens", "long").add("n_known", "long").add("train_tokens", "long").add("base_score", "double").add("score", "double")
    ids_type = docs.select("doc_id").limit(0).toArrow().schema.field(0).type

    def add_up(batches):
        m = shared.value
        scale = m.train_tokens + 0.1 * (m.vocabulary + 1)
        end = (m.train_docs + 0.5) / (m.train_tokens + 1.0)
        prior = np.log((m.class_docs + 0.5) / (m.class_docs + 0.5).sum())
        for b in batches:
            for docs_, *row, replies in _rows(b, ("docs", "flags", "starts", "text", "told")):
                t = _Texts(*row)
                number, by_class, _ = t.words(replies, len(m.class_docs))
                every, ids, begin = by_class.sum(axis=1), np.frombuffer(docs_, "<i8"), np.cumsum(t.size) - t.size

                def per_doc(x, first=t.first):
                    return np.diff(np.concatenate([[0.0], np.cumsum(x)])[first])
                n_words = np.diff(t.first).astype(np.float64)
                base = per_doc(np.log10((every + 0.1) / scale)[number]) + np.log10((m.train_docs + 0.1) / scale)
                known = per_doc((every > 0)[number]) + (m.train_docs > 0)
                log = np.add.reduceat(m.byte_scores(t.text, t.length), begin) * np.log(10) if len(begin) else np.zeros(0)
                with np.errstate(divide="ignore"):
                    other = np.logaddexp(np.log(m.ways[1] * every / max(1, m.train_tokens - m.train_docs))[number], np.log(m.ways[2]) + log)
                by_doc, chance = [], np.exp(other)
                for i, words in enumerate(m.class_words.tolist()):
                    share = (m.ways[0] * by_class[:, i] / max(1, words))[number]
                    own, some = other.copy(), share > 0
                    own[some] = np.log(chance[some] + share[some])
                    by_doc.append(per_doc(own))
                own = np.logaddexp.reduce(np.stack(by_doc) + prior[:, None], axis=0) / np.log(10) + n_words * np.log10(1 - end) + np.log10(end)
                size = len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=t.flags & 2 > 0).cast(ids_type), pa.array(t.out), pa.array(n_words.astype(np.int64) + 1), pa.array(known.astype(np.int64)),
                                                  pa.array(np.full(size, m.train_tokens, np.int64)), pa.array(base), pa.array(own)], out.names)
    return texts.select("docs", "flags", "starts", "text", "told").mapInArrow(add_up, out)
