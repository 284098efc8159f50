"""Fill-in-the-middle transformation: two cut ranks, counted in tokens, are
turned into code-point offsets by an indexable skip list.

A token is a word with the blanks before it; blanks behind the last word are
a token of their own. The list's lowest lane holds the tokens; a node of an
express lane stands for the tokens up to the next node of that lane and
carries how many they are and how many code points they have. Going down from
the highest lane by accumulated widths finds the offset of any rank in
O(log n) steps.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from limnos.llm.words import Words, mix64, slices

PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
#: a node reaches the next lane with odds of one in so many
SPREAD = 4


class SkipList:
    """A sequence of units of given code-point widths. ``lanes`` go from the
    units up; each is (units, code points, places of its nodes in the lane
    below). Heights come from a hash of the place, so that equal sequences
    give equal lists."""

    def __init__(self, widths: np.ndarray):
        units, points, below = np.ones(len(widths), np.int64), widths.astype(np.int64), None
        self.lanes = [(units, points, below)]
        coin = mix64(np.arange(1, len(widths) + 1, dtype=np.uint64))
        while len(units) > SPREAD:
            rises = coin % np.uint64(SPREAD) == 0
            rises[0] = True  # the head is in every lane
            below = np.flatnonzero(rises)
            units, points = np.add.reduceat(units, below), np.add.reduceat(points, below)
            self.lanes.append((units, points, below))
            coin = mix64(coin[below])

    def offset(self, rank: int) -> int:
        """Code points before unit ``rank``, which is from 0 to the number of units."""
        at = passed = offset = 0
        for units, points, below in reversed(self.lanes):
            while at < len(units) and passed + units[at] <= rank:
                passed, offset, at = passed + units[at], offset + points[at], at + 1
            if at == len(units):
                break
            at = at if below is None else below[at]
        return int(offset)


def _tokens(texts: pa.Array) -> Iterator[np.ndarray]:
    """Code-point widths of each text's tokens."""
    words = Words(texts)
    # code points before each byte
    points = np.zeros(len(words.raw) + 1, np.int32)
    np.cumsum((words.raw & 0xC0) != 0x80, out=points[1:])
    for i, (begin, end) in enumerate(zip(words.borders[:-1], words.borders[1:], strict=True)):
        ends = words.end[words.first[i]:words.first[i + 1]]
        if begin < end and (not len(ends) or ends[-1] < end):
            ends = np.append(ends, end)
        yield np.diff(points[ends], prepend=points[begin])


@dataclass(frozen=True)
class Plan:
    """How texts are dealt: of each hundred, ``rate`` are transformed, of each
    hundred of these ``spm`` begin with the suffix. ``seed`` and the
    document's id decide, so reruns agree."""

    seed: int = 42
    rate: int = 50
    spm: int = 80

    def transform(self, doc_id: int | None, text: str, widths: np.ndarray) -> tuple[str, int | None, int | None, str]:
        """form, code points of prefix and middle, output."""
        digest = hashlib.sha256(f"{self.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        h = [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]
        if not text or h[2] % 100 >= self.rate or any(m in text for m in MARKS):
            return "plain", None, None, text
        units = SkipList(widths)
        a, b = sorted(units.offset(x % (len(widths) + 1)) for x in h[:2])
        prefix, middle, suffix = text[:a], text[a:b], text[b:]
        if h[3] % 100 < self.spm:
            return "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
        return "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restore(form: str, output: str) -> str:
    """The text that ``transform`` made ``output`` of. No mark occurs in a
    transformed text, none can begin inside another, so the first occurrence
    of each is the one that was put there."""
    if form == "plain":
        return output
    head, middle = output.split(MIDDLE, 1)
    if form == "psm":
        prefix, suffix = head[len(PREFIX):].split(SUFFIX, 1)
    else:
        suffix, prefix = head[len(SUFFIX):].split(PREFIX, 1)
    return prefix + middle + suffix


def fill_in_middle(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """One row per row of ``docs``: doc_id, n (tokens), form (plain, psm or
    spm), prefix_chars, middle_chars (code points; null if plain), output.

    Defined cases: a null text is an empty one; an empty text, and one that
    holds any of the marks, stays as it is (plain); a null doc_id is hashed as
    the empty string; rows with one doc_id get the same ranks; a text of any
    length is cut whole; an empty table gives no rows; other columns are not
    read, whatever their names.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole):
                texts = b.column("text").fill_null("")
                rows = [(len(widths), *plan.transform(doc_id, text, widths))
                        for doc_id, text, widths in zip(b.column("doc_id").to_pylist(), texts.to_pylist(), _tokens(texts), strict=True)]
                cols = list(zip(*rows, strict=True)) or [()] * 5
                types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], schema.names)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n", T.LongType()), T.StructField("form", T.StringType()),
                           T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def digests(made: DataFrame) -> DataFrame:
    """The columns of ``fill_in_middle`` with the output replaced by its digest
    and that of the text restored from it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            forms, outputs = b.column("form").to_pylist(), b.column("output").to_pylist()
            out = [hashlib.sha256(o.encode()).hexdigest() for o in outputs]
            back = [hashlib.sha256(restore(f, o).encode()).hexdigest() for f, o in zip(forms, outputs, strict=True)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(out, pa.string()), pa.array(back, pa.string())], schema.names)
    kept = [c for c in made.columns if c != "output"]
    schema = made.select(*kept).schema.add("output_sha256", "string").add("restored_sha256", "string")
    return made.mapInArrow(run, schema)
