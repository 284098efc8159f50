"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.llm.common import free, materialize, numbered, q, running_sum
from limnos.llm.words import Words


def word_sizes(docs: DataFrame, keep: Sequence[str] = ("doc_id", "source")) -> DataFrame:
    """``keep`` columns of each row and ``size``, the words of its whole text
    (null text: 0)."""
    schema = docs.select(*keep).schema.add("size", "long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = Words(b.column("text")).counts()
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(size, pa.int64())], [*keep, "size"])
    return docs.select(*keep, "text").mapInArrow(count, schema)


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), factor: float = 1.5, most: int = 2) -> DataFrame:
    """One row per source: source_size, target. Sources in code point order,
    null last, take the weights in turn and share ``factor`` times all words;
    a target stops at ``most`` times its source's size and the excess goes to
    the rest by weight, until none is above (sorted by the share at which
    each fills up, everything before the first that stays below is full)."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("__one", F.lit(1))
    ranked = running_sum(per, [], ["source"], {"__rank": "__one"})
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("__rank") % len(weights) + 1).cast("int"))
    caps = ranked.select("source", "source_size", weight.alias("__w"), (F.col("source_size") * most).alias("__cap"))
    caps = caps.withColumn("__fill", F.col("__cap") / F.col("__w"))
    steps = materialize(running_sum(caps, [], ["__fill", "source"], {"__caps": "__cap", "__ws": "__w"}), "targets")
    whole = steps.agg(F.sum("__w").alias("w"), F.sum("source_size").alias("n"))
    level = (F.lit(factor) * whole.select("n").scalar() - F.col("__caps")) / (whole.select("w").scalar() - F.col("__ws"))
    open_ = steps.withColumn("__level", level).filter(F.col("__fill") > F.col("__level"))
    share = open_.agg(F.min_by("__level", "__fill").alias("s")).scalar()
    target = F.least(F.col("__cap").cast("double"), F.coalesce(share * F.col("__w"), F.col("__cap").cast("double")))
    return steps.select("source", "source_size", target.alias("target"))


def mix(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), factor: float = 1.5, most: int = 2) -> DataFrame:
    """The rows of ``sizes`` (any columns; doc_id, source and size among them)
    with source_size, target and taken, the words the mix takes of the row.

    Each source's documents, shuffled by a hash of doc_id, queue up ``most``
    times over. A copy's virtual finish time is its queue's words up to its
    end divided by the target; copies are sorted by it over all sources and
    the mix stops at the total budget. Its last words stand at time 1, so a
    copy that reaches beyond gives the words before.

    Defined cases: null or empty text has size 0 and gives nothing; a null
    source is a source, a null doc_id a document, repeated rows are separate
    documents; an empty table gives an empty one; other columns pass through,
    whatever their names. Texts behind ``sizes`` are counted once: it is
    written first.
    """
    sizes = materialize(sizes, "sizes")
    targets = source_targets(sizes, weights, factor, most).select(
        F.col("source").alias("__source"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"))
    drop = [c for c in ("source_size", "target", "taken") if c in sizes.columns]
    own = ("doc_id", "source", "size")
    rest = [c for c in sizes.columns if c not in drop and c not in own]
    # other columns travel inside a struct, where no name of ours meets theirs
    keyed = sizes.select(*own, *([F.struct(*[F.col(q(c)) for c in rest]).alias("__rest")] if rest else []))
    keyed = keyed.withColumn("__shuffle", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    queue = running_sum(keyed, ["source"], ["__shuffle", "doc_id", "size"], {"__before": "size"})
    queue = queue.join(targets, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    queue = materialize(queue.withColumn("__row", F.monotonically_increasing_id()), "queue")

    copies = queue.select("__row", "source", "__shuffle", "size", "__target", "__before", "__source_size",
                          F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("__copy"))
    start = F.col("__copy") * F.col("__source_size") + F.col("__before")
    copies = copies.withColumn("__part", F.least(F.col("size"), F.floor("__target") - start)).filter("__part > 0")
    copies = copies.withColumn("__finish", F.least(F.lit(1.0), (start + F.col("size")) / F.col("__target")))
    line = running_sum(copies, [], ["__finish", "source", "__shuffle", "__row", "__copy"], {"__position": "__part"})
    budget = sizes.agg(F.floor(F.lit(factor) * F.coalesce(F.sum("size"), F.lit(0))).alias("b")).scalar()
    got = line.withColumn("__got", F.least(F.col("__part"), budget - F.col("__position"))).filter("__got > 0")
    taken = got.groupBy("__row").agg(F.sum("__got").alias("taken"))
    out = queue.join(taken, "__row", "left")
    kept = [F.col("__rest").getField(c).alias(c) if c in rest else F.col(c) for c in sizes.columns if c not in drop]
    return out.select(*kept, F.col("__source_size").alias("source_size"),
                      F.col("__target").alias("target"), F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), factor: float = 1.5, most: int = 2) -> DataFrame:
    """The mix as documents: the columns of ``docs``; each document as often
    as its words are taken, a last partial copy cut behind its last word
    taken. n_chars, where there is one, is the new text's length. ``docs``
    must be a written table, read again here by row. Null and empty texts have
    no words, so they are in no mix; a null source is a source; an empty table
    gives an empty one; other columns may have any name."""
    cols = docs.columns
    text = cols.index("text")
    id_, size_, taken_ = (free(cols, name) for name in ("__id", "__size", "__taken"))
    rows = docs.withColumn(id_, F.monotonically_increasing_id())
    plan = mix(word_sizes(rows, [id_, "doc_id", "source"]), weights, factor, most).filter("taken > 0")
    plan = plan.select(id_, F.col("size").alias(size_), F.col("taken").alias(taken_))
    joined = rows.join(plan, id_).select(*[F.col(q(c)) for c in cols], size_, taken_)

    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            *columns, sizes, counts = b.columns
            words = Words(columns[text])
            at, texts = [], []
            for i, (whole_text, size, taken) in enumerate(zip(columns[text].to_pylist(), sizes.to_pylist(), counts.to_pylist(), strict=True)):
                whole, rest = divmod(taken, size)
                at += [i] * (whole + (rest > 0))
                texts += [whole_text] * whole
                if rest:
                    end = words.end[words.first[i] + rest - 1]
                    texts.append(words.raw[words.borders[i]:end].tobytes().decode())
            at = pa.array(at, pa.int64())
            out = {c: column.take(at) for c, column in zip(cols, columns, strict=True)}
            out["text"] = pa.array(texts, out["text"].type)
            if "n_chars" in out:
                out["n_chars"] = pa.array([len(t) for t in texts], out["n_chars"].type)
            yield pa.RecordBatch.from_pydict(out)
    return numbered(joined).mapInArrow(copies, docs.schema)
