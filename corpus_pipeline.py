"""The corpus pipeline: five stages over ``documents``.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame that is written as Parquet and read again as the next
one's docs. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limnos.llm import jaccard, langid, mixing, packing, secrets
from limnos.llm.common import free, importable, materialize, q

#: languages predicted with less than this are rejected
LEAST_SCORE = 0.02
#: near duplicates share this percentage of their shingles of so many words
SHINGLE_WORDS, SHINGLE_PERCENT = 5, 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is null, has no letter or is of no learned
    language go; ``lang`` is the predicted one from here on."""
    importable(spark)
    model = langid.fit(docs)
    found = langid.predict(docs, model).filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return found.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays: the least doc_id (null
    is the largest), then the least hash of the whole row. Rows are documents
    of their own, whatever their doc_id; a row without words stays; other
    columns may have any name."""
    importable(spark)
    has_words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0d]"), F.lit(False))
    # nulls don't change the hash, so where they are is hashed too
    row = F.xxhash64(*[x for c in docs.columns for x in (F.col(q(c)), F.col(q(c)).isNull())])
    row_ = free(docs.columns, "__row")
    numbered = docs.filter(has_words).withColumn(row_, row)
    name = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.col(row_).alias("row"))
    # rows of measured lists have no name, so its column must allow null
    named = numbered.select(F.when(F.col(row_).isNotNull(), name).alias("doc_id"), "text")
    groups = jaccard.components(named, SHINGLE_WORDS, SHINGLE_PERCENT)
    least = groups.select("component_id.row").withColumnRenamed("row", row_).distinct()
    # rows with one hash are equal, so one of them stays
    kept = numbered.join(least, row_, "left_semi").dropDuplicates([row_]).select(*[F.col(q(c)) for c in docs.columns])
    return kept.unionByName(docs.filter(~has_words))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by the name of their kind."""
    importable(spark)
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document once or twice, its last copy cut where the source's
    target is reached, or not at all."""
    importable(spark)
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4,096 tokens."""
    importable(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("source_mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: tokenizing and classifying are beyond SQL
ORACLE_SQL = None
