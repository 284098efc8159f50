"""JSON documents of any layout (A05, A09, A11, G17): read as VARIANT, so a
new model name, hyper-parameter or metric needs no schema.

Comparison document::

    {"<model>": {"hyperparameters": {...}, "batch_size": 32, "metrics": {"mse": 0.15, ...}}, ..., "best_model": "<model>"}

Trial document::

    {"trial_id": "00", "status": "COMPLETED", "score": 0.15, "best_step": 5, "hyperparameters": {"values": {...}},
     "metrics": {"metrics": {"val_loss": {"direction": "min", "observations": [{"value": [0.15], "step": 5}]}}}, "message": null}
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BEST = "best_model"


def read_documents(spark: SparkSession, path: str, glob: str | None = None, per_line: bool = False) -> DataFrame:
    """(source, doc) of every JSON document below ``path``, a file each or
    (``per_line``) a line each; ``doc`` is a VARIANT. A text that is no JSON
    gives a NULL ``doc``, so that bad files can be counted."""
    r = spark.read.option("recursiveFileLookup", True)
    if glob:
        r = r.option("pathGlobFilter", glob)
    text = r.text(path, wholetext=not per_line).select(F.col("_metadata.file_path").alias("source"), "value")
    return text.where(F.trim("value") != "").select("source", F.try_parse_json("value").alias("doc"))


def _entries(df: DataFrame, doc: Column, key: str, value: str) -> DataFrame:
    """A row for each member of the object ``doc`` (none if it is no object)."""
    members = df.sparkSession.tvf.variant_explode(doc.outer())
    is_object = F.schema_of_variant(doc).startswith("OBJECT")
    return df.where(is_object).lateralJoin(members).where(F.col("key").isNotNull()).drop("pos").withColumnsRenamed({"key": key, "value": value})


def _text(v: Column) -> Column:
    """A scalar as text; objects and lists as JSON; null as NULL."""
    return F.when(~F.is_variant_null(v), F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v)))


def flatten_comparison(docs: DataFrame) -> DataFrame:
    """(source, model, section, name, value, number) for every metric and
    hyper-parameter of every model; other members of a model are in section
    ``settings``. ``number`` is NULL where ``value`` is none. Members of the
    document that are no objects (``best_model``) are no models."""
    models = _entries(docs, F.col("doc"), "model", "body").select("source", "model", "body")
    parts = _entries(models, F.col("body"), "section", "part").select("source", "model", "section", "part")
    nested = F.schema_of_variant("part").startswith("OBJECT")
    inner = _entries(parts, F.col("part"), "name", "leaf").select("source", "model", "section", "name", "leaf")
    plain = parts.where(~nested).select("source", "model", F.lit("settings").alias("section"), F.col("section").alias("name"), F.col("part").alias("leaf"))
    return inner.unionByName(plain).select("source", "model", "section", "name", _text(F.col("leaf")).alias("value"),
                                           F.when(F.schema_of_variant("leaf") != "BOOLEAN", F.try_variant_get("leaf", "$", "double")).alias("number"))


def best_model(docs: DataFrame) -> DataFrame:
    """(source, best_model) as the document states it."""
    return docs.select("source", F.try_variant_get("doc", f"$.{BEST}", "string").alias(BEST)).where(F.col(BEST).isNotNull())


def comparison_documents(results: DataFrame, by: str = "mse") -> DataFrame:
    """One JSON text, ``json``, of ``results`` (model, hyperparameters:
    map or JSON text, batch_size, metrics: map of doubles); the best model has
    the least ``by``, of equals the first by name. Bounded by the number of
    models."""
    entry = F.struct(F.col("model").alias("key"), F.to_variant_object(_parameters(results)).alias("value"))
    best = F.min_by("model", F.struct(F.element_at("metrics", by), "model"))
    members = results.agg(F.collect_list(entry).alias("m"), best.alias("b"))
    last = F.array(F.struct(F.lit(BEST).alias("key"), F.col("b").cast("variant").alias("value")))
    return members.select(F.to_json(F.map_from_entries(F.concat("m", last))).alias("json"))


def _parameters(results: DataFrame) -> Column:
    given = F.col("hyperparameters")
    if dict(results.dtypes)["hyperparameters"] == "string":
        given = F.try_parse_json(given)
    return F.struct(given.alias("hyperparameters"), "batch_size", "metrics")


def best_parameter_documents(results: DataFrame) -> DataFrame:
    """A09, the files of the single models: (model, json)."""
    made = F.struct(_parameters(results).getField("hyperparameters").alias("hyperparameters"), F.col("batch_size").alias("best_batch_size"), "metrics")
    return results.select("model", F.to_json(made).alias("json"))


def write_model_documents(results: DataFrame, root: str, by: str = "mse") -> None:
    """``root/model_comparison`` (one document) and ``root/best_params`` (a
    folder per model), as JSON lines."""
    comparison_documents(results, by).coalesce(1).write.mode("overwrite").text(f"{root}/model_comparison")
    best_parameter_documents(results).repartition("model").write.mode("overwrite").partitionBy("model").text(f"{root}/best_params")


def trials(docs: DataFrame) -> DataFrame:
    """One row per trial: source, trial_id, status, score, best_step,
    message, and its hyper-parameters' values as a map of texts."""
    def get(path, kind):
        return F.try_variant_get("doc", path, kind)
    return docs.where(F.col("doc").isNotNull()).select(
        "source", get("$.trial_id", "string").alias("trial_id"), get("$.status", "string").alias("status"), get("$.score", "double").alias("score"),
        get("$.best_step", "bigint").alias("best_step"), get("$.message", "string").alias("message"),
        get("$.hyperparameters.values", "map<string,string>").alias("values"))


def observations(docs: DataFrame) -> DataFrame:
    """One row per trial, metric, observation and value: source,
    trial_id, metric, direction, step, run (place in the list of values),
    value. A trial without metrics (a failed one) has none."""
    body = docs.where(F.col("doc").isNotNull()).select("source", F.try_variant_get("doc", "$.trial_id", "string").alias("trial_id"),
                                                       F.try_variant_get("doc", "$.metrics.metrics", "variant").alias("m"))
    metric = _entries(body.where(F.col("m").isNotNull()), F.col("m"), "metric", "of")
    shape = "array<struct<value: array<double>, step: bigint>>"
    seen = metric.select("source", "trial_id", "metric", F.try_variant_get("of", "$.direction", "string").alias("direction"),
                         F.inline(F.try_variant_get("of", "$.observations", shape)))
    return seen.select("source", "trial_id", "metric", "direction", "step", F.posexplode("value").alias("run", "value"))


def best_steps(seen: DataFrame) -> DataFrame:
    """Per trial and metric the step whose mean value over its runs is best in
    the metric's direction (the earliest of equals): source, trial_id, metric,
    direction, n_steps, best_step, best_value. NULL and NaN values are no
    observations."""
    value = F.when(~F.isnan("value"), F.col("value"))
    by_step = seen.groupBy("source", "trial_id", "metric", "direction", "step").agg(F.avg(value).alias("value")).where(F.col("value").isNotNull())
    sign = F.when(F.lower("direction") == "max", -1.0).otherwise(1.0)
    best = F.min_by(F.struct("step", "value"), F.struct((F.col("value") * sign).alias("v"), "step"))
    found = by_step.groupBy("source", "trial_id", "metric", "direction").agg(F.count(F.lit(1)).alias("n_steps"), best.alias("b"))
    return found.select("source", "trial_id", "metric", "direction", "n_steps", F.col("b.step").alias("best_step"), F.col("b.value").alias("best_value"))
