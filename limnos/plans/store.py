"""Fitted models on shared storage.

``root/name/<version>-<id>/`` holds ``model`` (Spark ML's own layout),
``manifest`` (one line of JSON: feature order, scaler, parameters and whatever
else a caller needs to use the model rightly) and, written last, ``committed``.
A folder without it is a version that was never finished: no reader sees it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession


class ModelStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _line(self, text: str, path: str) -> None:
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)

    def _lines(self, path: str) -> list[str]:
        try:
            return [r[0] for r in self.spark.read.text(path).collect()]  # a short line a version
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []

    def versions(self, name: str) -> list[tuple[int, str, dict]]:
        """(version, folder, manifest) of all whole versions, oldest first."""
        found = [json.loads(x) for x in self._lines(f"{self.root}/{name}/*/committed")]
        return sorted(((d["version"], f"{self.root}/{name}/{d['folder']}", d["manifest"]) for d in found), key=lambda v: v[:2])

    def save(self, name: str, model: PipelineModel, manifest: dict) -> int:
        """Stores a new version and returns its number."""
        version = max((v for v, _, _ in self.versions(name)), default=0) + 1
        folder = f"{version:06d}-{uuid.uuid4().hex[:8]}"
        path = f"{self.root}/{name}/{folder}"
        model.write().save(f"{path}/model")
        self._line(json.dumps(manifest, sort_keys=True), f"{path}/manifest")
        self._line(json.dumps({"version": version, "folder": folder, "manifest": manifest}, sort_keys=True), f"{path}/committed")
        return version

    def find(self, name: str, manifest: dict | None = None) -> tuple[int, PipelineModel, dict] | None:
        """The latest whole version, of those with this manifest if one is
        given: a model is of use only with the features, scaler and parameters
        it was fitted with."""
        wanted = None if manifest is None else json.loads(json.dumps(manifest))
        for version, path, found in reversed(self.versions(name)):
            if wanted is None or found == wanted:
                return version, PipelineModel.load(f"{path}/model"), found
        return None

    def get(self, name: str, manifest: dict, build: Callable[[], PipelineModel], mode: str = "reuse") -> PipelineModel:
        """``reuse``: a stored model with this manifest, else one that
        ``build`` makes and that is stored; ``replace``: always the latter."""
        if mode not in ("reuse", "replace"):
            raise ValueError(f"unknown mode {mode}")
        found = self.find(name, manifest) if mode == "reuse" else None
        if found:
            return found[1]
        model = build()
        self.save(name, model, manifest)
        return model
