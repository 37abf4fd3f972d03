"""Published pipelines: documents named by the hash of their content, in a table that only grows.

A version never changes: publishing other content under a name adds a version, and whoever pinned an earlier one keeps it.
Versions are numbered when they are read, by time and hash, so that two writers cannot take one number.
"""

from __future__ import annotations

import copy
import hashlib
import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "name string, digest string, document string, published_at timestamp"


def digest(spec: dict) -> str:
    """SHA-256 of a document, whatever the order of its keys."""
    return hashlib.sha256(json.dumps(spec, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def _reference(params: dict) -> tuple[str, str | int | None]:
    """(name, version) that a subpipeline node asks for: ``version`` beside ``pipeline_id``, or name@version."""
    name, _, version = str(params["pipeline_id"]).partition("@")
    return name, params.get("version", version or None)


class Published:
    """The published pipelines of a folder; ``build(..., pipelines=Published(spark, folder))`` looks subpipelines up here."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def _rows(self) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMA).parquet(self.folder)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], SCHEMA)
            raise

    def versions(self, name: str | None = None) -> DataFrame:
        """(name, version, digest, published_at), versions from 1 by time of first publication."""
        rows = self._rows() if name is None else self._rows().where(F.col("name") == name)
        first = rows.groupBy("name", "digest").agg(F.min("published_at").alias("published_at"))
        return first.select("name", F.row_number().over(Window.partitionBy("name").orderBy("published_at", "digest")).alias("version"), "digest", "published_at")

    def publish(self, name: str, spec: dict, now: datetime | None = None) -> str:
        """Adds a version unless the name has this content already; returns its digest. Subpipelines are pinned first, so a version holds all that it runs."""
        if "@" in name:
            raise ValueError("a pipeline's name holds no @")
        spec = self.pin(spec)
        key = digest(spec)
        if not self._rows().where((F.col("name") == name) & (F.col("digest") == key)).limit(1).count():
            row = [(name, key, json.dumps(spec, sort_keys=True), now or datetime.now(UTC))]
            self.spark.createDataFrame(row, SCHEMA).coalesce(1).write.mode("append").parquet(self.folder)
        return key

    def resolve(self, name: str, version: str | int | None = None) -> str:
        """The digest of a version: the latest without one, else by number, or by digest or at least 8 leading digits of it."""
        found = {r.version: r.digest for r in self.versions(name).collect()}
        if version is None:
            hits = [found[max(found)]] if found else []
        elif str(version).isdigit() and len(str(version)) < 8:
            hits = [found[int(version)]] if int(version) in found else []
        else:
            hits = [d for d in found.values() if len(str(version)) >= 8 and d.startswith(str(version))]
        if len(hits) != 1:
            raise ValueError(f"pipeline {name} has no one version {version or 'at all'}")
        return hits[0]

    def get(self, name: str, version: str | int | None = None) -> dict:
        """The document of a version; content that does not have its hash is an error."""
        key = self.resolve(name, version)
        spec = json.loads(self._rows().where((F.col("name") == name) & (F.col("digest") == key)).first().document)
        if digest(spec) != key:
            raise ValueError(f"pipeline {name} at {key} was changed")
        return spec

    def pin(self, spec: dict) -> dict:
        """The document with every subpipeline's version written out as a digest; runs of it stay the same when others are published."""
        spec = copy.deepcopy(spec)
        for n in spec.get("nodes", []):
            if n["op"] == "subpipeline":
                name, version = _reference(n["params"])
                n["params"] |= {"pipeline_id": name, "version": self.resolve(name, version)}
        return spec


def lookup(pipelines: dict | Published | None, params: dict) -> tuple[str, dict]:
    """(name, document) for a subpipeline node; plain dictionaries have no versions."""
    name, version = _reference(params)
    if isinstance(pipelines, Published):
        return name, pipelines.get(name, version)
    if version is not None:
        raise ValueError(f"pipeline {name} asks for version {version}, but these pipelines have none")
    return name, (pipelines or {})[name]


def expose(spec: dict, values: dict) -> tuple[dict, dict]:
    """(document with exposed parameters set, values left over). A node exposes parameters by ui.exposedParams: {parameter: {alias}}."""
    spec, rest = copy.deepcopy(spec), dict(values)
    for n in spec.get("nodes", []):
        for key, meta in ((n.get("ui") or {}).get("exposedParams") or {}).items():
            alias = (meta or {}).get("alias") or key
            if alias in values:
                n.setdefault("params", {})[key] = values[alias]
                rest.pop(alias, None)
    return spec, rest
