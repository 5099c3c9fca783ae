"""A vector index that is kept between runs: unit vectors in a versioned table, with what they were made by.

Rows are (workspace_id, path, chunk_id, vector_id, hash, v). An update replaces the chunks of changed files and drops those of
deleted ones; files whose hash is indexed already are skipped. ``health`` tells whether an index still fits what asks for
it, so that a search never mixes vectors of two models.

Defined results: rows without a chunk id or with a vector that is null, zero or of another length are not indexed. Of a
repeated chunk id the greatest vector id holds. An index that was never written is missing; searching it gives no rows.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.operators import ingest, vector
from codeloom.sources.store import Store

KEYS = ["workspace_id", "path"]
COLUMNS = [*KEYS, "chunk_id", "vector_id", "hash", "v"]


class VectorIndex:
    def __init__(self, spark: SparkSession, root: str, model: str, dimension: int, chunker: str = "1"):
        self.spark, self.store = spark, Store(spark, root)
        self.made_by = {"model": model, "dimension": dimension, "chunker": chunker}

    def metadata(self) -> dict | None:
        m = self.store.read("metadata")
        return None if m is None else json.loads(m.first()["value"])

    def health(self, revision: int | None = None) -> str:
        """'missing', 'invalid' (another model, dimension or chunker), 'stale' (an older revision) or 'valid'."""
        m = self.metadata()
        if m is None:
            return "missing"
        if any(m.get(k) != v for k, v in self.made_by.items()):
            return "invalid"
        return "stale" if revision is not None and m["revision"] < revision else "valid"

    def rows(self) -> DataFrame:
        """What is indexed; nothing if the index is missing or made by something else."""
        if self.health() in ("missing", "invalid"):
            return self.spark.createDataFrame([], "workspace_id string, path string, chunk_id string, vector_id long, hash string, v array<double>")
        return self.store.read("vectors")

    def pending(self, files: DataFrame) -> DataFrame:
        """The files (workspace_id, path, hash) whose content is not indexed yet."""
        return ingest.unchanged_skipped(files, self.rows().select(*KEYS, "hash").distinct())

    def update(self, chunks: DataFrame, removed: DataFrame, revision: int) -> None:
        """Index the chunks (workspace_id, path, chunk_id, vector_id, hash, embedding) of changed files in place of what these
        files had, drop the removed files (workspace_id, path), and take the revision if it is the greatest."""
        fits = chunks.where(F.col("chunk_id").isNotNull() & (F.size("embedding") == self.made_by["dimension"]))
        new = fits.withColumn("v", T.unit_vector("embedding")).where("v is not null")
        new = new.groupBy(*KEYS, "chunk_id").agg(F.max_by(F.struct("vector_id", "hash", "v"), "vector_id").alias("r")).select(*KEYS, "chunk_id", "r.*")
        gone = chunks.select(*KEYS).unionByName(removed.select(*KEYS)).distinct()
        kept = self.rows().select(*COLUMNS).join(gone, KEYS, "left_anti")
        m = self.metadata()
        at = max(revision, m["revision"]) if m and self.health() != "invalid" else revision
        self.store.write("vectors", kept.unionByName(new.select(*COLUMNS)), ["workspace_id"])
        told = json.dumps(self.made_by | {"revision": at})
        self.store.write("metadata", self.spark.createDataFrame([(told,)], "value string"))

    def search(self, query: list[float], k: int, workspace: str | None = None) -> DataFrame:
        """The k most similar chunks, of one workspace if it is named (only its folder is read)."""
        rows = self.rows()
        if workspace is not None:
            rows = rows.where(F.col("workspace_id") == workspace)
        return vector.topk(rows, "vector_id", "v", query, k).select(*KEYS, "chunk_id", "vector_id", "score")
