"""Stores: the embedding cache, manifests, CSV reports and token tables."""

from __future__ import annotations

import hashlib
import json
import re
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seekspark.sources.tables import check_vectors


def encoder_revision(config: dict) -> str:
    """Twelve hex digits of the settings, prompts included, so a new prompt is a new revision."""
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:12]


def slug_of(name: str) -> str:
    return re.sub("[^A-Za-z0-9._-]", "_", name)


class EmbeddingCache:
    """Vectors in Parquet, partitioned by encoder and revision."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def get(self, encoder: str, revision: str) -> DataFrame | None:
        """(doc_id, vector), or None where there are none or they cannot be read."""
        try:
            table = self.spark.read.parquet(self.path)
            own = table.filter((F.col("encoder") == slug_of(encoder)) & (F.col("revision") == revision)).select("doc_id", "vector")
            # Reads every vector, so that a damaged file shows here.
            row = own.agg(F.count("*").alias("n"), F.sum(F.xxhash64("doc_id", "vector").cast("decimal(38,0)"))).first()
            return own if row["n"] else None
        except (AnalysisException, Py4JJavaError, PySparkException):
            return None

    def put(self, encoder: str, revision: str, vectors: DataFrame) -> None:
        """Replace what the encoder and revision have. Repeated ids and unequal lengths are errors."""
        check_vectors(vectors)
        rows = vectors.select("doc_id", "vector", F.lit(slug_of(encoder)).alias("encoder"), F.lit(revision).alias("revision"))
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("encoder", "revision").parquet(self.path)

    def missing(self, encoder: str, revision: str, docs: DataFrame) -> DataFrame:
        own = self.get(encoder, revision)
        return docs if own is None else docs.join(own.select("doc_id"), "doc_id", "left_anti")


def corpus_digest(docs: DataFrame) -> DataFrame:
    """One row: documents, and an order-free digest of ids and texts (sums of hash parts, as hex)."""
    h = F.sha2(F.concat_ws("\x01", "doc_id", "title", "text"), 256)
    part = lambda i: F.sum(F.conv(F.substring(h, i, 12), 16, 10).cast("decimal(38,0)"))
    return docs.agg(F.count("*").alias("n"), F.concat_ws("-", part(1), part(13)).alias("digest"))


def save_manifest(spark: SparkSession, path: str, scales: dict[int, int], encoders: dict[str, str], digest: str, n_queries: int, n_qrels: int) -> None:
    entry = {"format_version": 2, "scales": {str(k): v for k, v in scales.items()}, "encoders": encoders, "corpus": digest, "n_queries": n_queries, "n_qrels": n_qrels}
    spark.createDataFrame([(json.dumps(entry, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_manifest(spark: SparkSession, path: str) -> dict:
    entry = json.loads(spark.read.text(path).first()["value"])
    unknown = set(entry) - {"format_version", "scales", "encoders", "corpus", "n_queries", "n_qrels"}
    if unknown:
        raise ValueError(f"unknown fields: {sorted(unknown)}")
    return entry


def write_csv(results: list[DataFrame], path: str) -> bool:
    """All rows under the union of their columns, by name; nothing to write: no file and False."""
    results = [r for r in results if r.columns]
    if not results or all(r.isEmpty() for r in results):
        return False
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), results)
    every.select(*sorted(every.columns)).coalesce(1).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)
    return True


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def token_table(docs: DataFrame, ids: str = "tokens") -> DataFrame:
    """(doc_id, tokens, first, n): each document's place in the stream of all tokens, chunk by chunk of its hash."""
    rows = docs.withColumn("n", F.size(ids).cast("long")).withColumn("chunk", F.substring(F.md5("doc_id"), 1, 3))
    totals = rows.groupBy("chunk").agg(F.sum("n").alias("t"))  # at most 4096 rows
    w = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("chunk", F.coalesce(F.sum("t").over(w), F.lit(0)).alias("start"))
    inner = Window.partitionBy("chunk").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    within = F.coalesce(F.sum("n").over(inner), F.lit(0))
    return rows.withColumn("w", within).join(starts, "chunk").select("doc_id", ids, (F.col("start") + F.col("w")).alias("first"), "n")
