"""The queries opN_<name>: each applies one operator to its whole table, and derives the columns that are asked for."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekspark.llm import fingerprints, line_runs, mixing, multiprobe, packing, pii, secrets, sharding, simhash_golay, toxicity

#: The shards of op7, of which the last four are twice as large.
SHARDS = [f"shard-{i:03d}" for i in range(64)]
SHARD_WEIGHTS = [1] * 60 + [2] * 4


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return multiprobe.nearest(vectors, vectors.filter("vec_id % 20 = 0"), k=20)


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, size=1024)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_likeness(read(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(read(spark, sf_dir, "documents"))


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_runs.dedup_lines(docs, min_chars=40, min_docs=5)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(read(spark, sf_dir, "documents"))


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return sharding.place(docs, ["doc_id"], SHARDS, SHARD_WEIGHTS)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.toxicity(docs, read(spark, sf_dir, "labels")).drop("text")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_golay.near_duplicates(read(spark, sf_dir, "documents"), bits=4, shingle=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_nearest, op2_pack, op3_fingerprints, op4_pii, op5_lines, op6_secrets, op7_shards, op8_toxicity, op9_simhash, op10_mix,
    )
}

ORACLES: dict[str, str] = {
    "op5_lines": """
        WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        cut AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos, len(lines) AS n FROM docs),
        keyed AS (
            SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM cut),
        common AS (
            SELECT k, max(doc_id) AS last_doc FROM keyed WHERE length(k) >= 40
            GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
        marked AS (SELECT keyed.*, common.k IS NOT NULL AND doc_id < last_doc AS gone FROM keyed LEFT JOIN common USING (k))
        SELECT doc_id, CAST(n AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id, n
    """,
}
