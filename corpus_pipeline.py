"""A corpus pipeline of five stages, each calling one operator of seekspark.llm on all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekspark.llm import line_runs, mixing, near_dedup, packing, toxicity
from seekspark.llm.common import free_names, settled


def aside(docs: DataFrame, added: tuple[str, ...], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``stage`` of ``docs``, with the same columns: those named like what an operator adds wait under other names."""
    clashing = [c for c in docs.columns if c.lower() in added]
    other = dict(zip(clashing, free_names(docs, *clashing)))
    out = stage(docs.withColumnsRenamed(other))
    return out.select(*[F.col(f"`{other.get(c, c)}`").alias(c) for c in docs.columns])


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity chain rejects go. It learns from the labelled documents that there are."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    added = ("p_low_quality", "p_toxic", "toxic")
    return aside(docs, added, lambda d: toxicity.toxicity(d, labels).filter("toxic = 0"))


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents hold stay in the last one only."""

    def kept(d: DataFrame) -> DataFrame:
        cut = line_runs.dedup_lines(d, min_chars=40, min_docs=5).drop("text").withColumnRenamed("kept_text", "text")
        return cut.withColumn("n_chars", F.length("text").cast("long"))

    return aside(docs, ("kept_text", "n_lines", "n_dropped"), kept)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 0.8 or more of its five-word shingles stays, that of the smallest doc_id.

    SimHash links by Golay keys come first; what 64 bits cannot reach, keys of minima find; all is verified.
    """
    return near_dedup.drop_similar(docs, least=0.8, shingle=5)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of 1024 ids."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack_documents(docs.select("doc_id", "source", "text"), path, end_id=2, size=1024)


STAGES = [
    ("toxicity", clean),
    ("line_dedup", fresh_lines),
    ("near_dedup", one_of_each),
    ("mix", mixed),
    ("pack", packed),
]

#: Models, tokens and components are beyond SQL; tests hold run() against a plain version.
ORACLE_SQL = None


#: Rows that go to a Python worker at a time.
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "1000"


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = spark.conf.get(ARROW_ROWS[0], None)
    spark.conf.set(*ARROW_ROWS)
    try:
        for _, stage in STAGES:
            # A stage's output is a table; what it made on the way goes.
            docs = settled(spark, partial(stage, spark, docs, sf_dir))
    finally:
        if before is None:
            spark.conf.unset(ARROW_ROWS[0])
        else:
            spark.conf.set(ARROW_ROWS[0], before)
    return docs
