"""Sources: documents, queries, judgements and vectors as DataFrames with string ids."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DOCUMENT = "doc_id string, title string, text string"
QUERY = "query_id string, text string"
QRELS = "query_id string, doc_id string, rel int"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines under a given schema; a missing file is an empty table."""
    return spark.read.schema(schema).json(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def documents_from(rows: DataFrame, doc_id: str = "id", title: str | None = "title", text: str = "text") -> DataFrame:
    """(doc_id, title, text); nulls in the texts become empty."""
    named = F.coalesce(F.col(title), F.lit("")) if title else F.lit("")
    return rows.select(F.col(doc_id).cast("string").alias("doc_id"), named.alias("title"), F.coalesce(text, F.lit("")).alias("text"))


def queries_from(rows: DataFrame, query_id: str = "id", text: str = "text") -> DataFrame:
    return rows.select(F.col(query_id).cast("string").alias("query_id"), F.coalesce(text, F.lit("")).alias("text"))


def qrels_from(rows: DataFrame, order: Column | None = None) -> DataFrame:
    """(query_id, doc_id, rel); of rows that repeat a pair the last stays: by ``order``, else as the rows are read."""
    at = order if order is not None else F.monotonically_increasing_id()
    last = rows.select("query_id", "doc_id", F.col("rel").cast("int").alias("rel"), at.alias("_at"))
    return last.groupBy("query_id", "doc_id").agg(F.max_by("rel", "_at").alias("rel"))


def seed_documents(rows: DataFrame, name: str, doc_id: str = "id", title: str | None = "title", text: str = "text") -> DataFrame:
    """(doc_id, title, text) with ids ``<name>:<id>``, by which ``is_seed`` knows them."""
    return documents_from(rows, doc_id, title, text).withColumn("doc_id", F.concat(F.lit(f"{name}:"), "doc_id"))


def is_seed(doc_id: Column, name: str) -> Column:
    return doc_id.startswith(f"{name}:")


def queries_and_qrels(spark: SparkSession, folder: str, seed: str | None = None) -> tuple[DataFrame, DataFrame]:
    """queries.jsonl (id, text) and qrels.jsonl (qid, did, rel) of a folder; a missing file is an empty table.
    ``seed``: documents' ids get that prefix, as in ``seed_documents``."""
    q = queries_from(read_jsonl(spark, f"{folder}/queries.jsonl", "id string, text string"))
    rows = read_jsonl(spark, f"{folder}/qrels.jsonl", "qid string, did string, rel int")
    did = F.concat(F.lit(f"{seed}:"), "did") if seed else F.col("did")
    return q, qrels_from(rows.select(F.col("qid").alias("query_id"), did.alias("doc_id"), "rel"))


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, vector as float) of a Parquet table, after ``check_vectors``."""
    rows = spark.read.parquet(path).select(F.col("doc_id").cast("string").alias("doc_id"), F.col("vector").cast("array<float>").alias("vector"))
    check_vectors(rows)
    return rows


class Corpus:
    """A folder's corpus.jsonl, read and kept in memory once."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._docs = spark, folder, None

    def documents(self) -> DataFrame:
        if self._docs is None:
            self._docs = documents_from(read_jsonl(self.spark, f"{self.folder}/corpus.jsonl", "id string, title string, text string")).persist()
        return self._docs

    def seeds(self, name: str) -> DataFrame:
        return self.documents().filter(is_seed(F.col("doc_id"), name))

    def close(self) -> None:
        if self._docs is not None:
            self._docs.unpersist()
            self._docs = None


def relevant_for(qrels: DataFrame, query_id: str) -> DataFrame:
    return qrels.filter(F.col("query_id") == query_id).select("doc_id", "rel")


def all_query_ids(qrels: DataFrame) -> DataFrame:
    return qrels.select("query_id").distinct()


def distractor_pool(sources: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """All sources' documents with ids ``distractor:<source>:<id>``, and (source, n)."""
    frames = [
        df.select(F.concat(F.lit(f"distractor:{name}:"), "doc_id").alias("doc_id"), "title", "text", F.lit(name).alias("source"))
        for name, df in sources.items()
    ]
    pool = reduce(DataFrame.unionByName, frames)
    return pool.drop("source"), pool.groupBy("source").agg(F.count("*").alias("n"))


def seeded_order(doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), doc_id))


def seeded_sample(docs: DataFrame, n: int, seed: int) -> DataFrame:
    """n rows in the order of a seeded hash: the same rows whatever the partitions."""
    return docs.orderBy(seeded_order(F.col("doc_id"), seed), "doc_id").limit(n)


def vectors_for(vectors: DataFrame, docs: DataFrame, check: bool = True) -> DataFrame:
    """(doc_id, vector) of the documents, by id; a document without a vector is an error that names three."""
    if check:
        missing = [r["doc_id"] for r in missing_vectors(vectors, docs).limit(3).collect()]
        if missing:
            raise KeyError(f"documents without a vector, such as {missing}")
    return docs.select("doc_id").join(vectors, "doc_id")


def missing_vectors(vectors: DataFrame, docs: DataFrame) -> DataFrame:
    return docs.select("doc_id").join(vectors.select("doc_id"), "doc_id", "left_anti")


def check_vectors(vectors: DataFrame) -> int:
    """The number of components; repeated ids and unequal lengths are errors."""
    row = vectors.agg(F.count("*").alias("n"), F.min(F.size("vector")).alias("a"), F.max(F.size("vector")).alias("b")).first()
    if row["n"] and row["a"] != row["b"]:
        raise ValueError("vectors have different lengths")
    if not vectors.groupBy("doc_id").count().filter("count > 1").isEmpty():
        raise ValueError("ids repeat")
    return row["a"] or 0


# ---- the shared tables ----


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_from(load(spark, sf_dir, "documents"), "doc_id", None)


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries_from(load(spark, sf_dir, "benchmark"), "item_id")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("doc_id"), F.col("embedding").alias("vector"))
