"""BM25 over a postings table."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seekspark.functions import text as T
from seekspark.operators.fusion import top_k


def bag_of_words(docs: DataFrame, stopwords: list[str] | None = T.STOPWORDS) -> DataFrame:
    """(doc_id, term, tf)."""
    rows = docs.select("doc_id", F.explode(T.tokens(T.body(F.col("title"), F.col("text")), stopwords)).alias("term"))
    return rows.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def doc_lengths(docs: DataFrame, stopwords: list[str] | None = T.STOPWORDS) -> DataFrame:
    """(doc_id, dl), documents without tokens included."""
    return docs.select("doc_id", F.size(T.tokens(T.body(F.col("title"), F.col("text")), stopwords)).cast("long").alias("dl"))


def term_stats(bag: DataFrame) -> DataFrame:
    return bag.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def _weight(method: str, n: int, k1: float, b: float, avgdl: float) -> Column:
    tf, df, dl = F.col("tf"), F.col("df"), F.col("dl")
    length = 1 - b + b * dl / avgdl
    if method == "lucene":
        return F.log(1 + (n - df + 0.5) / (df + 0.5)) * (tf / (tf + k1 * length))
    if method == "atire":
        return F.log(n / df) * (tf * (k1 + 1) / (tf + k1 * length))
    if method == "bm25l":
        c = tf / length
        return F.log((n + 1) / (df + 0.5)) * ((k1 + 1) * (c + 0.5) / (k1 + c + 0.5))
    raise ValueError(f"unknown method {method!r}; there are lucene, atire and bm25l")


#: Asked terms that are broadcast at most; with more, terms and postings are shuffled.
BROADCAST_TERMS = 500_000


def postings_of(docs: DataFrame, stopwords: list[str] | None = T.STOPWORDS) -> DataFrame:
    """(doc_id, dl, term, tf), for a document without tokens one row whose term is null; each text is cut up once.

    Documents are dealt out by doc_id first, so that all that follows is local to a document.
    """
    tokens = T.tokens(T.body(F.col("title"), F.col("text")), stopwords)
    rows = docs.repartition("doc_id").select("doc_id", tokens.alias("t"))
    each = rows.select("doc_id", F.size("t").cast("long").alias("dl"), F.explode_outer("t").alias("term"))
    return each.groupBy("doc_id", "dl", "term").agg(F.count("term").alias("tf"))


@dataclass
class Bm25:
    """A BM25 index: postings (doc_id, dl, term, tf), dealt by document, and (term, df) of the terms.

    A search keeps the postings of the terms that are asked for and weighs those only. A document's postings are in
    one partition (a bucket, once saved), so its score is summed there, and only the best k of each travel.
    Documents that share no term with a query are not in its result. Terms beyond the corpus are ignored.
    """

    postings: DataFrame
    dfs: DataFrame
    stopwords: list[str] | None
    n: int
    avgdl: float
    k1: float = 0.9
    b: float = 0.4
    method: str = "lucene"

    @classmethod
    def fit(
        cls, docs: DataFrame, k1: float = 0.9, b: float = 0.4, method: str = "lucene", stopwords: list[str] | None = T.STOPWORDS, check: bool = True, path: str | None = None
    ) -> Bm25:
        """Index ``docs`` (doc_id, title, text), in memory or, with ``path``, in tables there."""
        _weight(method, 1, k1, b, 1.0)
        if check and docs.isEmpty():
            raise RuntimeError("no documents to index")
        if check and not docs.groupBy("doc_id").count().filter("count > 1").isEmpty():
            raise ValueError("document ids repeat")
        postings = postings_of(docs, stopwords).persist()
        # Documents are counted in their postings: each has a term that comes first, or none.
        one = Window.partitionBy("doc_id").orderBy("term")
        heads = postings.withColumn("_r", F.row_number().over(one)).filter("_r = 1")
        row = heads.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
        dfs = postings.filter("term is not null").groupBy("term").agg(F.count("*").alias("df"))
        out = cls(postings.filter("term is not null"), dfs, stopwords, row["n"], row["avgdl"] or 0.0, k1, b, method)
        if path is None:
            return out
        out.save(path)
        postings.unpersist()
        return cls.load(docs.sparkSession, path)

    def weighing(self, method: str, k1: float | None = None, b: float | None = None) -> Bm25:
        """The same postings under other weights."""
        _weight(method, 1, 1.0, 1.0, 1.0)
        return replace(self, method=method, k1=self.k1 if k1 is None else k1, b=self.b if b is None else b)

    def set_search_params(self, **params: object) -> None:
        """There are none."""

    @property
    def slug(self) -> str:
        return f"bm25-{self.method}"

    def size_bytes(self) -> int:
        """Eight bytes a term, those of its document frequency."""
        return 8 * self.dfs.count()

    def search(self, queries: DataFrame, k: int, digits: int | None = 6) -> DataFrame:
        """(query_id, doc_id, score, rank): repeated query tokens count as often; ties go to the smaller doc_id.

        Scores are rounded before they are ranked, because sums of many doubles depend on their order.
        """
        if k < 0:
            raise ValueError("k must not be negative")
        asked = queries.select("query_id", F.explode(T.tokens(F.col("text"), self.stopwords)).alias("term"))
        asked = asked.groupBy("query_id", "term").agg(F.count("*").alias("qtf")).join(self.dfs, "term").persist()
        known = F.broadcast(asked) if asked.count() <= BROADCAST_TERMS else asked
        weight = _weight(self.method, self.n, self.k1, self.b, self.avgdl or 1.0)
        score = F.sum(weight * F.col("qtf"))
        score = F.round(score, digits) if digits is not None else score
        return top_k(self.postings.join(known, "term").groupBy("query_id", "doc_id").agg(score.alias("score")), k)

    def save(self, path: str, buckets: int | None = None) -> None:
        """Postings in buckets by doc_id, terms and settings, each a table under ``path``."""
        spark = self.postings.sparkSession
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        name = _table_of(path)
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        rows = self.postings.select("doc_id", "dl", "term", "tf").repartition(buckets, "doc_id")
        rows.write.mode("overwrite").option("path", f"{path}/postings").format("parquet").bucketBy(buckets, "doc_id").saveAsTable(name)
        self.dfs.write.mode("overwrite").parquet(f"{path}/terms")
        kept = (self.n, self.avgdl, self.stopwords, self.k1, self.b, self.method, buckets)
        settings = spark.createDataFrame([kept], "n long, avgdl double, stopwords array<string>, k1 double, b double, method string, buckets int")
        settings.coalesce(1).write.mode("overwrite").parquet(f"{path}/settings")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Bm25:
        row = spark.read.parquet(f"{path}/settings").first()
        name = _table_of(path)
        if not spark.catalog.tableExists(name):
            spark.sql(
                f"CREATE TABLE {name} (doc_id STRING, dl BIGINT, term STRING, tf BIGINT) USING parquet "
                f"CLUSTERED BY (doc_id) INTO {row['buckets']} BUCKETS LOCATION '{path}/postings'"
            )
        return cls(spark.table(name), spark.read.parquet(f"{path}/terms"), row["stopwords"], row["n"], row["avgdl"], row["k1"], row["b"], row["method"])


def _table_of(path: str) -> str:
    """The catalog's name of the postings under ``path``; Spark knows buckets by the catalog only."""
    return f"bm25_{hashlib.sha256(path.encode()).hexdigest()[:16]}"
