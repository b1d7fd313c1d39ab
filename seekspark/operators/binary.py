"""Binary-quantised lists: one bit a component, Hamming distances, exact rescoring."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekspark.functions.vectors import code_words, dot, hamming
from seekspark.operators.fusion import top_k
from seekspark.operators.ivf import DIGITS, assign, default_nlist, probes, train_coarse, write_lists


def thresholds(vectors: DataFrame, chunk: int, dim: int) -> list[float]:
    """The mean over all vectors of each chunk of components."""
    means = [F.avg(sum((F.col("vector")[i].cast("double") for i in range(at + 1, at + chunk)), F.col("vector")[at].cast("double")) / chunk) for at in range(0, dim, chunk)]
    row = vectors.agg(*[F.round(m, DIGITS).alias(f"t{i}") for i, m in enumerate(means)]).first()
    return [float(x or 0.0) for x in row]


@dataclass
class BinaryLists:
    """Lists of (doc_id, vector, list_id, code) with the thresholds of codes, for documents and queries alike."""

    rows: DataFrame
    centroids: DataFrame
    cuts: list[float]
    dim: int

    @classmethod
    def fit(cls, vectors: DataFrame, dim: int, m: int, nlist: int | None = None, centroids: DataFrame | None = None, nbits: int = 1) -> BinaryLists:
        if nbits != 1:
            raise ValueError("codes have one bit a component")
        if dim % m:
            raise ValueError("the number of components must be a multiple of m")
        if centroids is None:
            centroids = train_coarse(vectors, nlist or default_nlist(vectors.count()))
        cuts = thresholds(vectors, dim // m, dim)
        out = cls(vectors, centroids, cuts, dim)
        out.rows = assign(vectors.select("doc_id", "vector"), centroids).withColumn("code", out.code("vector"))
        return out

    def code(self, vector: str):
        return code_words(F.col(vector), F.array(*[F.lit(c) for c in self.cuts]), self.dim // len(self.cuts), self.dim)

    def search(self, queries: DataFrame, k: int, nprobe: int, k_factor: int = 4, rescore: bool = True) -> DataFrame:
        """The k best of each query's nearest lists: by codes (score: minus the differing bits), then by inner product."""
        if k <= 0:
            raise ValueError("k must be above 0")
        asked = probes(queries, self.centroids, nprobe).withColumn("_c", self.code("vector")).select("query_id", "list_id", "probe", "_c")
        bits = hamming(F.col("code"), F.col("_c"), -(-self.dim // 32))
        pairs = self.rows.select("doc_id", "list_id", "code").join(asked, "list_id").select("query_id", "doc_id", "probe", bits.alias("bits"))
        order = [F.asc("bits"), F.asc("probe"), F.asc("doc_id")]
        if not rescore:
            return top_k(pairs, k, ["query_id"], order).select("query_id", "doc_id", (-F.col("bits")).cast("double").alias("score"), "rank")
        best = top_k(pairs, k * k_factor, ["query_id"], order).select("query_id", "doc_id")
        exact = best.join(self.rows.select("doc_id", "vector"), "doc_id").join(queries.select("query_id", F.col("vector").alias("_q")), "query_id")
        return top_k(exact.select("query_id", "doc_id", dot(F.col("vector"), F.col("_q")).alias("score")), k)

    def save(self, path: str) -> None:
        """Lists partitioned by list_id, so a search reads only what it probes."""
        spark = self.rows.sparkSession
        write_lists(self.rows, f"{path}/lists")
        self.centroids.coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
        spark.createDataFrame([(self.cuts, self.dim)], "cuts array<double>, dim int").coalesce(1).write.mode("overwrite").parquet(f"{path}/settings")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BinaryLists:
        row = spark.read.parquet(f"{path}/settings").first()
        return cls(spark.read.parquet(f"{path}/lists"), spark.read.parquet(f"{path}/centroids"), list(row["cuts"]), row["dim"])
