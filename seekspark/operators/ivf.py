"""Inverted lists: coarse centroids, assignment and list-pruned search; product-quantised codes with exact refining."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekspark.functions.vectors import dot, squared_l2
from seekspark.operators.fusion import top_k
from seekspark.operators.vector import in_order, matrix

#: Digits that centroids keep, so that they do not depend on the order of sums.
DIGITS = 9


def default_nlist(n: int) -> int:
    """The next power of two from 4 sqrt(n)."""
    return 1 << max(0, (max(1, int(4 * math.sqrt(n))) - 1).bit_length())


def train_size(n: int, nlist: int, strategy: str = "sqrt", fixed: int = 10_000) -> int:
    if strategy not in ("sqrt", "nlist", "fixed"):
        raise ValueError(f"unknown strategy {strategy!r}")
    return min(n, {"sqrt": int(math.sqrt(n)), "nlist": max(50 * nlist, fixed), "fixed": fixed}[strategy])


def first_centroids(vectors: DataFrame, nlist: int) -> DataFrame:
    """(list_id, centroid): the vectors of the smallest ids; as many as there are, if fewer."""
    from pyspark.sql.window import Window

    few = vectors.orderBy("doc_id").limit(nlist)
    place = F.row_number().over(Window.orderBy("doc_id")) - 1  # over nlist rows
    return few.select(place.cast("int").alias("list_id"), F.col("vector").cast("array<double>").alias("centroid"))


def assign(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """Add ``list_id``, the nearest centroid by L2, the smallest list_id of equals.

    Distances come from matrix products; those that are as near as rounding goes are worked out in order. Centroids,
    nlist rows, go with the task.
    """
    table = sorted((r["list_id"], r["centroid"]) for r in centroids.collect())
    ids, c = np.array([i for i, _ in table], np.int32), np.array([v for _, v in table], float)
    own = vectors.drop("list_id")
    at = own.columns.index("vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                b = whole.slice(start, 1024)
                x = matrix(b.column(at))
                d = (c * c).sum(axis=1)[None, :] - 2 * (x @ c.T)
                low = d.min(axis=1)
                near = d <= (low + 1e-9 * np.maximum(1.0, np.abs(low)))[:, None]
                place = d.argmin(axis=1)
                for i in np.flatnonzero(near.sum(axis=1) > 1):
                    j = np.flatnonzero(near[i])
                    place[i] = j[in_order(np.repeat(x[i : i + 1], len(j), axis=0), c[j], "l2").argmax()]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids[place])], [*b.schema.names, "list_id"])

    return own.mapInArrow(run, own.select("*", F.lit(0).alias("list_id")).schema)


def write_lists(rows: DataFrame, path: str, rows_a_file: int = 1 << 20) -> None:
    """Lists in folders by list_id, so a search reads only what it probes. A large list is written by several tasks,
    in files of at most ``rows_a_file``."""
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, -(-rows.count() // rows_a_file))))
    rows.repartition("list_id", salt).write.mode("overwrite").option("maxRecordsPerFile", rows_a_file).partitionBy("list_id").parquet(path)


def lloyd(vectors: DataFrame, centroids: DataFrame, rounds: int, dim: int) -> DataFrame:
    """Centroids after so many rounds; a list without vectors keeps its centroid."""
    for _ in range(rounds):
        means = F.array(*[F.round(F.avg(F.col("vector")[i].cast("double")), DIGITS) for i in range(dim)])
        new = assign(vectors, centroids).groupBy("list_id").agg(means.alias("mean"))
        merged = centroids.join(new, "list_id", "left").select("list_id", F.coalesce("mean", "centroid").alias("centroid"))
        # nlist rows: kept on the driver, so rounds do not pile up in the plan.
        centroids = vectors.sparkSession.createDataFrame(merged.orderBy("list_id").collect(), "list_id int, centroid array<double>")
    return centroids


def train_coarse(vectors: DataFrame, nlist: int, seed: int = 42, rounds: int = 25, sample: int = 100_000) -> DataFrame:
    """Centroids by k-means over at most ``sample`` vectors, taken in a seeded order; nlist is clamped to their number."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    few = vectors.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "doc_id"))).limit(sample)
    n = few.count()
    rows = few.select(array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
    model = KMeans(k=max(2, min(nlist, n)), seed=seed, maxIter=rounds, tol=1e-4).fit(rows)
    return vectors.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(model.clusterCenters())], "list_id int, centroid array<double>")


def probes(queries: DataFrame, centroids: DataFrame, nprobe: int) -> DataFrame:
    """(query_id, vector, list_id, probe): each query's nearest centroids, from probe 1."""
    pairs = queries.join(F.broadcast(centroids)).select("query_id", "vector", "list_id", squared_l2(F.col("vector"), F.col("centroid")).alias("d"))
    ranked = top_k(pairs, nprobe, ["query_id"], [F.asc("d"), F.asc("list_id")])
    return ranked.select("query_id", "vector", "list_id", F.col("rank").alias("probe"))


def ivf_search(lists: DataFrame, centroids: DataFrame, queries: DataFrame, k: int, nprobe: int) -> DataFrame:
    """The k largest inner products in each query's nearest lists; ``lists`` has (doc_id, vector, list_id).

    Over Parquet that is partitioned by list_id, lists that no query probes are not read.
    """
    if k <= 0:
        raise ValueError("k must be above 0")
    asked = probes(queries, centroids, nprobe).select("query_id", "list_id", F.col("vector").alias("_q"))
    pairs = lists.join(asked, "list_id").select("query_id", "doc_id", dot(F.col("vector"), F.col("_q")).alias("score"))
    return top_k(pairs, k)


def nprobe_sweep(lists: DataFrame, centroids: DataFrame, queries: DataFrame, k: int, nprobes: list[int]) -> DataFrame:
    """Results of all nprobe at once: (nprobe, query_id, doc_id, score, rank); each pair is scored once."""
    asked = probes(queries, centroids, max(nprobes)).select("query_id", "list_id", "probe", F.col("vector").alias("_q"))
    pairs = lists.join(asked, "list_id").select("query_id", "doc_id", "probe", dot(F.col("vector"), F.col("_q")).alias("score"))
    grid = F.explode(F.array(*[F.lit(n) for n in nprobes]))
    return top_k(pairs.withColumn("nprobe", grid).filter("probe <= nprobe").drop("probe"), k, ["nprobe", "query_id"])


def parts_of(dim: int, m: int) -> int:
    """The largest number of equal parts of a vector, ``m`` at most."""
    return next(p for p in range(min(m, dim), 0, -1) if dim % p == 0)


def code_parts(dim: int) -> int:
    return next((m for m in (48, 32) if dim % m == 0), dim)


def factory_label(nlist: int, m: int, bits: int) -> str:
    return f"OPQ{m},IVF{nlist},PQ{m}x{bits}fs,RFlat"


@dataclass
class ProductIndex:
    """Inverted lists of vectors as m codes of ``bits`` bits; searches refine the best codes exactly.

    A code stands for a vector's residual from its list's centroid, turned by the sample's principal axes, which are
    dealt to the parts so that each holds a like share of the variance. Axes and codebooks come from a sample of
    ``train_size`` vectors, ``sample`` at most, taken in a seeded order; all vectors are coded.
    """

    centroids: DataFrame
    turn: np.ndarray  # (dim, dim)
    books: np.ndarray  # (m, 2**bits, dim / m)
    rows: DataFrame  # doc_id, vector, list_id, code

    @classmethod
    def fit(cls, vectors: DataFrame, nlist: int, m: int, bits: int = 4, seed: int = 42, sample: int = 20_000, rounds: int = 12, strategy: str = "nlist") -> ProductIndex:
        n = vectors.count()
        if not n:
            raise RuntimeError("no vectors to index")
        centroids = train_coarse(vectors, nlist, seed)
        few = vectors.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "doc_id"))).limit(min(sample, max(train_size(n, nlist, strategy), min(n, 1 << bits))))
        got = assign(few.select("doc_id", "vector"), centroids).orderBy("doc_id").collect()
        means = {r["list_id"]: np.array(r["centroid"]) for r in centroids.collect()}
        x = np.array([np.array(r["vector"], float) - means[r["list_id"]] for r in got])
        m = min(m, x.shape[1])
        if x.shape[1] % m:
            raise ValueError("the number of components must be a multiple of m")
        axes = np.linalg.eigh(np.cov(x, rowvar=False) if len(x) > 1 else np.eye(x.shape[1]))[1][:, ::-1]
        # Axis j goes to part j mod m, back and forth.
        place = np.arange(x.shape[1]).reshape(-1, m)
        place[1::2] = place[1::2, ::-1]
        turn = axes[:, place.T.ravel()]
        rng, books = np.random.default_rng(seed), []
        for part in np.split(x @ turn, m, axis=1):
            c = part[rng.permutation(len(part))[: 1 << bits]]
            for _ in range(rounds):
                near = ((c * c).sum(axis=1)[None] - 2 * part @ c.T).argmin(axis=1)
                c = np.array([part[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(len(c))])
            books.append(c)
        table = np.array(books)

        def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 1024):
                    b = whole.slice(at, 1024)
                    own = np.array([means[i] for i in b.column(2).to_pylist()])
                    v = ((matrix(b.column(1)) - own) @ turn).reshape(b.num_rows, m, -1)
                    code = ((v[:, :, None] - table[None]) ** 2).sum(axis=3).argmin(axis=2).astype(np.uint8)
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array([c.tobytes() for c in code], pa.binary())], [*b.schema.names, "code"])

        rows = assign(vectors.select("doc_id", "vector"), centroids).select("doc_id", "vector", "list_id")
        schema = rows.select("*", F.lit(b"").alias("code")).schema
        return cls(centroids, turn, table, rows.mapInArrow(coded, schema))

    def search(self, queries: DataFrame, k: int, nprobe: int, k_factor: int = 4) -> DataFrame:
        """The k best by codes of each query's nearest lists, ``k_factor`` times as many, refined by inner product."""
        if k <= 0:
            raise ValueError("k must be above 0")
        books, turn = self.books, self.turn
        asked = probes(queries, self.centroids, nprobe).join(F.broadcast(self.centroids), "list_id")
        asked = asked.select("query_id", "list_id", F.col("vector").cast("array<double>").alias("_q"), dot(F.col("vector"), F.col("centroid")).alias("_c"))

        def approximate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 4096):
                    b = whole.slice(at, 4096)
                    q = (matrix(b.column("_q")) @ turn).reshape(b.num_rows, len(books), -1)
                    code = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(b.num_rows, -1)
                    near = (books[np.arange(len(books))[None], code] * q).sum(axis=(1, 2)) + b.column("_c").to_numpy()
                    yield pa.RecordBatch.from_arrays([b.column("query_id"), b.column("doc_id"), pa.array(near)], ["query_id", "doc_id", "score"])

        pairs = self.rows.select("doc_id", "list_id", "code").join(asked, "list_id").select("query_id", "doc_id", "_q", "_c", "code")
        best = top_k(pairs.mapInArrow(approximate, "query_id string, doc_id string, score double"), k * k_factor)
        exact = best.select("query_id", "doc_id").join(self.rows.select("doc_id", "vector"), "doc_id").join(queries.select("query_id", F.col("vector").alias("_q")), "query_id")
        return top_k(exact.select("query_id", "doc_id", dot(F.col("vector"), F.col("_q")).alias("score")), k)
