"""Exact vector search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekspark.operators.fusion import top_k
from seekspark.sources.tables import check_vectors

#: Bytes of the queries of a block, and of the scores that are held at a time.
BLOCK_BYTES, HELD_BYTES = 32 << 20, 64 << 20
METRICS = ("dot", "l2")


def in_order(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """Scores of pairs of rows, added up component by component: the value does not depend on the plan."""
    terms = x * q if metric == "dot" else -((x - q) ** 2)
    return np.cumsum(terms, axis=1)[:, -1] if x.shape[1] else np.zeros(len(x))


def matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a list column without nulls, all of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1)


def best_of(x: np.ndarray, q: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, row number, score) of all that may be among the ``k`` best of a query, ties included."""
    step = max(1, HELD_BYTES // (8 * max(1, len(x))))
    out = []
    for at in range(0, len(q), step):
        part = q[at : at + step]
        s = part @ x.T
        if metric == "l2":
            s = 2 * s - (x * x).sum(axis=1)[None, :] - (part * part).sum(axis=1)[:, None]
        m = min(k, len(x))
        least = np.partition(s, len(x) - m, axis=1)[:, len(x) - m]
        qi, xi = np.nonzero(s >= (least - 1e-9 * np.maximum(1.0, np.abs(least)))[:, None])
        out.append((qi + at, xi, in_order(x[xi], part[qi], metric)))
    return tuple(np.concatenate(c) for c in zip(*out))


def block_topk(vectors: DataFrame, queries: DataFrame, k: int, block: int | None = None, metric: str = "dot") -> DataFrame:
    """(query_id, doc_id, score, rank): the k largest scores of each query (query_id, vector) over all vectors.

    Scores are inner products or negative squared distances, by matrix products. Queries are sent in blocks of
    bounded size; each batch of vectors answers with its k best a query, so what is shuffled does not grow with the
    product of both sides.
    """
    if k <= 0:
        raise ValueError("k must be above 0")
    if metric not in METRICS:
        raise ValueError(f"metric is one of {METRICS}")
    spark = vectors.sparkSession
    kinds = "query_id string, doc_id string, score double"
    row = queries.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("d")).first()
    if not row["n"]:
        return top_k(spark.createDataFrame([], kinds), k)
    block = block or max(1, BLOCK_BYTES // (8 * max(1, row["d"])))
    blocks = -(-row["n"] // block)
    part = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    every = None
    for i in range(blocks):
        rows = queries.filter(part == i).select("query_id", "vector").collect()
        if not rows:
            continue
        sent = spark.sparkContext.broadcast(([r["query_id"] for r in rows], np.array([r["vector"] for r in rows], float)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, q = sent.value
            names = pa.array(ids, pa.string())
            for b in batches:
                if b.num_rows:
                    qi, xi, score = best_of(matrix(b.column(1)), q, k, metric)
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(qi)), b.column(0).take(pa.array(xi)), pa.array(score)], ["query_id", "doc_id", "score"])

        found = vectors.filter("vector is not null").select("doc_id", "vector").mapInArrow(run, kinds)
        every = found if every is None else every.unionByName(found)
    return top_k(every, k)


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "dot", check: bool = False) -> DataFrame:
    """The exact ``block_topk``; ``check`` first makes sure that ids differ and lengths do not."""
    if check:
        check_vectors(vectors)
    return block_topk(vectors, queries, k, metric=metric)
