"""Ranked lists: top k a query, reciprocal-rank and weighted fusion. A run is (query_id, doc_id, score, rank)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_k(scored: DataFrame, k: int, by: list[str] | None = None, order: list[Column] | None = None) -> DataFrame:
    """The k best of each group, ranked from 1: score descending, then doc_id ascending."""
    group = by or ["query_id"]
    w = Window.partitionBy(*group).orderBy(*(order or [F.desc("score"), F.asc("doc_id")]))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _tagged(runs: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [r.select("query_id", "doc_id", "score", "rank", F.lit(i).alias("list")) for i, r in enumerate(runs)])


def _weight(weights: list[float] | None) -> Column:
    if not weights:
        return F.lit(1.0)
    return F.coalesce(F.get(F.array(*[F.lit(float(w)) for w in weights]), F.col("list")), F.lit(1.0))


def _in_order(term: Column) -> Column:
    """A sum of doubles in the order of the lists, so it does not depend on the plan."""
    parts = F.array_sort(F.collect_list(F.struct("list", term.alias("x"))))
    return F.aggregate(parts, F.lit(0.0), lambda s, p: s + p["x"])


def rrf(runs: list[DataFrame], top: int, k: int = 60, weights: list[float] | None = None) -> DataFrame:
    """Sums of weight / (k + rank). A list without a weight weighs 1. A document is once in a list."""
    scored = _tagged(runs).groupBy("query_id", "doc_id").agg(_in_order(_weight(weights) / (k + F.col("rank"))).alias("score"))
    return top_k(scored, top)


def weighted(runs: list[DataFrame], top: int, weights: list[float] | None = None) -> DataFrame:
    """Sums of weight x score, scores stretched to 0..1 in each query's list (all 0 if they are equal)."""
    w = Window.partitionBy("query_id", "list")
    low, high = F.min("score").over(w), F.max("score").over(w)
    norm = F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(0.0)
    scored = _tagged(runs).withColumn("norm", norm).groupBy("query_id", "doc_id").agg(_in_order(_weight(weights) * F.col("norm")).alias("score"))
    return top_k(scored, top)


def rrf_sweep(runs: list[DataFrame], top: int, ks: list[int], weights: list[tuple[float, ...]]) -> DataFrame:
    """All settings in one job: (rrf_k, w, query_id, doc_id, score, rank); w numbers the weights."""
    spark = runs[0].sparkSession
    grid = spark.createDataFrame([(k, i, [float(x) for x in w]) for k in ks for i, w in enumerate(weights)], "rrf_k int, w int, ws array<double>")
    rows = _tagged(runs).join(F.broadcast(grid))
    term = F.coalesce(F.get("ws", F.col("list")), F.lit(1.0)) / (F.col("rrf_k") + F.col("rank"))
    scored = rows.groupBy("rrf_k", "w", "query_id", "doc_id").agg(_in_order(term).alias("score"))
    return top_k(scored, top, ["rrf_k", "w", "query_id"])


def rrf_slug(k: int) -> str:
    return f"rrf_k{k}"


def weighted_slug(weights: list[float]) -> str:
    return "weighted_" + "_".join(f"{w:.2f}".replace(".", "p") for w in weights)


class Fusion(Protocol):
    """A way to make one run of several."""

    slug: str

    def fuse(self, runs: list[DataFrame], top: int) -> DataFrame: ...


@dataclass(frozen=True)
class Rrf:
    k: int = 60
    weights: tuple[float, ...] | None = None

    @property
    def slug(self) -> str:
        return rrf_slug(self.k)

    def fuse(self, runs: list[DataFrame], top: int) -> DataFrame:
        return rrf(runs, top, self.k, list(self.weights) if self.weights else None)


@dataclass(frozen=True)
class Weighted:
    weights: tuple[float, ...] = (0.5, 0.5)

    @property
    def slug(self) -> str:
        return weighted_slug(list(self.weights))

    def fuse(self, runs: list[DataFrame], top: int) -> DataFrame:
        return weighted(runs, top, list(self.weights))


FUSIONS: dict[str, Callable[..., Fusion]] = {"rrf": Rrf, "weighted": Weighted}


def get_fusion(slug: str, **settings: object) -> Fusion:
    if slug not in FUSIONS:
        raise KeyError(f"no fusion {slug!r}; there are {sorted(FUSIONS)}")
    return FUSIONS[slug](**settings)
