"""Search modes as plans over the same tables, their sweeps, and summaries of results."""

from __future__ import annotations

import platform
import sys
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seekspark.functions.text import STOPWORDS, safe_float
from seekspark.operators import fusion, ivf, lexical, metrics, models, retrieval, vector
from seekspark.plans.config import Config
from seekspark.sources.scratch import workspace


@dataclass
class Inputs:
    """docs (doc_id, title, text), queries (query_id, text), qrels, vectors (doc_id, vector), query_vectors (query_id, vector)."""

    docs: DataFrame
    queries: DataFrame
    qrels: DataFrame
    vectors: DataFrame | None = None
    query_vectors: DataFrame | None = None
    scale: int = 5000
    encoder: str = "none"
    index: lexical.Bm25 | None = None
    #: Indexes that modes have made.
    made: dict = field(default_factory=dict, repr=False)

    def needs_vectors(self) -> None:
        if self.vectors is None or self.query_vectors is None:
            raise ValueError("this mode needs vectors of documents and queries")


MODES: dict[str, Callable[[Inputs, Config], DataFrame]] = {}


def mode(name: str) -> Callable:
    def add(f: Callable) -> Callable:
        MODES[name] = f
        return f

    return add


def get_mode(name: str) -> Callable:
    if name not in MODES:
        raise KeyError(f"no mode {name!r}; there are {sorted(MODES)}")
    return MODES[name]


def _bm25(inp: Inputs, config: Config) -> lexical.Bm25:
    """The documents' index, one for all modes that run on the same inputs."""
    c = config.bm25
    key = ("bm25", repr(c))
    if key not in inp.made:
        inp.made[key] = inp.index or lexical.Bm25.fit(inp.docs, c.k1, c.b, c.method, STOPWORDS if c.stopwords else None)
    return inp.made[key]


def _with_latency(rows: DataFrame, search: Callable[[DataFrame], DataFrame], queries: DataFrame, config: Config) -> DataFrame:
    """``rows`` with lat_p50_ms, lat_p95_ms and lat_p99_ms of single queries, if the settings ask for calls."""
    if not config.latency.calls:
        return rows
    row = metrics.search_and_time(search, queries, config.latency.calls, config.latency.warmup)[1].first()
    return rows.select("*", *[F.lit(float(row[p])).alias(f"lat_{p}_ms") for p in ("p50", "p95", "p99")])


def _result(run: DataFrame, inp: Inputs, config: Config, name: str, **extras: object) -> DataFrame:
    own = metrics.evaluate(run, inp.qrels, config.k_values)
    first = [F.lit(name).alias("mode"), F.lit(inp.scale).alias("scale"), F.lit(inp.encoder if name != "bm25" else "none").alias("encoder")]
    return own.select(*first, *own.columns, *[F.lit(v).alias(k) for k, v in extras.items()])


def _swept(runs: DataFrame, by: list[str], inp: Inputs, config: Config, name: str) -> DataFrame:
    """Evaluates all settings in one job: a setting's queries are queries of their own, which take on the
    judgements of the query that they stem from, as far as that was searched."""
    tag = F.concat_ws("|", *by)
    each = runs.select(F.concat_ws("|", tag, "query_id").alias("q"), "query_id", *by, "doc_id", "score").persist()
    asked = each.select("q", "query_id").distinct()
    judged = asked.join(inp.qrels, "query_id").select(F.col("q").alias("query_id"), "doc_id", "rel")
    scored = metrics.per_query(each.select(F.col("q").alias("query_id"), "doc_id", "score"), judged, config.k_values)
    names = [c for c in scored.columns if c != "query_id"]
    settings = each.select("q", *by).distinct().withColumnRenamed("q", "query_id")
    means = [F.round(F.avg(F.round(m, 12)), 5).alias(m) for m in names]
    out = scored.join(settings, "query_id").groupBy(*by).agg(*means, F.count("*").alias("n_queries"))
    return out.select(F.lit(name).alias("mode"), F.lit(inp.scale).alias("scale"), F.lit(inp.encoder).alias("encoder"), *names, "n_queries", *by)


@mode("bm25")
def bm25(inp: Inputs, config: Config) -> DataFrame:
    search = lambda q: _bm25(inp, config).search(q, config.hybrid.pool)
    return _with_latency(_result(search(inp.queries), inp, config, "bm25"), search, inp.queries, config)


def _product(inp: Inputs, config: Config) -> ivf.ProductIndex:
    c = config.vector
    key = ("product", repr(c), inp.scale)
    if key not in inp.made:
        dim = len(inp.vectors.first()["vector"])
        inp.made[key] = ivf.ProductIndex.fit(inp.vectors, c.nlist_for_scale(inp.scale), ivf.parts_of(dim, c.m), c.bits)
    return inp.made[key]


def _dense(inp: Inputs, config: Config, queries: DataFrame, k: int, nprobe: int | None = None) -> DataFrame:
    """Exact up to the scale that the settings name, inverted lists of codes (the largest nprobe by default) beyond."""
    inp.needs_vectors()
    if inp.scale <= config.vector.exact_to:
        return vector.exact_topk(inp.vectors, queries, k)
    return _product(inp, config).search(queries, k, nprobe or max(config.vector.nprobe), config.vector.k_factor)


@mode("vector")
def dense(inp: Inputs, config: Config) -> DataFrame:
    inp.needs_vectors()
    pool = config.hybrid.pool
    search = lambda q: _dense(inp, config, q, pool)
    if inp.scale <= config.vector.exact_to:
        rows = _result(search(inp.query_vectors), inp, config, "vector", nprobe=0)
    else:
        runs = [_dense(inp, config, inp.query_vectors, pool, n).withColumn("nprobe", F.lit(n)) for n in config.vector.nprobe]
        rows = _swept(reduce(DataFrame.unionByName, runs), ["nprobe"], inp, config, "vector")
    return _with_latency(rows, search, inp.query_vectors, config)


def _both(inp: Inputs, config: Config, near: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], list[DataFrame]]:
    """Queries to the runs of words and of vectors."""

    def runs(queries: DataFrame) -> list[DataFrame]:
        asked = inp.query_vectors.join(queries.select("query_id"), "query_id", "left_semi")
        return [_bm25(inp, config).search(queries, config.hybrid.pool), near(asked)]

    return runs


def _fused(inp: Inputs, config: Config, near: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    h, runs = config.hybrid, _both(inp, config, near)
    rows = _swept(fusion.rrf_sweep(runs(inp.queries), h.pool, list(h.rrf_k), list(h.weights)), ["rrf_k", "w"], inp, config, name)
    return _with_latency(rows, lambda q: fusion.rrf(runs(q), h.pool), inp.queries, config)


@mode("hybrid_rrf")
def hybrid_rrf(inp: Inputs, config: Config) -> DataFrame:
    return _fused(inp, config, lambda q: _dense(inp, config, q, config.hybrid.pool), "hybrid_rrf")


@mode("hybrid_rerank")
def hybrid_rerank(inp: Inputs, config: Config) -> DataFrame:
    h, r = config.hybrid, config.rerank
    runs = _both(inp, config, lambda q: _dense(inp, config, q, h.pool))

    def search(queries: DataFrame) -> DataFrame:
        return models.rerank(fusion.rrf(runs(queries), h.pool), queries, inp.docs, r.pool, max(config.k_values), r.slug, r.tail)

    return _with_latency(_result(search(inp.queries), inp, config, "hybrid_rerank", reranker=r.slug), search, inp.queries, config)


def _lists(inp: Inputs, config: Config) -> retrieval.Bbq:
    """The vectors' binary lists in a folder of the session's workspace, one for all modes on the same inputs."""
    inp.needs_vectors()
    c = config.vector
    if "bbq" not in inp.made:
        spark = inp.docs.sparkSession
        own = retrieval.Bbq(f"{workspace(spark)}/bbq-{uuid.uuid4().hex}", k_factor=c.k_factor)
        centroids = None
        if c.coarse == "lloyd":
            dim = len(inp.vectors.first()["vector"])
            centroids = ivf.lloyd(inp.vectors, ivf.first_centroids(inp.vectors, c.nlist_for_scale(inp.scale)), c.rounds, dim)
        own.add_documents(inp.docs, inp.vectors, centroids)
        inp.made["bbq"] = own
    return inp.made["bbq"]


@mode("diskbbq")
def diskbbq(inp: Inputs, config: Config) -> DataFrame:
    """Each nprobe, over lists in memory and over lists in files; both give the same results."""
    lists, k, out = _lists(inp, config), config.hybrid.pool, None
    for n in config.vector.nprobe:
        for where in ("ram", "disk"):
            lists.set_search_params(nprobe=n)
            run = lists.search(inp.query_vectors, k, where).withColumns({"nprobe": F.lit(n), "storage": F.lit(where)})
            out = run if out is None else out.unionByName(run)
    rows = _swept(out, ["nprobe", "storage"], inp, config, "diskbbq")
    return _with_latency(rows, lambda q: lists.search(q, k), inp.query_vectors, config)


@mode("hybrid_bbq")
def hybrid_bbq(inp: Inputs, config: Config) -> DataFrame:
    lists = _lists(inp, config)
    lists.set_search_params(nprobe=max(config.vector.nprobe))
    return _fused(inp, config, lambda q: lists.search(q, config.hybrid.pool, "ram"), "hybrid_bbq")


def benchmark(inputs: list[Inputs], modes: list[str], config: Config) -> DataFrame:
    """All modes on all inputs, as rows under the union of their columns, with the environment beside them."""
    out = None
    for inp in inputs:
        for name in modes:
            rows = get_mode(name)(inp, config)
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    env = environment(inputs[0].docs.sparkSession)
    return out.select("*", *[F.lit(v).alias(k) for k, v in env.items()])


def environment(spark: SparkSession) -> dict[str, str]:
    return {"python": sys.version.split()[0], "spark": spark.version, "system": platform.system(), "machine": platform.machine()}


def summarise(results: DataFrame, pick: str = "last", order: str = "ordinal", best: str = "ndcg_10") -> DataFrame:
    """One row of ``results`` for each scale, mode and encoder: the last by ``order``, or the best by ``best``."""
    if pick not in ("last", "best"):
        raise ValueError("pick is last or best")
    by = [F.desc(order)] if pick == "last" else [F.desc(best), F.desc(order)]
    w = Window.partitionBy("scale", "mode", "encoder").orderBy(*by)
    return results.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def by_encoder(results: DataFrame) -> DataFrame:
    """(encoder, points): all (scale, mode, ndcg_10) of each encoder, in that order."""
    return results.groupBy("encoder").agg(F.array_sort(F.collect_list(F.struct("scale", "mode", "ndcg_10"))).alias("points"))


def headline(results: DataFrame, pick: str = "last") -> DataFrame:
    """(scale, mode, encoder, ndcg_10, recall_10, p95_ms): cells that are missing or no numbers count as 0."""
    named = {"ndcg_10": "ndcg_10", "recall_10": "recall_10", "lat_p95_ms": "p95_ms"}
    cell = lambda c: safe_float(F.col(c).cast("string")) if c in results.columns else F.lit(0.0)
    rows = results if "ordinal" in results.columns else results.withColumn("ordinal", F.monotonically_increasing_id())
    return summarise(rows, pick).select("scale", "mode", "encoder", *[cell(c).alias(n) for c, n in named.items()])
