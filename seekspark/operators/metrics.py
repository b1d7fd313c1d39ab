"""Evaluation of runs against judgements, and latency percentiles."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _in_order(term: Column, key: str) -> Column:
    """A sum in the order of ranks, so that it does not depend on the plan."""
    return F.aggregate(F.array_sort(F.collect_list(F.struct(key, term.alias("x")))), F.lit(0.0), lambda s, p: s + p["x"])


def per_query(run: DataFrame, qrels: DataFrame, ks: Iterable[int] = (10, 100), gain: str = "linear") -> DataFrame:
    """query_id, ndcg, map, mrr, p_5 and ndcg_k, recall_k, p_k for each k, of queries that are in both tables.

    Documents rank by score, equal ones by doc_id descending. rel >= 1 is relevant; what is not judged is not.
    gain: linear (rel) or exponential (2**rel - 1). Queries without a relevant document score 0.
    """
    if gain not in ("linear", "exponential"):
        raise ValueError(f"unknown gain {gain!r}")
    ks = sorted(set(ks))
    value = (lambda c: c.cast("double")) if gain == "linear" else (lambda c: F.pow(F.lit(2.0), c) - 1)
    discount = F.log2(F.col("r") + 1.0)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("doc_id"))
    judged = qrels.select("query_id").distinct()
    ranked = run.join(judged, "query_id", "left_semi").withColumn("r", F.row_number().over(w)).select("query_id", "doc_id", "r")
    hits = ranked.join(qrels, ["query_id", "doc_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    seen = Window.partitionBy("query_id").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    hits = hits.withColumn("found", F.sum((F.col("rel") >= 1).cast("int")).over(seen))
    got = F.when(F.col("rel") > 0, value(F.col("rel")) / discount)
    good = F.col("rel") >= 1
    cuts = sorted({*ks, 5})
    found = hits.groupBy("query_id").agg(
        _in_order(F.coalesce(got, F.lit(0.0)), "r").alias("dcg"),
        *[_in_order(F.when(F.col("r") <= k, F.coalesce(got, F.lit(0.0))).otherwise(0.0), "r").alias(f"dcg_{k}") for k in ks],
        *[F.sum((good & (F.col("r") <= k)).cast("int")).alias(f"hits_{k}") for k in cuts],
        _in_order(F.when(good, F.col("found") / F.col("r")).otherwise(0.0), "r").alias("ap"),
        F.coalesce(1.0 / F.min(F.when(good, F.col("r"))), F.lit(0.0)).alias("mrr"),
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("rel"), "doc_id")
    ideal = qrels.withColumn("r", F.row_number().over(best))
    top = F.when(F.col("rel") > 0, value(F.col("rel")) / discount).otherwise(0.0)
    wanted = ideal.groupBy("query_id").agg(
        _in_order(top, "r").alias("idcg"),
        *[_in_order(F.when(F.col("r") <= k, top).otherwise(0.0), "r").alias(f"idcg_{k}") for k in ks],
        F.sum((F.col("rel") >= 1).cast("int")).alias("num_rel"),
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return found.join(wanted, "query_id").select(
        "query_id",
        ratio("dcg", "idcg").alias("ndcg"),
        ratio("ap", "num_rel").alias("map"),
        "mrr",
        *[ratio(f"dcg_{k}", f"idcg_{k}").alias(f"ndcg_{k}") for k in ks],
        *[ratio(f"hits_{k}", "num_rel").alias(f"recall_{k}") for k in ks],
        *[(F.col(f"hits_{k}") / k).alias(f"p_{k}") for k in cuts],
    )


def evaluate(run: DataFrame, qrels: DataFrame, ks: Iterable[int] = (10, 100), gain: str = "linear", digits: int = 5) -> DataFrame:
    """One row: the mean of every measure over the queries in both tables, and their number; zeros without any."""
    each = per_query(run, qrels, ks, gain)
    measures = [c for c in each.columns if c != "query_id"]
    return each.agg(*[F.coalesce(F.round(F.avg(F.round(m, 12)), digits), F.lit(0.0)).alias(m) for m in measures], F.count("*").alias("n_queries"))


def preflight(run: DataFrame, qrels: DataFrame, target: float, tolerance: float, least: float) -> DataFrame:
    """(ndcg_10, status): fail below ``least``, warn if further than ``tolerance`` from ``target``, else pass; no data passes."""
    score = F.col("ndcg_10")
    status = (
        F.when(F.col("n_queries") == 0, "pass").when(score < least, "fail").when(F.abs(score - target) > tolerance, "warn").otherwise("pass")
    )
    return evaluate(run, qrels, (10,)).select("ndcg_10", status.alias("status"))


def latency_stats(samples: DataFrame, value: str = "ms", group: list[str] | None = None) -> DataFrame:
    """p50, p95, p99 and p999 (linear between neighbours), mean and n; zeros without samples."""
    p = lambda q: F.coalesce(F.round(F.percentile(value, q), 4), F.lit(0.0))
    aggregates = [p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"), p(0.999).alias("p999"), F.coalesce(F.round(F.avg(value), 4), F.lit(0.0)).alias("mean"), F.count(value).alias("n")]
    return samples.groupBy(*(group or [])).agg(*aggregates)


class LatencyProbe:
    """Times an action on the driver: warm-up calls, then n calls over the inputs in turn."""

    def __init__(self, action: Callable, n: int = 30, warmup: int = 3, inputs: list | None = None, cold: bool = False):
        self.action, self.n, self.warmup, self.inputs, self.cold = action, n, warmup, inputs or [None], cold

    def run(self, spark: SparkSession) -> DataFrame:
        """(i, ms): a row a call. ``cold`` drops cached tables before each."""
        out = []
        for i in range(-self.warmup, self.n):
            if self.cold:
                spark.catalog.clearCache()
            item = self.inputs[i % len(self.inputs)]
            began = time.perf_counter_ns()
            self.action() if item is None else self.action(item)
            if i >= 0:
                out.append((i, (time.perf_counter_ns() - began) / 1e6))
        return spark.createDataFrame(out, "i int, ms double")


def search_and_time(search: Callable[[DataFrame], DataFrame], queries: DataFrame, calls: int, warmup: int = 1) -> tuple[DataFrame, DataFrame]:
    """(run, latency statistics in milliseconds): all queries in one search, then single ones in turn.

    The queries that are timed are the first ``calls`` by id, taken again if there are fewer.
    """
    spark = queries.sparkSession
    run = search(queries)
    ids = [r["query_id"] for r in queries.select("query_id").orderBy("query_id").limit(max(calls, 1)).collect()]
    if not calls or not ids:
        return run, latency_stats(spark.createDataFrame([], "i int, ms double"))
    single = [queries.filter(F.col("query_id") == i).persist() for i in ids]
    probe = LatencyProbe(lambda q: search(q).write.format("noop").mode("overwrite").save(), calls, warmup, single)
    stats = latency_stats(probe.run(spark))
    for q in single:
        q.unpersist()
    return run, stats


#: Measures that a report shows on their own; all others go along.
CORE_FIELDS = ("ndcg_10", "recall_10", "recall_100", "map", "mrr", "p_5")
