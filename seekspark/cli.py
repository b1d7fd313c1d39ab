"""Command line: prepare a corpus, run modes over it, sum their results up, measure a tokenizer.

    python -m seekspark prepare --seed seed.jsonl --pool name=docs.jsonl --queries q.jsonl --qrels r.jsonl --out folder
    python -m seekspark benchmark --corpus folder --modes bm25,hybrid_rrf --out results
    python -m seekspark summarise --csv results
    python -m seekspark tokens --tokenizer file.json --texts lines.txt --csv rates
"""

from __future__ import annotations

import argparse
import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekspark.functions import text as T
from seekspark.operators import corpus, metrics, models
from seekspark.plans import pipelines
from seekspark.plans.config import Config, LatencyConfig, load_config
from seekspark.sources import store
from seekspark.sources import tables as S

#: The prefix of seed documents' ids.
SEED = "seed"


def _listed(value: str | None) -> list[str] | None:
    return None if value is None else [v.strip() for v in value.split(",") if v.strip()]


def capped(scales: tuple[int, ...], cap: int | None) -> list[int]:
    """The scales up to ``cap``."""
    kept = [s for s in scales if cap is None or s <= cap]
    if not kept:
        raise ValueError(f"no scale is at most {cap}")
    return kept


def prepare(spark: SparkSession, config: Config, seed: str, pools: dict[str, str], queries: str, qrels: str, out: str, cap: int | None = None, encoders: list[str] | None = None) -> dict:
    """Write the de-duplicated corpus with each document's place in the nested scales, queries, judgements, vectors
    and a manifest to ``out``; the manifest comes back."""
    c, scales = config.corpus, capped(config.corpus.scales, cap)
    schema = "id string, title string, text string"
    seeds = S.seed_documents(S.read_jsonl(spark, seed, schema), SEED)
    docs = seeds
    if pools:
        pool, _ = S.distractor_pool({n: S.documents_from(S.read_jsonl(spark, p, schema)) for n, p in pools.items()})
        docs = docs.unionByName(S.seeded_sample(pool, c.sample, c.seed) if c.sample else pool)
    docs = corpus.deduplicate(docs.withColumn("is_seed", S.is_seed(F.col("doc_id"), SEED)), c.jaccard)
    placed = corpus.nested_scales(docs, [max(scales)], c.seed, c.retain_seed).select("doc_id", "pos")
    docs.join(placed, "doc_id").select("doc_id", "title", "text", "pos").write.mode("overwrite").parquet(f"{out}/corpus")
    kept = spark.read.parquet(f"{out}/corpus")
    q = S.queries_from(S.read_jsonl(spark, queries, "id string, text string"))
    rows = S.read_jsonl(spark, qrels, "qid string, did string, rel int")
    judged = S.qrels_from(rows.select(F.col("qid").alias("query_id"), F.concat(F.lit(f"{SEED}:"), "did").alias("doc_id"), "rel"))
    q.write.mode("overwrite").parquet(f"{out}/queries")
    judged.write.mode("overwrite").parquet(f"{out}/qrels")
    revisions = {}
    for slug in encoders or []:
        p = models.prefixes(slug)
        revisions[slug] = store.encoder_revision({"slug": slug, "query": p.query, "document": p.document})
        models.embed_missing(store.EmbeddingCache(spark, f"{out}/vectors"), kept, slug, revisions[slug], p.document)
        models.encode(q, "query_id", F.col("text"), slug, p.query).write.mode("overwrite").parquet(f"{out}/query_vectors/{store.slug_of(slug)}")
    counts = {s: kept.filter(F.col("pos") <= s).count() for s in scales}
    digest = store.corpus_digest(kept).first()["digest"]
    store.save_manifest(spark, f"{out}/manifest", counts, revisions, digest or "", q.count(), judged.count())
    return store.load_manifest(spark, f"{out}/manifest")


def benchmark(spark: SparkSession, config: Config, folder: str, modes: list[str], scales: list[int] | None = None, encoders: list[str] | None = None, preflight: bool = False) -> DataFrame:
    """All modes over all scales and encoders of a prepared corpus."""
    manifest = store.load_manifest(spark, f"{folder}/manifest")
    docs, q, judged = (spark.read.parquet(f"{folder}/{t}") for t in ("corpus", "queries", "qrels"))
    every = sorted(int(s) for s in manifest["scales"])
    if config.rerank.slug != "overlap" and "hybrid_rerank" in modes and models.usable_reranker(config.rerank.slug) is None:
        modes = [m for m in modes if m != "hybrid_rerank"]
    out: list[DataFrame] = []
    for scale in scales or every:
        own = docs.filter(F.col("pos") <= scale).select("doc_id", "title", "text").persist()
        shared: dict = {}
        for slug in encoders or list(manifest["encoders"]) or ["none"]:
            vectors = store.EmbeddingCache(spark, f"{folder}/vectors").get(slug, manifest["encoders"].get(slug, "")) if slug != "none" else None
            asked = spark.read.parquet(f"{folder}/query_vectors/{store.slug_of(slug)}") if vectors is not None else None
            inp = pipelines.Inputs(own, q, judged, S.vectors_for(vectors, own) if vectors is not None else None, asked, scale, slug)
            inp.made |= {k: v for k, v in shared.items() if k[0] == "bm25"}
            if preflight and scale == every[0] and not out:
                p = config.preflight
                row = metrics.preflight(pipelines._bm25(inp, config).search(q, config.hybrid.pool), judged, p.target, p.tolerance, p.least).first()
                print(f"preflight: ndcg_10 {row['ndcg_10']:.4f}, {row['status']}")
                if row["status"] == "fail":
                    raise RuntimeError("the preflight check failed")
            out += [pipelines.get_mode(m)(inp, config) for m in modes]
            shared = {k: v for k, v in inp.made.items() if isinstance(k, tuple)}
    rows = out[0]
    for r in out[1:]:
        rows = rows.unionByName(r, allowMissingColumns=True)
    return rows.select("*", *[F.lit(v).alias(k) for k, v in pipelines.environment(spark).items()])


def summarise(spark: SparkSession, csv: str, pick: str = "last") -> tuple[DataFrame, DataFrame]:
    """(headline, by encoder) of the rows of a report."""
    rows = spark.read.option("header", True).csv(csv)
    rows = rows.withColumns({"scale": F.col("scale").cast("int"), "ndcg_10": T.safe_float(F.col("ndcg_10"))})
    return pipelines.headline(rows, pick), pipelines.by_encoder(rows)


def tokens(spark: SparkSession, tokenizer: str, texts: str, csv: str | None, batch: int = 8192) -> DataFrame:
    """A tokenizer's rates over the lines of a text file (or ``text`` fields of a JSON one), also as a report."""
    rows = spark.read.schema("text string").json(texts) if texts.endswith((".json", ".jsonl")) else spark.read.text(texts).withColumnRenamed("value", "text")
    out = models.tokenizer_throughput(rows.select(F.lit("").alias("doc_id"), "text"), tokenizer, batch)
    if csv:
        store.write_csv([out], csv)
    return out


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="seekspark")
    p.add_argument("--config", help="settings, as JSON (or YAML where that library is there)")
    sub = p.add_subparsers(dest="command", required=True)
    own = sub.add_parser("prepare")
    for name in ("seed", "queries", "qrels", "out"):
        own.add_argument(f"--{name}", required=True)
    own.add_argument("--pool", action="append", default=[], help="name=file of other documents; may be repeated")
    own.add_argument("--max-scale", type=int)
    own.add_argument("--encoders", help="names, separated by commas; none: no vectors")
    own = sub.add_parser("benchmark")
    for name in ("corpus", "out"):
        own.add_argument(f"--{name}", required=True)
    own.add_argument("--modes", default="bm25,vector,hybrid_rrf")
    own.add_argument("--scales")
    own.add_argument("--encoders")
    own.add_argument("--calls", type=int, default=0, help="calls that are timed for each row")
    own.add_argument("--preflight", action="store_true")
    own = sub.add_parser("summarise")
    own.add_argument("--csv", required=True)
    own.add_argument("--pick", default="last", choices=["last", "best"])
    own = sub.add_parser("tokens")
    for name in ("tokenizer", "texts"):
        own.add_argument(f"--{name}", required=True)
    own.add_argument("--csv")
    own.add_argument("--batch", type=int, default=8192)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    config = load_config(a.config)
    spark = spark or SparkSession.builder.appName("seekspark").getOrCreate()
    if a.command == "prepare":
        print(prepare(spark, config, a.seed, dict(p.split("=", 1) for p in a.pool), a.queries, a.qrels, a.out, a.max_scale, _listed(a.encoders)))
    elif a.command == "benchmark":
        if a.calls:
            config = dataclasses.replace(config, latency=LatencyConfig(calls=a.calls))
        scales = [int(s) for s in _listed(a.scales)] if a.scales else None
        rows = benchmark(spark, config, a.corpus, _listed(a.modes) or [], scales, _listed(a.encoders), a.preflight)
        store.write_csv([rows.withColumn("ordinal", F.monotonically_increasing_id())], a.out)
        rows.select("mode", "scale", "encoder", *[c for c in metrics.CORE_FIELDS if c in rows.columns]).show(100, False)
    elif a.command == "summarise":
        for frame in summarise(spark, a.csv, a.pick):
            frame.show(200, False)
    else:
        tokens(spark, a.tokenizer, a.texts, a.csv, a.batch).show(1, False)
