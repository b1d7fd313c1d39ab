import dataclasses
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seekspark import cli
from seekspark.functions import text as T
from seekspark.operators import binary, corpus, fusion, ivf, lexical, metrics, models, retrieval, vector
from seekspark.plans import pipelines
from seekspark.plans.config import Config, CorpusConfig, HybridConfig, LatencyConfig, VectorConfig, build, load_config
from seekspark.sources import scratch, store, tables

DOC = tables.DOCUMENT


def runs(spark, *lists):
    out = []
    for pairs in lists:
        rows = [("q", d, float(s), i + 1) for i, (d, s) in enumerate(pairs)]
        out.append(spark.createDataFrame(rows, "query_id string, doc_id string, score double, rank int"))
    return out


@pytest.fixture(scope="module")
def toy(spark):
    return spark.createDataFrame([(f"doc-{i:04}", f"title {i}", f"body {i} with words w0 w{i % 10}") for i in range(100)], DOC)


@pytest.fixture(scope="module")
def unit(spark):
    x = np.random.RandomState(42).randn(300, 32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x, spark.createDataFrame([(f"d{i:04}", v.tolist()) for i, v in enumerate(x)], "doc_id string, vector array<double>")


def test_body(spark):
    rows = [(" a ", " b\n"), ("", "b"), ("a", ""), ("", "")]
    df = spark.createDataFrame(rows, "t string, x string")
    assert sorted(r[0] for r in df.select(T.body(F.col("t"), F.col("x"))).collect()) == sorted(["a\nb", "b", "a", ""])


def test_names(spark):
    df = spark.createDataFrame([("ndcg_cut_10", "a/b c", "1.5x")], "n string, s string, f string")
    row = df.select(T.measure_name(F.col("n")), T.safe_slug(F.col("s")), T.safe_float(F.col("f"))).first()
    assert tuple(row) == ("ndcg_cut.10", "a_b_c", 0.0)


def test_bm25_search_save_load(spark, toy, tmp_path):
    index = lexical.Bm25.fit(toy)
    q = spark.createDataFrame([("q1", "body 42"), ("q2", "nothing known")], tables.QUERY)
    run = index.search(q, 1).collect()
    assert [(r["query_id"], r["doc_id"]) for r in run] == [("q1", "doc-0042")] and run[0]["score"] > 0
    index.save(str(tmp_path / "i"))
    assert lexical.Bm25.load(spark, str(tmp_path / "i")).search(q, 1).collect() == run


def test_bm25_errors(spark, toy):
    with pytest.raises(RuntimeError):
        lexical.Bm25.fit(toy.limit(0))
    with pytest.raises(ValueError):
        lexical.Bm25.fit(toy.unionByName(toy))
    with pytest.raises(ValueError):
        lexical.Bm25.fit(toy, method="other")


def test_rrf_by_hand(spark):
    got = fusion.rrf(runs(spark, [("a", 1), ("b", 0.5), ("c", 0.1)], [("b", 1), ("a", 0.5), ("d", 0.1)]), 10).orderBy("rank").collect()
    assert [(r["doc_id"], r["score"]) for r in got] == [("a", 1 / 61 + 1 / 62), ("b", 1 / 62 + 1 / 61), ("c", 1 / 63), ("d", 1 / 63)]


def test_weighted_by_hand(spark):
    got = fusion.weighted(runs(spark, [("a", 100), ("b", 50), ("c", 0)], [("c", 5), ("a", 5)]), 10, [0.7, 0.3]).orderBy("rank").collect()
    assert [(r["doc_id"], round(r["score"], 6)) for r in got] == [("a", 0.7), ("b", 0.35), ("c", 0.0)]
    assert fusion.weighted_slug([0.3, 0.7]) == "weighted_0p30_0p70" and fusion.rrf_slug(60) == "rrf_k60"


def test_exact_and_blocks_agree(spark, unit):
    x, v = unit
    q = v.limit(300).filter("doc_id < 'd0007'").withColumnRenamed("doc_id", "query_id")
    a, b = vector.exact_topk(v, q, 5).toPandas(), vector.block_topk(v, q, 5, block=3).toPandas()
    key = ["query_id", "rank"]
    assert list(a.sort_values(key).doc_id) == list(b.sort_values(key).doc_id)
    best = np.argsort(-(x[3] @ x.T))[:5]
    assert list(a[a.query_id == "d0003"].sort_values("rank").doc_id) == [f"d{i:04}" for i in best]
    with pytest.raises(ValueError):
        vector.exact_topk(v, q, 0)


def test_binary_lists_ram_disk_recall(spark, unit, tmp_path):
    x, v = unit
    q = v.filter("doc_id < 'd0030'").withColumnRenamed("doc_id", "query_id")
    lists = binary.BinaryLists.fit(v, 32, 8, nlist=8)
    a = lists.search(q, 10, 6).toPandas()
    lists.save(str(tmp_path / "b"))
    b = binary.BinaryLists.load(spark, str(tmp_path / "b")).search(q, 10, 6).toPandas()
    key = ["query_id", "rank"]
    assert a.sort_values(key).reset_index(drop=True).equals(b.sort_values(key).reset_index(drop=True))
    hits = sum(len({f"d{j:04}" for j in np.argsort(-(x[i] @ x.T))[:10]} & set(a[a.query_id == f"d{i:04}"].doc_id)) for i in range(30))
    assert hits >= 150
    with pytest.raises(ValueError):
        binary.BinaryLists.fit(v, 32, 5)
    with pytest.raises(ValueError):
        binary.BinaryLists.fit(v, 32, 8, nbits=2)


def test_product_index_recall(spark, unit):
    x, v = unit
    q = v.filter("doc_id < 'd0020'").withColumnRenamed("doc_id", "query_id")
    got = ivf.ProductIndex.fit(v, 4, 16).search(q, 10, 4).toPandas()
    hits = sum(len({f"d{j:04}" for j in np.argsort(-(x[i] @ x.T))[:10]} & set(got[got.query_id == f"d{i:04}"].doc_id)) for i in range(20))
    assert hits >= 100 and ivf.default_nlist(500) == 128 and ivf.train_size(100, 4, "sqrt") == 10


def test_metrics_by_hand(spark):
    qrels = spark.createDataFrame([("q1", "d1", 1), ("q1", "d3", 1), ("q2", "x", 1)], tables.QRELS)
    run = spark.createDataFrame([("q1", "d1", 1.0), ("q1", "d2", 1.0), ("q1", "d3", 0.5), ("q9", "d1", 1.0)], "query_id string, doc_id string, score double")
    row = metrics.per_query(run, qrels, (2,)).first()
    # d2 comes before d1: equal scores, larger id first.
    assert math.isclose(row["ndcg"], (1 / math.log2(3) + 0.5) / (1 + 1 / math.log2(3)))
    assert row["mrr"] == 0.5 and math.isclose(row["map"], (1 / 2 + 2 / 3) / 2) and row["recall_2"] == 0.5 and row["p_5"] == 0.4
    assert metrics.evaluate(run, qrels, (2,)).first()["n_queries"] == 1
    assert metrics.evaluate(run.limit(0), qrels).first()["ndcg_10"] == 0.0


def test_latency(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (10.0,)], "ms double")
    row = metrics.latency_stats(df).first()
    assert row["p50"] == 2.0 and row["p95"] == 9.2 and row["n"] == 3
    assert metrics.latency_stats(df.limit(0)).first()["mean"] == 0.0
    assert metrics.LatencyProbe(lambda: None, n=4, warmup=1).run(spark).count() == 4


def test_dedup_and_scales(spark):
    rows = [("s1", "", "one two three four", True), ("d0", "", "one two three four", False), ("d1", "", "other words are here", False), ("d2", "", "other words are here", False), ("d3", "", "ONE two three  four", False)]
    docs = spark.createDataFrame(rows, DOC + ", is_seed boolean")
    assert sorted(r["doc_id"] for r in corpus.dedup_exact(docs).collect()) == ["d1", "d3", "s1"]
    once = corpus.deduplicate(docs)
    assert sorted(r["doc_id"] for r in once.collect()) == ["d1", "s1"]
    assert sorted(r["doc_id"] for r in corpus.deduplicate(once).collect()) == ["d1", "s1"]
    scales = corpus.nested_scales(docs, [2, 4]).collect()
    small, large = ({r["doc_id"] for r in scales if r["scale"] == n} for n in (2, 4))
    assert small < large and len(small) == 2 and "s1" in small


def test_stores(spark, tmp_path):
    cache = store.EmbeddingCache(spark, str(tmp_path / "e"))
    v = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 4.0])], "doc_id string, vector array<float>")
    assert cache.get("m", "r") is None
    cache.put("m", "r", v)
    assert cache.get("m", "r").count() == 2 and cache.get("m", "other") is None
    with pytest.raises(ValueError):
        cache.put("m", "r", v.unionByName(v))
    docs = spark.createDataFrame([("a", "", "x y"), ("c", "", "z w")], DOC)
    assert [r["doc_id"] for r in cache.missing("m", "r", docs).collect()] == ["c"]
    with pytest.raises(KeyError):
        tables.vectors_for(v, docs)
    assert models.embed_missing(store.EmbeddingCache(spark, str(tmp_path / "f")), docs, "hash-embed", "r").count() == 2
    assert not store.write_csv([], str(tmp_path / "c")) and store.write_csv([docs, v.select("doc_id")], str(tmp_path / "c"))
    assert tables.read_jsonl(spark, str(tmp_path / "none.jsonl"), tables.QUERY).count() == 0
    store.save_manifest(spark, str(tmp_path / "m"), {5: 3}, {"m": "r"}, "x", 1, 2)
    assert store.load_manifest(spark, str(tmp_path / "m"))["scales"] == {"5": 3}


def test_config(tmp_path):
    assert CorpusConfig(scales=(9, 3)).scales == (3, 9) and VectorConfig().nlist_for_scale(90000) == 2048
    for bad in ({"corpus": {"scales": [0]}}, {"corpus": {"jaccard": 2}}, {"vector": {"nope": 1}}, {"version": 1}):
        with pytest.raises(ValueError):
            build(Config, bad)
    (tmp_path / "c.json").write_text('{"corpus": {"scales": [5, 9]}, "vector": {"nlist": [1, 2]}}')
    assert load_config(str(tmp_path / "c.json")).vector.nlist == {5: 1, 9: 2}


def test_registries_and_modes():
    for f in (models.get_encoder, models.get_reranker, pipelines.get_mode):
        with pytest.raises(KeyError):
            f("nope")
    assert sorted(pipelines.MODES) == ["bm25", "diskbbq", "hybrid_bbq", "hybrid_rerank", "hybrid_rrf", "vector"]


def test_bpe(spark):
    docs = spark.createDataFrame([("a", "", "abab abab abc")], DOC)
    assert models.train_bpe(docs, 2)[0] == ("a", "b")


def test_summarise(spark):
    df = spark.createDataFrame([(1, "m", "e", 1, 0.9), (1, "m", "e", 2, 0.5)], "scale int, mode string, encoder string, ordinal int, ndcg_10 double")
    assert pipelines.summarise(df).first()["ndcg_10"] == 0.5 and pipelines.summarise(df, "best").first()["ndcg_10"] == 0.9


def test_bm25_methods_share_postings_and_sum_by_bucket(spark, toy, tmp_path):
    index = lexical.Bm25.fit(toy, path=str(tmp_path / "i"))
    q = spark.createDataFrame([("q1", "body 42 42 w1"), ("q2", "title 7")], tables.QUERY)
    for method in ("lucene", "atire", "bm25l"):
        want = lexical.Bm25.fit(toy, method=method).search(q, 5).orderBy("query_id", "rank").collect()
        assert index.weighing(method).search(q, 5).orderBy("query_id", "rank").collect() == want
    run = index.search(q, 5)
    run.collect()
    plan = run._jdf.queryExecution().executedPlan().toString()
    # Scores are summed in the buckets: the one exchange deals the best k of each by query.
    assert plan.split("Initial Plan")[0].count("hashpartitioning(query_id") <= 2 and "hashpartitioning(query_id, doc_id" not in plan.replace("#", "").split("Initial Plan")[0]
    assert index.size_bytes() == 8 * index.dfs.count() and index.slug == "bm25-lucene"
    empty = spark.createDataFrame([("a", "", ""), ("b", "", "some words")], DOC)
    assert (lexical.Bm25.fit(empty).n, lexical.Bm25.fit(empty).avgdl) == (2, 1.0)


def test_passages_are_found_in_full(spark):
    texts = ["x the quick brown fox jumps over the lazy dog y", "the quick  brown fox jumps over the lazy dog", "quick brown", "brow", "sthe quick brown fox jumps over the lazy dogs", "", None]
    docs = spark.createDataFrame([(str(i), "", t) for i, t in enumerate(texts)], DOC)
    passages = spark.createDataFrame([("p", "the quick brown fox jumps over the lazy dog"), ("s", "brown"), ("t", "brow"), ("n", "no such passage is in any of these texts")], tables.QUERY)
    got = sorted((r["query_id"], r["doc_id"]) for r in corpus.holding(docs, passages).collect())
    assert got == sorted((q["query_id"], str(i)) for q in passages.collect() for i, t in enumerate(texts) if t and q["text"] in t)


def test_l2_and_ties(spark):
    v = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.0, 2.0])], "doc_id string, vector array<double>")
    q = v.filter("doc_id = 'b'").withColumnRenamed("doc_id", "query_id")
    assert [(r["doc_id"], r["score"]) for r in vector.exact_topk(v, q, 2).orderBy("rank").collect()] == [("a", 1.0), ("b", 1.0)]
    assert [(r["doc_id"], r["score"]) for r in vector.exact_topk(v, q, 3, "l2").orderBy("rank").collect()] == [("a", 0.0), ("b", 0.0), ("c", -5.0)]
    with pytest.raises(ValueError):
        vector.exact_topk(v.unionByName(v), q, 2, check=True)
    with pytest.raises(ValueError):
        vector.exact_topk(v, q, 2, "cosine")


def test_retrievers(spark, unit, toy, tmp_path):
    x, v = unit
    q = v.filter("doc_id < 'd0003'").withColumnRenamed("doc_id", "query_id")
    for slug, settings in (("flat", {}), ("ivfpq", {"nlist": 4, "m": 48}), ("bbq", {"path": str(tmp_path / "b"), "nlist": 8})):
        own = retrieval.get_retriever(slug, **settings)
        assert own.slug == slug and own.size_bytes() == 0
        with pytest.raises(RuntimeError):
            own.search(q, 5)
        with pytest.raises(ValueError):
            own.add_documents(None)
        own.add_documents(None, v)
        own.set_search_params(nprobe=8, k_factor=6, other=1)
        assert own.search(q, 5).count() == 15 and own.size_bytes() > 0
        with pytest.raises(ValueError):
            own.search(q, 0)
    words = retrieval.get_retriever("bm25")
    words.add_documents(toy)
    assert words.search(spark.createDataFrame([("q", "body 42")], tables.QUERY), 1).first()["doc_id"] == "doc-0042"
    with pytest.raises(KeyError):
        retrieval.get_retriever("nope")


def test_lists_in_memory_and_in_files(spark, unit, tmp_path):
    x, v = unit
    q = v.filter("doc_id < 'd0010'").withColumnRenamed("doc_id", "query_id")
    own = retrieval.Bbq(str(tmp_path / "b"), nlist=8, nprobe=4)
    own.add_documents(None, v)
    runs = [sorted(map(tuple, own.search(q, 10, m).collect())) for m in ("ram", "disk", "auto")]
    assert runs[0] == runs[1] == runs[2] and own.resolve("auto") == "ram"
    own.auto_disk_bytes = 1
    assert own.resolve("auto") == "disk"
    with pytest.raises(ValueError):
        own.search(q, 10, "tape")
    own.set_search_params(use_rescore=False)
    assert all(float(s).is_integer() for _, _, s, _ in map(tuple, own.search(q, 10, "disk").collect()))
    own.close()
    assert own.held is None


def test_fusions(spark):
    two = runs(spark, [("a", 1), ("b", 0.5)], [("b", 1), ("c", 0.5)])
    for slug, settings, name in (("rrf", {"k": 60}, "rrf_k60"), ("weighted", {"weights": (0.3, 0.7)}, "weighted_0p30_0p70")):
        own = fusion.get_fusion(slug, **settings)
        assert own.slug == name and own.fuse(two, 1).first()["doc_id"] == "b"
    with pytest.raises(KeyError):
        fusion.get_fusion("nope")


def mode_inputs(spark, toy, scale):
    docs = toy.limit(60)
    q = spark.createDataFrame([("q1", "body 5"), ("q2", "title 42 w2")], tables.QUERY)
    qrels = spark.createDataFrame([("q1", "doc-0005", 1), ("q2", "doc-0042", 1)], tables.QRELS)
    v = models.encode(docs, "doc_id", F.col("text"), "hash-embed")
    return pipelines.Inputs(docs, q, qrels, v.persist(), models.encode(q, "query_id", F.col("text"), "hash-embed").persist(), scale, "hash-embed")


@pytest.mark.parametrize("scale", [5000, 100000])
def test_modes_at_both_sizes_with_latency(spark, toy, scale):
    inp = mode_inputs(spark, toy, scale)
    config = Config(vector=VectorConfig(nlist={5000: 4}, nprobe=(2, 4)), hybrid=HybridConfig(rrf_k=(60,), pool=20), latency=LatencyConfig(2, 0))
    rows = pipelines.hybrid_rrf(inp, config).collect()
    assert len(rows) == 3 and all(r["n_queries"] == 2 and r["lat_p95_ms"] >= r["lat_p50_ms"] > 0 for r in rows)
    rows = pipelines.dense(inp, dataclasses.replace(config, latency=LatencyConfig())).collect()
    assert [r["nprobe"] for r in sorted(rows, key=lambda r: r["nprobe"])] == ([0] if scale == 5000 else [2, 4])
    assert "lat_p50_ms" not in rows[0]


def test_search_and_time(spark, toy):
    index = lexical.Bm25.fit(toy)
    q = spark.createDataFrame([("q1", "body 5"), ("q2", "body 6")], tables.QUERY)
    run, stats = metrics.search_and_time(lambda x: index.search(x, 2), q, 3, 0)
    assert run.select("query_id").distinct().count() == 2 and stats.first()["n"] == 3


def test_sources(spark, tmp_path):
    rows = spark.createDataFrame([("q", "d", 1), ("q", "d", 3), ("q", "d", 2)], tables.QRELS).coalesce(1)
    assert tables.qrels_from(rows).first()["rel"] == 2 and tables.qrels_from(rows, F.col("rel")).first()["rel"] == 3
    seeds = tables.seed_documents(spark.createDataFrame([("1", None, "x")], "id string, title string, text string"), "s")
    assert tuple(seeds.first()) == ("s:1", "", "x") and seeds.filter(tables.is_seed(F.col("doc_id"), "s")).count() == 1
    assert tables.queries_and_qrels(spark, str(tmp_path))[0].count() == 0
    (tmp_path / "corpus.jsonl").write_text('{"id": "s:1", "title": "t", "text": "x"}\n{"id": "2", "text": null}\n')
    own = tables.Corpus(spark, str(tmp_path))
    assert own.documents().count() == 2 and own.documents() is own.documents() and own.seeds("s").count() == 1
    own.close()
    v = spark.createDataFrame([("a", [1.0, 2.0])], "doc_id string, vector array<double>")
    v.write.parquet(str(tmp_path / "v"))
    assert tables.load_vectors(spark, str(tmp_path / "v")).schema["vector"].dataType.simpleString() == "array<float>"
    cache = store.EmbeddingCache(spark, str(tmp_path / "e"))
    cache.put("m", "r", v)
    for f in (tmp_path / "e").rglob("*.parquet"):
        f.write_bytes(f.read_bytes()[: f.stat().st_size // 2])
    assert cache.get("m", "r") is None
    made = []
    for _ in range(2):
        scratch.once(spark, "x", spark.read.parquet(str(tmp_path / "v")), lambda path: made.append(path) or path)
    assert len(made) == 1


def test_models_without_weights(spark, tmp_path, capsys):
    states = np.arange(24, dtype=float).reshape(2, 3, 4)
    got = models.last_token_pool(states, np.array([[1, 1, 0], [1, 1, 1]]))
    assert np.allclose(got, np.stack([states[0, 1], states[1, 2]]) / np.linalg.norm(np.stack([states[0, 1], states[1, 2]]), axis=1, keepdims=True))
    assert models.prefixes("e5-mistral-7b").document == "passage: " and models.prefixes("minilm-l6").query == ""
    assert models.usable_reranker("encoder") is None and "left out" in capsys.readouterr().err and models.usable_reranker("overlap")
    assert not models.enough_memory(1e9) and models.enough_memory(0.001)
    assert ivf.factory_label(2048, 48, 4) == "OPQ48,IVF2048,PQ48x4fs,RFlat" and ivf.parts_of(64, 48) == 32 and ivf.parts_of(96, 48) == 48
    assert corpus.bands_and_rows(0.85) == (corpus.BANDS, corpus.ROWS) and corpus.bands_and_rows(0.5)[0] > 4


def test_tokenizer_rates(spark, tmp_path):
    from tokenizers import Tokenizer
    from tokenizers.models import WordLevel
    from tokenizers.pre_tokenizers import Whitespace

    tok = Tokenizer(WordLevel({"hello": 0, "world": 1, "[UNK]": 2}, unk_token="[UNK]"))
    tok.pre_tokenizer = Whitespace()
    path = str(tmp_path / "t.json")
    tok.save(path)
    (tmp_path / "lines.txt").write_text("hello world\ngoodbye world\n\n")
    (tmp_path / "lines.jsonl").write_text('{"text": "hello world"}\n{"text": null}\n')
    assert [r["tokens"] for r in models.tokenize_text(spark, str(tmp_path / "lines.txt"), path).orderBy("doc_id").collect()] == [[0, 1], [2, 1], []]
    assert [r["tokens"] for r in models.tokenize_jsonl(spark, str(tmp_path / "lines.jsonl"), path).orderBy("doc_id").collect()] == [[0, 1], []]
    row = cli.tokens(spark, path, str(tmp_path / "lines.txt"), str(tmp_path / "csv"), 1).first()
    assert (row["doc_count"], row["total_tokens"], row["bytes_processed"], row["vocab_size"]) == (3, 4, 24, 3)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 1
    with pytest.raises(ValueError):
        models.tokenizer_ids(spark.createDataFrame([("a", "b")], "doc_id string, text string"), path, 0)


def test_command_line(spark, tmp_path, capsys):
    write = lambda name, rows: (tmp_path / name).write_text("".join(json.dumps(r) + "\n" for r in rows))
    write("seed.jsonl", [{"id": f"d{i}", "title": f"t{i}", "text": f"doc {i} about topic{i}"} for i in range(5)])
    write("pool.jsonl", [{"id": f"p{i}", "title": "", "text": f"other text {i} of the pool"} for i in range(20)])
    write("q.jsonl", [{"id": f"q{i}", "text": f"topic{i}"} for i in range(2)])
    write("r.jsonl", [{"qid": f"q{i}", "did": f"d{i}", "rel": 1} for i in range(2)])
    (tmp_path / "c.json").write_text(json.dumps({"corpus": {"scales": [5, 12, 99]}, "hybrid": {"rrf_k": [60], "weights": [[1.0, 1.0]], "pool": 10}}))
    at = lambda n: str(tmp_path / n)
    cli.main(["--config", at("c.json"), "prepare", "--seed", at("seed.jsonl"), "--pool", f"x={at('pool.jsonl')}", "--queries", at("q.jsonl"), "--qrels", at("r.jsonl"), "--out", at("out"), "--max-scale", "12", "--encoders", "hash-embed"], spark)
    manifest = store.load_manifest(spark, at("out/manifest"))
    assert manifest["scales"] == {"5": 5, "12": 12} and manifest["n_qrels"] == 2
    cli.main(["--config", at("c.json"), "benchmark", "--corpus", at("out"), "--out", at("results"), "--modes", "bm25,hybrid_rrf"], spark)
    rows = spark.read.option("header", True).csv(at("results")).collect()
    assert len(rows) == 4 and all(float(r["ndcg_10"]) == 1.0 for r in rows if r["mode"] == "bm25")
    headline, by_encoder = cli.summarise(spark, at("results"))
    assert headline.count() == 4 and headline.filter("p95_ms = 0").count() == 4 and by_encoder.count() == 2
    with pytest.raises(ValueError):
        cli.capped((5, 9), 4)
