"""The library's own queries over the shared tables, and the SQL that gives the same results.

Documents are ``documents``, queries ``benchmark``, judgements say which documents hold a passage, and for vectors
which share a label; a document and the vector of the same number belong together, as do a passage and its.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekspark.functions import text as T
from seekspark.operators import binary, corpus, fusion, ivf, lexical, metrics, models, vector
from seekspark.plans import pipelines
from seekspark.plans.config import Config, HybridConfig, VectorConfig
from seekspark.sources import tables as S
from seekspark.sources.scratch import once

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
Q = Callable[[SparkSession, str], DataFrame]

#: Lists, their training rounds, and probes of the queries over inverted lists.
NLIST, ROUNDS, NPROBE, DIM, CHUNK = 8, 2, 3, 64, 2


def query(sql: str | None = None) -> Callable[[Q], Q]:
    def add(f: Q) -> Q:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- inputs ----


def seeds(s: SparkSession, d: str) -> DataFrame:
    """(doc_id, title, text, is_seed): documents of the first source are seeds."""
    rows = S.load(s, d, "documents")
    return rows.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit("").alias("title"), F.coalesce("text", F.lit("")).alias("text"), (F.col("source") == "src0").alias("is_seed"))


def passages(s: SparkSession, d: str) -> DataFrame:
    """Judgements: documents that hold a passage."""
    pairs = corpus.holding(S.documents(s, d), S.queries(s, d))
    return pairs.select("query_id", "doc_id", F.lit(1).alias("rel"))


def vector_queries(s: SparkSession, d: str) -> DataFrame:
    """Every vector whose id is divisible by 50."""
    rows = S.load(s, d, "embeddings").filter("vec_id % 50 = 0")
    return rows.select(F.col("vec_id").cast("string").alias("query_id"), F.col("embedding").alias("vector"))


def passage_vectors(s: SparkSession, d: str) -> DataFrame:
    return S.queries(s, d).select("query_id").join(S.vectors(s, d).withColumnRenamed("doc_id", "query_id"), "query_id")


def label_qrels(s: SparkSession, d: str) -> DataFrame:
    e = S.load(s, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "vec_id", "label")
    few = e.filter("vec_id % 50 = 0").select(F.col("id").alias("query_id"), "label")
    return few.join(e, "label").filter("query_id <> id").select("query_id", F.col("id").alias("doc_id"), F.lit(1).alias("rel"))


def bm25_index(s: SparkSession, d: str) -> lexical.Bm25:
    """The documents' index, made once a session."""
    return once(s, "bm25", S.load(s, d, "documents"), lambda path: lexical.Bm25.fit(S.documents(s, d), path=path))


def bm25_run(s: SparkSession, d: str, k: int, method: str = "lucene") -> DataFrame:
    return bm25_index(s, d).weighing(method).search(S.queries(s, d), k)


def dense_run(s: SparkSession, d: str, k: int) -> DataFrame:
    return vector.exact_topk(S.vectors(s, d), passage_vectors(s, d), k)


# ---- SQL fragments ----

_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
_TOK = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]{{2,}}')"
_WORDS = f"""
    words AS (SELECT doc_id, term FROM (
        SELECT CAST(doc_id AS VARCHAR) AS doc_id, unnest({_TOK.format("coalesce(text, '')")}) AS term FROM documents) WHERE term NOT IN ({_STOP})),
    bag AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
    lens AS (SELECT CAST(d.doc_id AS VARCHAR) AS doc_id, coalesce(n, 0) AS dl FROM documents d
        LEFT JOIN (SELECT doc_id, count(*) AS n FROM words GROUP BY 1) w ON CAST(d.doc_id AS VARCHAR) = w.doc_id),
    totals AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lens),
    dfs AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM bag GROUP BY 1)"""
_WEIGHTS = {
    "lucene": "ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf / (tf + 0.9::DOUBLE * l))",
    "atire": "ln(n / df) * (tf * 1.9::DOUBLE / (tf + 0.9::DOUBLE * l))",
    "bm25l": "ln((n + 1) / (df + 0.5)) * (1.9::DOUBLE * (tf / l + 0.5) / (0.9::DOUBLE + tf / l + 0.5))",
}


def _bm25_sql(method: str, k: int) -> str:
    return f"""{_WORDS},
    asked AS (SELECT query_id, term, count(*) AS qtf FROM (
        SELECT CAST(item_id AS VARCHAR) AS query_id, unnest({_TOK.format("coalesce(text, '')")}) AS term FROM benchmark) GROUP BY ALL),
    parts AS (SELECT query_id, b.doc_id, qtf, CAST(tf AS DOUBLE) AS tf, CAST(df AS DOUBLE) AS df, CAST(n AS DOUBLE) AS n, 0.6::DOUBLE + 0.4::DOUBLE * dl / avgdl AS l
        FROM asked JOIN bag b USING (term) JOIN dfs USING (term) JOIN lens ON lens.doc_id = b.doc_id, totals),
    bm25_all AS (SELECT query_id, doc_id, round(sum(qtf * ({_WEIGHTS[method]})), 6) AS score FROM parts GROUP BY 1, 2),
    bm25 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm25_all QUALIFY rank <= {k})"""


_DOT = "list_inner_product(a.vector::DOUBLE[], b.vector::DOUBLE[])"
_VECS = """
    vecs AS (SELECT CAST(vec_id AS VARCHAR) AS doc_id, embedding AS vector, label FROM embeddings)"""


def _dense_sql(k: int, who: str, name: str = "dense", score: str = _DOT) -> str:
    return f"""
    {name}_q AS (SELECT doc_id AS query_id, vector FROM vecs WHERE doc_id IN ({who})),
    {name} AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
        SELECT query_id, doc_id, {score} AS score FROM {name}_q a, vecs b) QUALIFY rank <= {k})"""


_FEW = "SELECT CAST(vec_id AS VARCHAR) FROM embeddings WHERE vec_id % 50 = 0"
_ITEMS = "SELECT CAST(item_id AS VARCHAR) FROM benchmark"
_QRELS = """
    qrels AS (SELECT CAST(item_id AS VARCHAR) AS query_id, CAST(doc_id AS VARCHAR) AS doc_id, 1 AS rel
        FROM benchmark q JOIN documents d ON contains(d.text, q.text))"""
_LABELS = """
    qrels AS (SELECT CAST(a.vec_id AS VARCHAR) AS query_id, CAST(b.vec_id AS VARCHAR) AS doc_id, 1 AS rel
        FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)"""
_HYBRID = f"WITH {_bm25_sql('lucene', 100)}, {_VECS}, {_dense_sql(100, _ITEMS)}"
_FUSED = """
    both_runs AS (SELECT *, 0 AS list FROM bm25 UNION ALL SELECT *, 1 AS list FROM dense)"""


def _metrics_sql(run: str) -> str:
    cut = lambda k: f"sum(CASE WHEN r <= {k} THEN g ELSE 0 END ORDER BY r)"
    return f"""
    ranked AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id DESC) AS r
        FROM {run} WHERE query_id IN (SELECT query_id FROM qrels)),
    hits AS (SELECT ranked.*, coalesce(rel, 0) AS rel, coalesce(rel, 0) / log2(r + 1.0) AS g,
        sum(CASE WHEN rel >= 1 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY r) AS found
        FROM ranked LEFT JOIN qrels USING (query_id, doc_id)),
    got AS (SELECT query_id, sum(g ORDER BY r) AS dcg, {cut(10)} AS dcg_10, {cut(100)} AS dcg_100,
        {", ".join(f"count(*) FILTER (rel >= 1 AND r <= {k}) AS hits_{k}" for k in (5, 10, 100))},
        sum(CASE WHEN rel >= 1 THEN found / r ELSE 0 END ORDER BY r) AS ap, coalesce(1.0::DOUBLE / min(r) FILTER (rel >= 1), 0) AS mrr FROM hits GROUP BY 1),
    ideals AS (SELECT *, rel / log2(r + 1.0) AS g FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, doc_id) AS r FROM qrels)),
    wanted AS (SELECT query_id, sum(g ORDER BY r) AS idcg, {cut(10)} AS idcg_10, {cut(100)} AS idcg_100, count(*) FILTER (rel >= 1) AS num_rel FROM ideals GROUP BY 1),
    per_query AS (SELECT query_id, dcg / idcg AS ndcg, ap / num_rel AS map, mrr, dcg_10 / idcg_10 AS ndcg_10, dcg_100 / idcg_100 AS ndcg_100,
        hits_10 / num_rel AS recall_10, hits_100 / num_rel AS recall_100, hits_5 / 5.0::DOUBLE AS p_5, hits_10 / 10.0::DOUBLE AS p_10, hits_100 / 100.0::DOUBLE AS p_100
        FROM got JOIN wanted USING (query_id))"""


_NAMES = ["ndcg", "map", "mrr", "ndcg_10", "ndcg_100", "recall_10", "recall_100", "p_5", "p_10", "p_100"]
_MEANS = ", ".join(f"coalesce(round(avg(round({m}, 12)), 5), 0) AS {m}" for m in _NAMES) + ", count(*) AS n_queries"


# ---- text and lexical search ----


@query(f"WITH {_WORDS} SELECT doc_id, term, tf FROM bag")
def tokenise_tf(s: SparkSession, d: str) -> DataFrame:
    return lexical.bag_of_words(S.documents(s, d))


@query(f"WITH {_WORDS} SELECT doc_id, dl FROM lens")
def doc_stats(s: SparkSession, d: str) -> DataFrame:
    return lexical.doc_lengths(S.documents(s, d))


@query(f"WITH {_WORDS} SELECT term, df, cf FROM dfs")
def term_stats(s: SparkSession, d: str) -> DataFrame:
    return lexical.term_stats(lexical.bag_of_words(S.documents(s, d)))


@query(f"""SELECT term, count(*) AS n, term IN ({_STOP}) AS stop FROM (
    SELECT unnest({_TOK.format("coalesce(text, '')")}) AS term FROM documents) GROUP BY 1, 3""")
def stopword_filter(s: SparkSession, d: str) -> DataFrame:
    words = S.documents(s, d).select(F.explode(T.tokens(F.col("text"), None)).alias("term"))
    return words.groupBy("term", F.col("term").isin(T.STOPWORDS).alias("stop")).agg(F.count("*").alias("n"))


def _bm25_query(name: str, method: str) -> None:
    def run(s: SparkSession, d: str) -> DataFrame:
        return bm25_run(s, d, 10, method).select("query_id", "doc_id", "score", "rank")

    run.__name__ = name
    query(f"WITH {_bm25_sql(method, 10)} SELECT query_id, doc_id, score, rank FROM bm25")(run)


_bm25_query("bm25_topk", "lucene")
_bm25_query("bm25_atire", "atire")
_bm25_query("bm25_l", "bm25l")


@query(f"WITH {_QRELS} SELECT query_id, doc_id, rel FROM qrels")
def qrels_passages(s: SparkSession, d: str) -> DataFrame:
    return passages(s, d)


@query("""SELECT CAST(page_id AS VARCHAR) AS doc_id, sha256(concat(coalesce(url, ''), chr(10), coalesce(html, ''))) AS h,
    length(concat_ws(chr(10), nullif(trim(coalesce(url, '')), ''), nullif(trim(coalesce(html, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), ''))) AS n FROM pages""")
def body_and_hash(s: SparkSession, d: str) -> DataFrame:
    docs = S.documents_from(S.load(s, d, "pages"), "page_id", "url", "html")
    title, text = F.col("title"), F.col("text")
    return docs.select("doc_id", T.text_hash(title, text).alias("h"), F.length(T.body(title, text)).cast("long").alias("n"))


# ---- vectors ----


@query(f"WITH {_VECS}, {_dense_sql(10, _FEW)} SELECT query_id, doc_id, score, rank FROM dense")
def exact_vector_topk(s: SparkSession, d: str) -> DataFrame:
    return vector.exact_topk(S.vectors(s, d), vector_queries(s, d), 10)


@query(f"WITH {_VECS}, {_dense_sql(10, _FEW)} SELECT query_id, doc_id, round(score, 9) AS score, rank FROM dense")
def block_vector_topk(s: SparkSession, d: str) -> DataFrame:
    return vector.block_topk(S.vectors(s, d), vector_queries(s, d), 10).withColumn("score", F.round("score", 9))


_L2 = "-list_sum(list_transform(list_zip(a.vector::DOUBLE[], b.vector::DOUBLE[]), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


@query(f"WITH {_VECS}, {_dense_sql(10, _FEW, 'dense', _L2)} SELECT query_id, doc_id, round(score, 9) + 0.0 AS score, rank FROM dense")
def vector_l2_topk(s: SparkSession, d: str) -> DataFrame:
    run = vector.exact_topk(S.vectors(s, d), vector_queries(s, d), 10, "l2")
    return run.withColumn("score", F.round("score", 9) + 0.0)


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def vector_ids_missing(s: SparkSession, d: str) -> DataFrame:
    return S.missing_vectors(S.vectors(s, d), S.documents(s, d))


def coarse(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(centroids, lists) from the vectors of the smallest ids and a fixed number of rounds, made once a session and
    kept in files by list, of which a search reads those that it probes."""

    def make(path: str) -> tuple[DataFrame, DataFrame]:
        v = S.vectors(s, d)
        centroids = ivf.lloyd(v, ivf.first_centroids(v, NLIST), ROUNDS, DIM)
        ivf.write_lists(ivf.assign(v, centroids), path)
        return centroids, s.read.parquet(path)

    return once(s, "lists", S.load(s, d, "embeddings"), make)


def _coarse_sql() -> str:
    l2 = "list_sum(list_transform(list_zip(v.vector::DOUBLE[], c.centroid), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    near = lambda c: f"SELECT doc_id, vector, arg_min(list_id, (d, list_id)) AS list_id FROM (SELECT doc_id, vector, list_id, {l2} AS d FROM vecs v, {c} c) GROUP BY 1, 2"
    out = f"{_VECS}, c0 AS (SELECT CAST(row_number() OVER (ORDER BY doc_id) - 1 AS INTEGER) AS list_id, vector::DOUBLE[] AS centroid FROM vecs ORDER BY doc_id LIMIT {NLIST})"
    for i in range(ROUNDS):
        out += f""", a{i} AS ({near(f"c{i}")}),
        m{i} AS (SELECT list_id, list(x ORDER BY i) AS mean FROM (SELECT list_id, i, round(avg(x), 9) AS x FROM (
            SELECT list_id, unnest(vector::DOUBLE[]) AS x, unnest(range({DIM})) AS i FROM a{i}) GROUP BY 1, 2) GROUP BY 1),
        c{i + 1} AS (SELECT list_id, coalesce(mean, centroid) AS centroid FROM c{i} LEFT JOIN m{i} USING (list_id))"""
    return f"{out}, cs AS (SELECT * FROM c{ROUNDS}), lists AS ({near('cs')})"


_PROBES = """
    askers AS (SELECT doc_id AS query_id, vector FROM vecs WHERE doc_id IN ({who})),
    probes AS (SELECT query_id, vector, list_id, row_number() OVER (PARTITION BY query_id ORDER BY
        list_sum(list_transform(list_zip(vector::DOUBLE[], centroid), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), list_id) AS probe FROM askers, cs)""".format(who=_FEW)


@query(f"WITH {_coarse_sql()} SELECT doc_id, list_id FROM lists")
def ivf_assign(s: SparkSession, d: str) -> DataFrame:
    return coarse(s, d)[1].select("doc_id", "list_id")


@query(f"""WITH {_coarse_sql()}, {_PROBES}
    SELECT query_id, doc_id, {_DOT} AS score, row_number() OVER (PARTITION BY query_id ORDER BY {_DOT} DESC, doc_id) AS rank
    FROM probes a JOIN lists b USING (list_id) WHERE probe <= {NPROBE} QUALIFY rank <= 10""")
def ivf_search(s: SparkSession, d: str) -> DataFrame:
    centroids, lists = coarse(s, d)
    return ivf.ivf_search(lists, centroids, vector_queries(s, d), 10, NPROBE)


@query(f"""WITH {_coarse_sql()}, {_PROBES},
    grid AS (SELECT unnest([1, 2, 4]) AS nprobe)
    SELECT nprobe, query_id, doc_id, {_DOT} AS score, row_number() OVER (PARTITION BY nprobe, query_id ORDER BY {_DOT} DESC, doc_id) AS rank
    FROM probes a JOIN lists b USING (list_id) JOIN grid ON probe <= nprobe QUALIFY rank <= 10""")
def nprobe_sweep(s: SparkSession, d: str) -> DataFrame:
    centroids, lists = coarse(s, d)
    return ivf.nprobe_sweep(lists, centroids, vector_queries(s, d), 10, [1, 2, 4])


_CUTS = f"""
    cuts AS (SELECT list(t ORDER BY i) AS ts FROM (SELECT i // {CHUNK} AS i, round(avg(x), 9) AS t FROM (
        SELECT unnest(vector::DOUBLE[]) AS x, unnest(range({DIM})) AS i FROM vecs) GROUP BY 1))"""


def _word(vec: str, w: int) -> str:
    return "(" + " + ".join(f"CASE WHEN {vec}[{i + 1}]::DOUBLE > ts[{i // CHUNK + 1}] THEN {1 << (i - w)}::BIGINT ELSE 0 END" for i in range(w, w + 32)) + ")"


@query(f"WITH {_VECS}, {_CUTS} SELECT unnest(range(len(ts))) AS chunk, unnest(ts) AS threshold FROM cuts")
def bbq_thresholds(s: SparkSession, d: str) -> DataFrame:
    cuts = binary.thresholds(S.vectors(s, d), CHUNK, DIM)
    return s.createDataFrame([(i, t) for i, t in enumerate(cuts)], "chunk long, threshold double")


def lists_of_codes(s: SparkSession, d: str) -> binary.BinaryLists:
    """The lists with codes, made once a session and kept in files."""

    def make(path: str) -> binary.BinaryLists:
        binary.BinaryLists.fit(S.vectors(s, d), DIM, DIM // CHUNK, centroids=coarse(s, d)[0]).save(path)
        return binary.BinaryLists.load(s, path)

    return once(s, "codes", S.load(s, d, "embeddings"), make)


@query(f"WITH {_VECS}, {_CUTS} SELECT doc_id, {_word('vector', 0)} AS w0, {_word('vector', 32)} AS w1 FROM vecs, cuts")
def bbq_codes(s: SparkSession, d: str) -> DataFrame:
    return lists_of_codes(s, d).rows.select("doc_id", F.col("code")[0].alias("w0"), F.col("code")[1].alias("w1"))


_BBQ = f"""WITH {_coarse_sql()}, {_CUTS}, {_PROBES},
    coded AS (SELECT doc_id, vector, list_id, {_word("vector", 0)} AS w0, {_word("vector", 32)} AS w1 FROM lists, cuts),
    wanted AS (SELECT query_id, vector, list_id, probe, {_word("vector", 0)} AS q0, {_word("vector", 32)} AS q1 FROM probes, cuts WHERE probe <= {NPROBE}),
    pairs AS (SELECT query_id, doc_id, b.vector, a.vector AS q, probe, bit_count(xor(w0, q0)) + bit_count(xor(w1, q1)) AS bits FROM wanted a JOIN coded b USING (list_id))"""


@query(f"""{_BBQ} SELECT query_id, doc_id, -CAST(bits AS DOUBLE) + 0.0 AS score, row_number() OVER (PARTITION BY query_id ORDER BY bits, probe, doc_id) AS rank
    FROM pairs QUALIFY rank <= 10""")
def bbq_hamming(s: SparkSession, d: str) -> DataFrame:
    return lists_of_codes(s, d).search(vector_queries(s, d), 10, NPROBE, rescore=False).withColumn("score", F.col("score") + 0.0)


@query(f"""{_BBQ}, best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bits, probe, doc_id) AS r FROM pairs QUALIFY r <= 40),
    exact AS (SELECT query_id, doc_id, list_inner_product(vector::DOUBLE[], q::DOUBLE[]) AS score FROM best)
    SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM exact QUALIFY rank <= 10""")
def bbq_search(s: SparkSession, d: str) -> DataFrame:
    return lists_of_codes(s, d).search(vector_queries(s, d), 10, NPROBE, 4)


@query()
def pq_search(s: SparkSession, d: str) -> DataFrame:
    return ivf.ProductIndex.fit(S.vectors(s, d), NLIST, 32).search(vector_queries(s, d), 10, 4)


# ---- fusion, reranking ----


@query(f"""{_HYBRID}, {_FUSED}
    SELECT query_id, doc_id, round(score, 12) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
    FROM (SELECT query_id, doc_id, sum(1.0::DOUBLE / (60 + rank) ORDER BY list) AS score FROM both_runs GROUP BY 1, 2) QUALIFY rank <= 10""")
def rrf_fuse(s: SparkSession, d: str) -> DataFrame:
    return fusion.rrf([bm25_run(s, d, 100), dense_run(s, d, 100)], 10).withColumn("score", F.round("score", 12))


@query(f"""{_HYBRID}, {_FUSED}
    SELECT query_id, doc_id, round(score, 12) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
    FROM (SELECT query_id, doc_id, sum((CASE list WHEN 0 THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END) / (60 + rank) ORDER BY list) AS score FROM both_runs GROUP BY 1, 2) QUALIFY rank <= 10""")
def rrf_weighted(s: SparkSession, d: str) -> DataFrame:
    return fusion.rrf([bm25_run(s, d, 100), dense_run(s, d, 100)], 10, weights=[0.7, 0.3]).withColumn("score", F.round("score", 12))


_GRID = "grid AS (SELECT rrf_k, w, wa, wb FROM (SELECT unnest([10, 30, 60, 100, 200]) AS rrf_k), (VALUES (0, 1.0::DOUBLE, 1.0::DOUBLE), (1, 0.5, 0.5), (2, 0.7, 0.3)) g(w, wa, wb))"


@query(f"""{_HYBRID}, {_FUSED}, {_GRID}
    SELECT rrf_k, w, query_id, doc_id, round(score, 12) AS score, row_number() OVER (PARTITION BY rrf_k, w, query_id ORDER BY score DESC, doc_id) AS rank
    FROM (SELECT rrf_k, w, query_id, doc_id, sum((CASE list WHEN 0 THEN wa ELSE wb END) / (rrf_k + rank) ORDER BY list) AS score FROM both_runs, grid GROUP BY 1, 2, 3, 4) QUALIFY rank <= 10""")
def rrf_sweep(s: SparkSession, d: str) -> DataFrame:
    h = HybridConfig()
    run = fusion.rrf_sweep([bm25_run(s, d, 100), dense_run(s, d, 100)], 10, list(h.rrf_k), list(h.weights))
    return run.withColumn("score", F.round("score", 12))


@query(f"""{_HYBRID}, {_FUSED}, normed AS (SELECT *, CASE WHEN max(score) OVER w > min(score) OVER w
        THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 0 END AS x FROM both_runs WINDOW w AS (PARTITION BY query_id, list))
    SELECT query_id, doc_id, round(score, 12) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
    FROM (SELECT query_id, doc_id, sum((CASE list WHEN 0 THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END) * x ORDER BY list) AS score FROM normed GROUP BY 1, 2) QUALIFY rank <= 10""")
def weighted_fuse(s: SparkSession, d: str) -> DataFrame:
    return fusion.weighted([bm25_run(s, d, 100), dense_run(s, d, 100)], 10, [0.7, 0.3]).withColumn("score", F.round("score", 12))


_RRF = """
    rrf_all AS (SELECT query_id, doc_id, sum(1.0::DOUBLE / (60 + rank) ORDER BY list) AS score FROM both_runs GROUP BY 1, 2),
    rrf AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM rrf_all QUALIFY rank <= 100)"""
_TSET = f"list_distinct(list_filter({_TOK}, lambda w: w NOT IN ({_STOP})))"
_RERANK = f"""
    reranked AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
        SELECT query_id, doc_id, CASE WHEN len(qs) > 0 THEN len(list_intersect(qs, ds)) / len(qs) ELSE 0.0 END AS score FROM (
            SELECT r.query_id, r.doc_id, {_TSET.format("q.text")} AS qs, {_TSET.format("d.text")} AS ds FROM rrf r
            JOIN benchmark q ON r.query_id = CAST(q.item_id AS VARCHAR) JOIN documents d ON r.doc_id = CAST(d.doc_id AS VARCHAR) WHERE rank <= 50)))"""


@query(f"{_HYBRID}, {_FUSED}, {_RRF}, {_RERANK} SELECT query_id, doc_id, score, rank FROM reranked WHERE rank <= 10")
def rerank_overlap(s: SparkSession, d: str) -> DataFrame:
    fused = fusion.rrf([bm25_run(s, d, 100), dense_run(s, d, 100)], 100)
    return models.rerank(fused, S.queries(s, d), S.documents(s, d), 50, 10)


def _counts_sql(table: str, key: str) -> str:
    return f"""(SELECT {key}, d, sum(s) AS x FROM (SELECT {key}, h % 64 AS d, CASE WHEN (h >> 8) & 1 = 1 THEN 1 ELSE -1 END AS s FROM (
        SELECT CAST({key} AS VARCHAR) AS {key}, CAST('0x' || substr(md5(unnest({_TOK.format("coalesce(text, '')")})), 1, 8) AS BIGINT) AS h FROM {table})) GROUP BY 1, 2)"""


@query(f"""WITH scored AS (SELECT q.query_id, d.doc_id, coalesce(sum(a.x * b.x), 0)::DOUBLE AS score
        FROM (SELECT CAST(item_id AS VARCHAR) AS query_id FROM benchmark) q CROSS JOIN (SELECT CAST(doc_id AS VARCHAR) AS doc_id FROM documents) d
        LEFT JOIN {_counts_sql("benchmark", "item_id")} a ON a.item_id = q.query_id LEFT JOIN {_counts_sql("documents", "doc_id")} b ON b.doc_id = d.doc_id AND a.d = b.d GROUP BY 1, 2)
    SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored QUALIFY rank <= 10""")
def hash_embed_topk(s: SparkSession, d: str) -> DataFrame:
    docs, q = S.documents(s, d), S.queries(s, d)
    v = models.encode(docs, "doc_id", F.col("text"), "hash-counts")
    return vector.block_topk(v, models.encode(q, "query_id", F.col("text"), "hash-counts"), 10)


# ---- evaluation ----


@query(f"WITH {_bm25_sql('lucene', 100)}, {_QRELS}, {_metrics_sql('bm25')} SELECT query_id, {', '.join(f'round({m}, 9) AS {m}' for m in _NAMES)} FROM per_query")
def eval_per_query(s: SparkSession, d: str) -> DataFrame:
    each = metrics.per_query(bm25_run(s, d, 100), passages(s, d))
    return each.select("query_id", *[F.round(m, 9).alias(m) for m in _NAMES])


@query(f"WITH {_bm25_sql('lucene', 100)}, {_QRELS}, {_metrics_sql('bm25')} SELECT {_MEANS} FROM per_query")
def eval_metrics(s: SparkSession, d: str) -> DataFrame:
    return metrics.evaluate(bm25_run(s, d, 100), passages(s, d))


@query(f"WITH {_VECS}, {_dense_sql(100, _FEW)}, {_LABELS}, {_metrics_sql('dense')} SELECT {_MEANS} FROM per_query")
def eval_vector_labels(s: SparkSession, d: str) -> DataFrame:
    return metrics.evaluate(vector.exact_topk(S.vectors(s, d), vector_queries(s, d), 100), label_qrels(s, d))


@query(f"""WITH {_bm25_sql('lucene', 100)}, {_QRELS}, {_metrics_sql('bm25')}, m AS (SELECT {_MEANS} FROM per_query)
    SELECT ndcg_10, CASE WHEN n_queries = 0 THEN 'pass' WHEN ndcg_10 < 0.62 THEN 'fail' WHEN abs(ndcg_10 - 0.6789) > 0.03 THEN 'warn' ELSE 'pass' END AS status FROM m""")
def preflight(s: SparkSession, d: str) -> DataFrame:
    p = Config().preflight
    return metrics.preflight(bm25_run(s, d, 100), passages(s, d), p.target, p.tolerance, p.least)


@query("""SELECT event_type, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95, round(quantile_cont(value, 0.99), 4) AS p99,
    round(quantile_cont(value, 0.999), 4) AS p999, round(avg(value), 4) AS mean, count(value) AS n FROM events GROUP BY 1""")
def latency_percentiles(s: SparkSession, d: str) -> DataFrame:
    return metrics.latency_stats(S.load(s, d, "events"), "value", ["event_type"])


# ---- corpus preparation ----

_SEEDS = "docs AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, coalesce(text, '') AS text, source = 'src0' AS is_seed FROM documents)"
_EXACT = f"{_SEEDS}, once AS (SELECT *, row_number() OVER (PARTITION BY sha256(chr(10) || text) ORDER BY NOT is_seed, doc_id) AS r FROM docs QUALIFY r = 1)"


@query(f"WITH {_EXACT} SELECT doc_id, is_seed FROM once")
def dedup_exact(s: SparkSession, d: str) -> DataFrame:
    return corpus.dedup_exact(seeds(s, d)).select("doc_id", "is_seed")


@query(f"WITH {_SEEDS} SELECT doc_id FROM docs WHERE NOT is_seed AND sha256(text) NOT IN (SELECT sha256(text) FROM docs WHERE is_seed)")
def dedup_seed_anti(s: SparkSession, d: str) -> DataFrame:
    docs = seeds(s, d).withColumn("h", F.sha2("text", 256))
    return docs.filter("not is_seed").join(docs.filter("is_seed").select("h").distinct(), "h", "left_anti").select("doc_id")


def _minhash_sql() -> str:
    pairs = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(corpus.multipliers()[: corpus.BANDS * corpus.ROWS]))
    return f"""{_EXACT}, perms(i, a, b) AS (VALUES {pairs}),
    toks AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '\\s+')) AS t FROM once),
    hashed AS (SELECT doc_id, CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) AS h FROM toks WHERE t <> ''),
    minima AS (SELECT doc_id, i, min((a::BIGINT * h + b) % {corpus.PRIME}) AS m FROM hashed, perms GROUP BY 1, 2),
    bands AS (SELECT doc_id, i // {corpus.ROWS} AS band, string_agg(CAST(m AS VARCHAR), ',' ORDER BY i) AS key FROM minima GROUP BY 1, 2),
    near AS (SELECT DISTINCT b.doc_id FROM bands b JOIN once o ON b.doc_id = o.doc_id AND NOT o.is_seed
        WHERE (band, key) IN (SELECT (band, key) FROM bands s JOIN once o ON s.doc_id = o.doc_id AND o.is_seed))"""


@query(f"WITH {_minhash_sql()} SELECT doc_id, is_seed FROM once WHERE doc_id NOT IN (SELECT doc_id FROM near)")
def dedup_minhash(s: SparkSession, d: str) -> DataFrame:
    return corpus.deduplicate(seeds(s, d)).select("doc_id", "is_seed")


def _scales_sql(order: str) -> str:
    return f"""WITH {_SEEDS}, placed AS (SELECT doc_id, row_number() OVER (ORDER BY {order} md5('42:' || doc_id), doc_id) AS pos FROM docs)
    SELECT scale, doc_id, pos FROM placed JOIN (SELECT unnest([50, 200, 500]) AS scale) ON pos <= scale"""


@query(_scales_sql("NOT is_seed,"))
def corpus_scales(s: SparkSession, d: str) -> DataFrame:
    return corpus.nested_scales(seeds(s, d), [50, 200, 500])


@query(_scales_sql(""))
def corpus_scales_plain(s: SparkSession, d: str) -> DataFrame:
    return corpus.nested_scales(seeds(s, d), [50, 200, 500], retain_seed=False)


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id FROM documents ORDER BY md5('7:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 100")
def seeded_sample(s: SparkSession, d: str) -> DataFrame:
    return S.seeded_sample(S.documents(s, d), 100, 7).select("doc_id")


@query("""SELECT source, count(*) AS n FROM (SELECT 'documents' AS source FROM documents UNION ALL SELECT 'pages' FROM pages UNION ALL SELECT 'conversations' FROM conversations) GROUP BY 1""")
def distractor_counts(s: SparkSession, d: str) -> DataFrame:
    talks = S.load(s, d, "conversations").withColumn("id", F.concat_ws("-", "conv_id", "turn"))
    pools = {"documents": S.documents(s, d), "pages": S.documents_from(S.load(s, d, "pages"), "page_id", "url", "html"), "conversations": S.documents_from(talks, "id", None)}
    return S.distractor_pool(pools)[1]


@query(f"""SELECT lang, count(*) AS n_docs, CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS n_bytes,
    CAST(sum(len({_TOK.format("coalesce(text, '')")})) AS BIGINT) AS n_tokens FROM documents GROUP BY 1""")
def throughput_counts(s: SparkSession, d: str) -> DataFrame:
    docs = S.load(s, d, "documents").select(F.coalesce("text", F.lit("")).alias("text"), "lang")
    return models.throughput(docs, group=["lang"])


@query("""WITH n AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS n FROM documents),
    o AS (SELECT *, sum(n) OVER (ORDER BY substr(md5(doc_id), 1, 3), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f FROM n)
    SELECT doc_id, CAST(coalesce(f, 0) AS BIGINT) AS first, CAST(n AS BIGINT) AS n FROM o""")
def token_offsets(s: SparkSession, d: str) -> DataFrame:
    from seekspark.sources.store import token_table

    docs = S.documents(s, d).select("doc_id", T.tokens(F.col("text"), None).alias("tokens"))
    return token_table(docs).select("doc_id", "first", "n")


@query("""SELECT count(*) AS n, concat_ws('-', CAST(sum(CAST('0x' || substr(h, 1, 12) AS BIGINT)) AS VARCHAR), CAST(sum(CAST('0x' || substr(h, 13, 12) AS BIGINT)) AS VARCHAR)) AS digest
    FROM (SELECT sha256(CAST(doc_id AS VARCHAR) || chr(1) || '' || chr(1) || coalesce(text, '')) AS h FROM documents)""")
def manifest_digest(s: SparkSession, d: str) -> DataFrame:
    from seekspark.sources.store import corpus_digest

    return corpus_digest(S.documents(s, d))


def _bpe_sql(merges: int) -> str:
    """Symbols stand between signs 1 and 2; each round counts neighbours, takes the most frequent and joins them."""
    out = f"""WITH w0 AS MATERIALIZED (SELECT count(*) AS n, chr(1) || array_to_string(string_split(w, ''), chr(2) || chr(1)) || chr(2) AS s FROM (
        SELECT unnest({_TOK.format("coalesce(text, '')")}) AS w FROM documents) GROUP BY w)"""
    for i in range(merges):
        out += f""", p{i} AS (SELECT n, list_transform(string_split(s, chr(2))[:-2], lambda x: x[2:]) AS l FROM w{i}),
        t{i} AS (SELECT n, l[j] AS a, l[j + 1] AS b FROM (SELECT n, l, unnest(range(1, len(l))) AS j FROM p{i})),
        b{i} AS MATERIALIZED (SELECT a, b FROM t{i} GROUP BY 1, 2 ORDER BY sum(n) DESC, a, b LIMIT 1),
        w{i + 1} AS MATERIALIZED (SELECT n, replace(s, chr(1) || a || chr(2) || chr(1) || b || chr(2), chr(1) || a || b || chr(2)) AS s FROM w{i}, b{i})"""
    rows = " UNION ALL ".join(f"SELECT {i} AS i, a AS left, b AS right FROM b{i}" for i in range(merges))
    return f"{out} {rows}"


@query(_bpe_sql(12))
def bpe_merges(s: SparkSession, d: str) -> DataFrame:
    merges = models.train_bpe(S.documents(s, d), 12)
    return s.createDataFrame([(i, a, b) for i, (a, b) in enumerate(merges)], "i int, left string, right string")


@query("""SELECT 'src0:' || CAST(doc_id AS VARCHAR) AS doc_id, length(coalesce(text, '')) AS n FROM documents WHERE source = 'src0'""")
def seed_documents(s: SparkSession, d: str) -> DataFrame:
    rows = S.load(s, d, "documents").filter("source = 'src0'").drop("title").withColumn("title", F.lit(None).cast("string"))
    return S.seed_documents(rows, "src0", "doc_id").select("doc_id", F.length("text").cast("long").alias("n"))


@query("""SELECT CAST(l_suppkey AS VARCHAR) AS query_id, CAST(l_partkey AS VARCHAR) AS doc_id, CAST(arg_max(l_linenumber, l_orderkey * 10 + l_linenumber) AS INTEGER) AS rel
    FROM lineitem GROUP BY 1, 2""")
def qrels_last(s: SparkSession, d: str) -> DataFrame:
    rows = S.load(s, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("query_id"), F.col("l_partkey").cast("string").alias("doc_id"), F.col("l_linenumber").alias("rel"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    return S.qrels_from(rows, F.col("at"))


# ---- modes ----


def inputs(s: SparkSession, d: str) -> pipelines.Inputs:
    return pipelines.Inputs(S.documents(s, d), S.queries(s, d), passages(s, d), S.vectors(s, d), passage_vectors(s, d), 5000, "given", bm25_index(s, d))


_MODE = "SELECT '{0}' AS mode, 5000 AS scale, '{1}' AS encoder, {2}"


@query(f"WITH {_bm25_sql('lucene', 100)}, {_QRELS}, {_metrics_sql('bm25')} {_MODE.format('bm25', 'none', _MEANS)} FROM per_query")
def mode_bm25(s: SparkSession, d: str) -> DataFrame:
    return pipelines.bm25(inputs(s, d), Config())


@query(f"WITH {_VECS}, {_dense_sql(100, _ITEMS)}, {_QRELS}, {_metrics_sql('dense')} {_MODE.format('vector', 'given', _MEANS)}, 0 AS nprobe FROM per_query")
def mode_vector(s: SparkSession, d: str) -> DataFrame:
    return pipelines.dense(inputs(s, d), Config())


_SWEEP = f"""{_HYBRID}, {_FUSED}, {_GRID}, base_qrels AS (SELECT CAST(item_id AS VARCHAR) AS query_id, CAST(doc_id AS VARCHAR) AS doc_id, 1 AS rel
        FROM benchmark q JOIN documents d ON contains(d.text, q.text)),
    qrels AS (SELECT concat_ws('|', rrf_k, w, query_id) AS query_id, doc_id, rel FROM base_qrels, grid),
    swept AS (SELECT concat_ws('|', rrf_k, w, query_id) AS query_id, doc_id, score FROM (
        SELECT rrf_k, w, query_id, doc_id, sum((CASE list WHEN 0 THEN wa ELSE wb END) / (rrf_k + rank) ORDER BY list) AS score FROM both_runs, grid GROUP BY 1, 2, 3, 4)
        QUALIFY row_number() OVER (PARTITION BY rrf_k, w, query_id ORDER BY score DESC, doc_id) <= 100)"""


@query(f"""{_SWEEP}, {_metrics_sql('swept')} {_MODE.format('hybrid_rrf', 'given', _MEANS)},
    CAST(split_part(query_id, '|', 1) AS INTEGER) AS rrf_k, CAST(split_part(query_id, '|', 2) AS INTEGER) AS w FROM per_query GROUP BY rrf_k, w""")
def mode_hybrid_rrf(s: SparkSession, d: str) -> DataFrame:
    return pipelines.hybrid_rrf(inputs(s, d), Config())


@query(f"{_HYBRID}, {_FUSED}, {_RRF}, {_RERANK}, {_QRELS}, {_metrics_sql('reranked')} {_MODE.format('hybrid_rerank', 'given', _MEANS)}, 'overlap' AS reranker FROM per_query")
def mode_hybrid_rerank(s: SparkSession, d: str) -> DataFrame:
    return pipelines.hybrid_rerank(inputs(s, d), Config())


def bbq_config(nprobe: tuple[int, ...]) -> Config:
    return Config(vector=VectorConfig(nprobe=nprobe, nlist={5000: NLIST}, coarse="lloyd", rounds=ROUNDS))


def _bbq_sql(nprobe: tuple[int, ...]) -> str:
    """Binary search of the passages' vectors for each nprobe: near (nprobe, query_id, doc_id, score, rank)."""
    return f"""{_coarse_sql()}, {_CUTS}, {_PROBES.replace(_FEW, _ITEMS)},
    tried AS (SELECT unnest([{", ".join(map(str, nprobe))}]) AS nprobe),
    coded AS (SELECT doc_id, vector, list_id, {_word("vector", 0)} AS w0, {_word("vector", 32)} AS w1 FROM lists, cuts),
    coded_q AS (SELECT query_id, vector, list_id, probe, {_word("vector", 0)} AS q0, {_word("vector", 32)} AS q1 FROM probes, cuts),
    pairs AS (SELECT nprobe, query_id, doc_id, b.vector, a.vector AS q, probe, bit_count(xor(w0, q0)) + bit_count(xor(w1, q1)) AS bits
        FROM coded_q a JOIN coded b USING (list_id) JOIN tried ON probe <= nprobe),
    best AS (SELECT *, row_number() OVER (PARTITION BY nprobe, query_id ORDER BY bits, probe, doc_id) AS r FROM pairs QUALIFY r <= 400),
    near AS (SELECT nprobe, query_id, doc_id, score, row_number() OVER (PARTITION BY nprobe, query_id ORDER BY score DESC, doc_id) AS rank FROM (
        SELECT nprobe, query_id, doc_id, list_inner_product(vector::DOUBLE[], q::DOUBLE[]) AS score FROM best) QUALIFY rank <= 100)"""


_BASE_QRELS = """base_qrels AS (SELECT CAST(item_id AS VARCHAR) AS query_id, CAST(doc_id AS VARCHAR) AS doc_id, 1 AS rel
        FROM benchmark q JOIN documents d ON contains(d.text, q.text))"""


@query(f"""WITH {_bbq_sql((4, 16))}, {_BASE_QRELS}, places AS (SELECT unnest(['ram', 'disk']) AS storage),
    swept AS (SELECT concat_ws('|', nprobe, storage, query_id) AS query_id, doc_id, score FROM near, places),
    qrels AS (SELECT concat_ws('|', nprobe, storage, query_id) AS query_id, doc_id, rel FROM base_qrels, tried, places), {_metrics_sql('swept')}
    {_MODE.format('diskbbq', 'given', _MEANS)}, CAST(split_part(query_id, '|', 1) AS INTEGER) AS nprobe, split_part(query_id, '|', 2) AS storage FROM per_query GROUP BY nprobe, storage""")
def mode_diskbbq(s: SparkSession, d: str) -> DataFrame:
    return pipelines.diskbbq(inputs(s, d), bbq_config((4, 16)))


@query(f"""WITH {_bm25_sql('lucene', 100)}, {_bbq_sql((4,))}, {_GRID}, {_BASE_QRELS},
    both_runs AS (SELECT *, 0 AS list FROM bm25 UNION ALL SELECT query_id, doc_id, score, rank, 1 AS list FROM near),
    qrels AS (SELECT concat_ws('|', rrf_k, w, query_id) AS query_id, doc_id, rel FROM base_qrels, grid),
    swept AS (SELECT concat_ws('|', rrf_k, w, query_id) AS query_id, doc_id, score FROM (
        SELECT rrf_k, w, query_id, doc_id, sum((CASE list WHEN 0 THEN wa ELSE wb END) / (rrf_k + rank) ORDER BY list) AS score FROM both_runs, grid GROUP BY 1, 2, 3, 4)
        QUALIFY row_number() OVER (PARTITION BY rrf_k, w, query_id ORDER BY score DESC, doc_id) <= 100), {_metrics_sql('swept')}
    {_MODE.format('hybrid_bbq', 'given', _MEANS)},
    CAST(split_part(query_id, '|', 1) AS INTEGER) AS rrf_k, CAST(split_part(query_id, '|', 2) AS INTEGER) AS w FROM per_query GROUP BY rrf_k, w""")
def mode_hybrid_bbq(s: SparkSession, d: str) -> DataFrame:
    return pipelines.hybrid_bbq(inputs(s, d), bbq_config((4,)))


_RESULTS = "results AS (SELECT l_orderkey % 3 AS scale, l_returnflag AS mode, l_linestatus AS encoder, l_orderkey * 10 + l_linenumber AS ordinal, l_discount AS ndcg_10 FROM lineitem)"


def result_rows(s: SparkSession, d: str) -> DataFrame:
    """Rows like those of a benchmark, out of a table that has the columns for it."""
    return S.load(s, d, "lineitem").select((F.col("l_orderkey") % 3).alias("scale"), F.col("l_returnflag").alias("mode"), F.col("l_linestatus").alias("encoder"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"), F.col("l_discount").alias("ndcg_10"))


@query(f"WITH {_RESULTS} SELECT * FROM results QUALIFY row_number() OVER (PARTITION BY scale, mode, encoder ORDER BY ordinal DESC) = 1")
def summarise_last(s: SparkSession, d: str) -> DataFrame:
    return pipelines.summarise(result_rows(s, d))


@query(f"WITH {_RESULTS} SELECT * FROM results QUALIFY row_number() OVER (PARTITION BY scale, mode, encoder ORDER BY ndcg_10 DESC, ordinal DESC) = 1")
def summarise_best(s: SparkSession, d: str) -> DataFrame:
    return pipelines.summarise(result_rows(s, d), "best")


@query(f"WITH {_RESULTS}, f AS (SELECT encoder, scale, mode, ndcg_10 FROM results) SELECT encoder, count(*) AS n, max(scale) AS last_scale, round(sum(ndcg_10), 4) AS total FROM f GROUP BY 1")
def summarise_by_encoder(s: SparkSession, d: str) -> DataFrame:
    points = pipelines.by_encoder(result_rows(s, d))
    total = F.aggregate("points", F.lit(0.0), lambda a, p: a + p["ndcg_10"])
    return points.select("encoder", F.size("points").cast("long").alias("n"), F.element_at("points", -1)["scale"].alias("last_scale"), F.round(total, 4).alias("total"))
