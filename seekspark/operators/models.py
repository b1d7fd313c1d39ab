"""Encoders, rerankers and tokenizers: registries of plug-ins, stand-ins that need no model, and their plans."""

from __future__ import annotations

import os
import sys
import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seekspark.functions import text as T
from seekspark.operators.fusion import top_k

#: A model adapter: () -> function of a list of texts to an array (encoder) or of two lists to scores (reranker).
#: It is called once a worker, so a model is loaded once.
ENCODERS: dict[str, tuple[int, Callable]] = {}
RERANKERS: dict[str, Callable] = {}


def register_encoder(slug: str, dim: int) -> Callable:
    def add(make: Callable) -> Callable:
        ENCODERS[slug] = (dim, make)
        return make

    return add


def register_reranker(slug: str) -> Callable:
    def add(make: Callable) -> Callable:
        RERANKERS[slug] = make
        return make

    return add


def get_encoder(slug: str) -> tuple[int, Callable]:
    if slug not in ENCODERS:
        raise KeyError(f"no encoder {slug!r}; there are {sorted(ENCODERS)}")
    return ENCODERS[slug]


def get_reranker(slug: str) -> Callable:
    if slug not in RERANKERS:
        raise KeyError(f"no reranker {slug!r}; there are {sorted(RERANKERS)}")
    return RERANKERS[slug]


@dataclass(frozen=True)
class Prefixes:
    """What an encoder's model wants before queries and documents."""

    query: str = ""
    document: str = ""


#: By encoder; others want none (fixed values of the models).
PREFIXES: dict[str, Prefixes] = {"e5-mistral-7b": Prefixes("query: ", "passage: ")}


def prefixes(slug: str) -> Prefixes:
    get_encoder(slug)
    return PREFIXES.get(slug, Prefixes())


def _sentence(model: str, batch: int = 64, max_len: int = 256) -> Callable:
    def make() -> Callable:
        from sentence_transformers import SentenceTransformer

        own = SentenceTransformer(model)
        own.max_seq_length = max_len
        return lambda texts: own.encode(texts, normalize_embeddings=True, batch_size=batch)

    return make


def last_token_pool(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Each row's state at its last token that ``mask`` (1 for tokens) has, of length 1."""
    out = states[np.arange(len(states)), mask.sum(axis=1) - 1].astype(np.float32)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def enough_memory(least_gb: float) -> bool:
    """Whether the machine has that much memory in all; true where it does not say."""
    try:
        return os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES") >= least_gb * 1e9
    except (ValueError, OSError):
        return True


def _last_token(model: str, batch: int = 8, max_len: int = 256, least_gb: float = 16.0) -> Callable:
    def make() -> Callable:
        if not enough_memory(least_gb):
            raise MemoryError(f"{model} needs {least_gb} GB of memory")
        import torch
        from transformers import AutoModel, AutoTokenizer

        torch.set_num_threads(1)  # a task has one core
        tok, own = AutoTokenizer.from_pretrained(model), AutoModel.from_pretrained(model).eval()

        def encode(texts: list[str]) -> np.ndarray:
            out = []
            for at in range(0, len(texts), batch):
                given = tok(texts[at : at + batch], return_tensors="pt", padding=True, truncation=True, max_length=max_len)
                with torch.inference_mode():
                    states = own(**given).last_hidden_state
                out.append(last_token_pool(states.float().numpy(), given["attention_mask"].numpy()))
            return np.concatenate(out)

        return encode

    return make


# Model names are those of their public hubs (fixed values); they need an optional library and local weights.
for _slug, _dim, _model in (
    ("minilm-l6", 384, "sentence-transformers/all-MiniLM-L6-v2"),
    ("bge-small", 384, "BAAI/bge-small-en-v1.5"),
    ("bge-base", 768, "BAAI/bge-base-en-v1.5"),
    ("bge-large", 1024, "BAAI/bge-large-en-v1.5"),
    ("mpnet-base", 768, "sentence-transformers/all-mpnet-base-v2"),
):
    ENCODERS[_slug] = (_dim, _sentence(_model))
ENCODERS["e5-mistral-7b"] = (4096, _last_token("intfloat/e5-mistral-7b-instruct"))


def _cross(model: str, squash: bool = False, max_len: int = 256, batch: int = 32) -> Callable:
    def make() -> Callable:
        from sentence_transformers import CrossEncoder

        own = CrossEncoder(model, max_length=max_len)

        def score(queries: list[str], texts: list[str]) -> np.ndarray:
            s = np.asarray(own.predict(list(zip(queries, texts)), batch_size=batch), float)
            return 1 / (1 + np.exp(-s)) if squash else s

        return score

    return make


def _seq2seq(model: str, max_len: int = 512, batch: int = 8) -> Callable:
    def make() -> Callable:
        import torch
        from transformers import AutoModelForSeq2SeqLM, AutoTokenizer

        tok, own = AutoTokenizer.from_pretrained(model), AutoModelForSeq2SeqLM.from_pretrained(model).eval()
        pair = [tok.encode(w, add_special_tokens=False)[0] for w in ("false", "true")]

        def score(queries: list[str], texts: list[str]) -> np.ndarray:
            asked = [f"Query: {q} Document: {t} Relevant:" for q, t in zip(queries, texts)]
            out = []
            for at in range(0, len(asked), batch):
                given = tok(asked[at : at + batch], return_tensors="pt", padding=True, truncation=True, max_length=max_len)
                start = torch.full((len(given["input_ids"]), 1), own.config.decoder_start_token_id)
                with torch.inference_mode():
                    logits = own(**given, decoder_input_ids=start).logits[:, 0, pair]
                out.append(torch.softmax(logits, 1)[:, 1].numpy())
            return np.concatenate(out or [np.zeros(0)])

        return score

    return make


def usable_reranker(slug: str) -> Callable | None:
    """The reranker's maker, or None (and a line on the error stream) if it cannot be made here."""
    if slug == "overlap":
        return overlap_score
    try:
        make = get_reranker(slug)
        make()
    except Exception as e:  # whatever a plug-in raises, the rest can go on
        print(f"reranker {slug!r} is left out: {e}", file=sys.stderr)
        return None
    return make


RERANKERS |= {
    "encoder": _cross("cross-encoder/ms-marco-MiniLM-L-6-v2"),
    "bge-large": _cross("BAAI/bge-reranker-large", True, 512, 16),
    "bge-base": _cross("BAAI/bge-reranker-base", True, 512, 16),
    "monot5-3b": _seq2seq("castorini/monot5-3b-msmarco"),
}


def _token_counts(texts: list[str]) -> np.ndarray:
    """Signed counts of hashed tokens in 64 places."""
    import hashlib

    import regex

    word = regex.compile(T.TOKEN)
    out = np.zeros((len(texts), 64), np.float32)
    for i, t in enumerate(texts):
        for w, n in Counter(word.findall(t.lower())).items():
            h = int(hashlib.md5(w.encode()).hexdigest()[:8], 16)
            out[i, h % 64] += n if h >> 8 & 1 else -n
    return out


@register_encoder("hash-counts", 64)
def hash_counts() -> Callable:
    """Signed feature hashing of tokens: no model, the same everywhere, and whole numbers."""
    return _token_counts


@register_encoder("hash-embed", 64)
def hash_embed() -> Callable:
    """The same, of length 1."""

    def encode(texts: list[str]) -> np.ndarray:
        out = _token_counts(texts)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return encode


def encode(rows: DataFrame, id_col: str, text: Column, slug: str, prefix: str = "") -> DataFrame:
    """(id, vector) of each row's prefixed text; batches come by Arrow, the model is made once a worker."""
    dim, make = get_encoder(slug)

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for b in batches:
            yield pd.Series(list(np.asarray(model(b.tolist()), np.float32)))

    return rows.select(id_col, run(F.concat(F.lit(prefix), text)).alias("vector"))


def embed_missing(cache, docs: DataFrame, slug: str, revision: str, prefix: str = "") -> DataFrame:
    """All documents' vectors; only those that the cache lacks are encoded, and it then has all."""
    have, lack = cache.get(slug, revision), cache.missing(slug, revision, docs)
    if have is not None and lack.isEmpty():
        return have.join(docs.select("doc_id"), "doc_id", "left_semi")
    new = encode(lack, "doc_id", T.body(F.col("title"), F.col("text")), slug, prefix)
    every = new if have is None else have.unionByName(new)
    every = every.cache()  # it may read the partition that it is about to replace
    every.count()
    cache.put(slug, revision, every)
    every.unpersist()
    return cache.get(slug, revision).join(docs.select("doc_id"), "doc_id", "left_semi")


def overlap_score(query: Column, text: Column) -> Column:
    """The share of the query's different tokens that the text has: a reranker that SQL can express."""
    q, d = F.array_distinct(T.tokens(query)), F.array_distinct(T.tokens(text))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, d)) / F.size(q)).otherwise(0.0)


def rerank(run: DataFrame, queries: DataFrame, docs: DataFrame, pool: int, top: int, slug: str = "overlap", tail: bool = False) -> DataFrame:
    """Score the first ``pool`` documents of each query of ``run`` anew and rank them; candidates beyond the corpus go.

    ``tail``: the rest of ``run`` follows the reranked head in its order, below its lowest score.
    """
    few = run.filter(F.col("rank") <= pool).select("query_id", "doc_id")
    pairs = few.join(queries.select("query_id", F.col("text").alias("_q")), "query_id").join(docs.select("doc_id", T.body(F.col("title"), F.col("text")).alias("_d")), "doc_id")
    if slug == "overlap":
        scored = pairs.select("query_id", "doc_id", overlap_score(F.col("_q"), F.col("_d")).alias("score"))
    else:
        make = get_reranker(slug)

        @F.pandas_udf("double")
        def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            model = make()
            for q, d in batches:
                yield pd.Series(np.asarray(model(q.tolist(), d.tolist()), float))

        scored = pairs.select("query_id", "doc_id", score("_q", "_d").alias("score"))
    if not tail:
        return top_k(scored, top)
    low = F.lit(-1e6)
    rest = run.filter(F.col("rank") > pool).select("query_id", "doc_id", (low - F.col("rank")).alias("score"))
    return top_k(scored.unionByName(rest), top)


def throughput(docs: DataFrame, tokens: Column | None = None, group: list[str] | None = None) -> DataFrame:
    """n_docs, n_bytes and n_tokens, of all or by group."""
    count = F.size(tokens if tokens is not None else T.tokens(F.col("text"), None))
    return docs.groupBy(*(group or [])).agg(F.count("*").alias("n_docs"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("long").alias("n_bytes"), F.coalesce(F.sum(count), F.lit(0)).cast("long").alias("n_tokens"))


def tokenizer_ids(docs: DataFrame, path: str, batch: int = 8192) -> DataFrame:
    """(doc_id, tokens) by a tokenizer file, ``batch`` texts at a time at most."""
    if batch <= 0:
        raise ValueError("batch must be above 0")

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        for b in batches:
            texts = b.fillna("").tolist()
            yield pd.Series([e.ids for at in range(0, len(texts), batch) for e in own.encode_batch(texts[at : at + batch], add_special_tokens=False)])

    return docs.select("doc_id", run("text").alias("tokens"))


def tokenize_jsonl(spark: SparkSession, source: str, path: str, field: str = "text") -> DataFrame:
    """(doc_id, tokens) of the lines of JSON files; doc_id numbers the lines, rising in each file."""
    rows = spark.read.schema(f"`{field}` string").json(source)
    return tokenizer_ids(rows.select(F.monotonically_increasing_id().cast("string").alias("doc_id"), F.col(f"`{field}`").alias("text")), path)


def tokenize_text(spark: SparkSession, source: str, path: str) -> DataFrame:
    """(doc_id, tokens) of the lines of text files."""
    return tokenizer_ids(spark.read.text(source).select(F.monotonically_increasing_id().cast("string").alias("doc_id"), F.col("value").alias("text")), path)


def tokenizer_throughput(docs: DataFrame, path: str, batch: int = 8192) -> DataFrame:
    """One row: doc_count, total_tokens, bytes_processed, vocab_size, seconds_elapsed and both rates a second."""
    from tokenizers import Tokenizer

    began = time.perf_counter()
    ids = tokenizer_ids(docs, path, batch).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("tokens")), F.lit(0)).alias("t")).first()
    took = time.perf_counter() - began
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    row = (ids["n"], ids["t"], size, Tokenizer.from_file(path).get_vocab_size(), took, ids["t"] / took, size / took)
    return docs.sparkSession.createDataFrame([row], "doc_count long, total_tokens long, bytes_processed long, vocab_size long, seconds_elapsed double, tokens_per_second double, bytes_per_second double")


def train_bpe(docs: DataFrame, merges: int) -> list[tuple[str, str]]:
    """Byte-pair merges of words, the most frequent pair first, equal ones by text.

    Word frequencies are one aggregate; each round counts neighbours over the different words and merges there.
    """
    words = docs.select(F.explode(T.tokens(F.col("text"), None)).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    now = words.select("n", F.filter(F.split("w", ""), lambda c: c != "").alias("s")).cache()
    out: list[tuple[str, str]] = []
    for _ in range(merges):
        pairs = F.transform(F.slice("s", 1, F.size("s") - 1), lambda x, i: F.struct(x.alias("a"), F.get("s", i + 1).alias("b")))
        counts = now.filter(F.size("s") > 1).select("n", F.explode(pairs).alias("p")).groupBy("p").agg(F.sum("n").alias("n"))
        best = counts.orderBy(F.desc("n"), "p.a", "p.b").first()
        if best is None or best["n"] < 2:
            break
        a, b = best["p"]["a"], best["p"]["b"]
        out.append((a, b))
        # Left to right: a symbol joins the one before it unless that one has just been joined.
        start = F.array().cast("array<string>")
        joined = F.aggregate("s", start, lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1) == a) & (x == b), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.lit(a + b)))).otherwise(F.concat(acc, F.array(x))))
        # Words, not rows: their number grows slowly. Each round's table replaces the one before.
        after = now.select("n", joined.alias("s")).cache()
        after.count()
        now.unpersist()
        now = after
    now.unpersist()
    return out
