"""Corpus preparation: de-duplication and nested scales."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seekspark.functions import text as T
from seekspark.sources.tables import seeded_order

#: A prime above 2**32; hashes of tokens are below 2**32 and multipliers below 2**31.
PRIME = 4294967311
PERMUTATIONS = 64


@lru_cache(maxsize=16)
def bands_and_rows(jaccard: float, n: int = PERMUTATIONS, steps: int = 1000) -> tuple[int, int]:
    """Bands and rows of ``n`` permutations for which false finds below a similarity and misses above it are least.

    Both are areas under the chance 1 - (1 - s**rows)**bands of sharing a band, weighed alike.
    """
    below = [jaccard * (i + 0.5) / steps for i in range(steps)]
    above = [jaccard + (1 - jaccard) * (i + 0.5) / steps for i in range(steps)]

    def wrong(b: int, r: int) -> float:
        share = lambda s: 1 - (1 - s**r) ** b
        return jaccard * sum(map(share, below)) / steps + (1 - jaccard) * sum(1 - share(s) for s in above) / steps

    return min(((b, r) for b in range(1, n + 1) for r in range(1, n // b + 1)), key=lambda x: (wrong(*x), x))


#: The bands and rows at 0.85, as the function above gives them.
BANDS, ROWS = 4, 15


def multipliers(n: int = PERMUTATIONS) -> list[tuple[int, int]]:
    """(a, b) of each permutation, from a linear congruence."""
    out, x = [], 12345
    for _ in range(n):
        pair = []
        for _ in range(2):
            x = (x * 1103515245 + 12345) % (1 << 31)
            pair.append(x)
        out.append((pair[0] | 1, pair[1]))
    return out


def dedup_exact(docs: DataFrame) -> DataFrame:
    """One row of each text (doc_id, title, text, is_seed): a seed before others, then the smallest doc_id.

    Other rows than seeds whose text a seed has thus go, wherever they stand.
    """
    # Only hashes and ids are ranked; a text that many rows share costs a partial aggregate.
    keyed = docs.withColumn("h", T.text_hash(F.col("title"), F.col("text")))
    first = keyed.groupBy("h").agg(F.min(F.struct(F.when(F.col("is_seed"), 0).otherwise(1).alias("o"), "doc_id")).alias("m"))
    return docs.join(first.select("m.doc_id").distinct(), "doc_id", "left_semi")


def minhash_bands(docs: DataFrame, bands: int = BANDS, rows_a_band: int = ROWS) -> DataFrame:
    """(doc_id, band, key): the minima of ``rows_a_band`` permutations over the document's token set, as one key a band.

    Tokens are hashed once and exploded; the minima of all permutations are one partial aggregate a document, in
    generated code, so the shuffle has about a row a document.
    """
    tokens = T.token_set(T.body(F.col("title"), F.col("text")))
    rows = docs.select("doc_id", F.explode(tokens).alias("t"))
    rows = rows.select("doc_id", F.conv(F.substring(F.md5("t"), 1, 8), 16, 10).cast("long").alias("h"))
    # a * h + b stays below 2**63.
    minima = [F.min((F.lit(a).cast("long") * F.col("h") + F.lit(b)) % F.lit(PRIME)).alias(f"m{i}") for i, (a, b) in enumerate(multipliers()[: bands * rows_a_band])]
    rows = rows.groupBy("doc_id").agg(*minima).select("doc_id", F.array(*[f"m{i}" for i in range(bands * rows_a_band)]).alias("ms"))
    keys = F.array(*[F.struct(F.lit(i).alias("band"), F.md5(F.array_join(F.slice("ms", i * rows_a_band + 1, rows_a_band), ",")).alias("key")) for i in range(bands)])
    return rows.select("doc_id", F.explode(keys).alias("b")).select("doc_id", "b.band", "b.key")


def dedup_minhash(docs: DataFrame, jaccard: float = 0.85) -> DataFrame:
    """``docs`` (doc_id, title, text, is_seed) without the rows that share a band with a seed; seeds stay.

    Near copies among the others stay, as candidates are not verified.
    """
    own = bands_and_rows(jaccard) if jaccard != 0.85 else (BANDS, ROWS)
    seeds = minhash_bands(docs.filter("is_seed"), *own).select("band", "key").distinct()
    near = minhash_bands(docs.filter("not is_seed"), *own).join(seeds, ["band", "key"], "left_semi").select("doc_id").distinct()
    return docs.join(near, "doc_id", "left_anti")


def deduplicate(docs: DataFrame, jaccard: float = 0.85) -> DataFrame:
    """Exact copies, then near copies of seeds."""
    return dedup_minhash(dedup_exact(docs), jaccard)


def nested_scales(docs: DataFrame, scales: list[int], seed: int = 42, retain_seed: bool = True) -> DataFrame:
    """(scale, doc_id, pos): the first rows, as many as each scale, of a seeded order; seeds first if they are retained.

    Positions are numbered in 4096 chunks of the order's hash, so that no task sees all rows.
    """
    first = F.when(F.col("is_seed"), 0).otherwise(1) if retain_seed else F.lit(0)
    rows = docs.select("doc_id", first.alias("o"), seeded_order(F.col("doc_id"), seed).alias("h"))
    rows = rows.withColumn("chunk", F.substring("h", 1, 3))
    totals = rows.groupBy("o", "chunk").agg(F.count("*").alias("n"))  # 8192 rows at most
    before = Window.orderBy("o", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("o", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inner = Window.partitionBy("o", "chunk").orderBy("h", "doc_id")
    pos = F.col("start") + F.row_number().over(inner)
    placed = rows.join(F.broadcast(starts), ["o", "chunk"]).select("doc_id", pos.cast("long").alias("pos"))
    grid = F.explode(F.array(*[F.lit(s) for s in sorted(set(scales))]))
    return placed.withColumn("scale", grid).filter("pos <= scale").select("scale", "doc_id", "pos")


#: Words of the run by which a passage is looked for; short passages that are broadcast at most.
ANCHOR, BROADCAST_SHORT = 5, 10_000


def holding(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """(query_id, doc_id): the documents (doc_id, text) that hold a passage (query_id, text), character by character.

    Words inside a passage are words of any text that holds it. So each passage has a run of such words, the one
    whose hash is smallest, which is joined with the documents' runs; what meets is compared in full. Passages too
    short for a run are compared with every document: few in a test set, and more than a bound are an error.
    """
    words = lambda c: F.split(c, r"\s+")
    runs = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (ANCHOR - 1)), lambda i: F.xxhash64(F.array_join(F.slice(w, i, ANCHOR), " ")))
    asked = passages.select("query_id", F.col("text").alias("_p"), words("text").alias("w"))
    long_enough = F.size("w") >= ANCHOR + 2
    inner = F.slice("w", F.lit(2), F.size("w") - 2)
    anchors = asked.filter(long_enough).select("query_id", "_p", F.array_min(runs(inner)).alias("h"))
    own = docs.select("doc_id", "text", words("text").alias("w")).filter(F.size("w") >= ANCHOR)
    keys = own.select("doc_id", F.explode(F.array_distinct(runs(F.col("w")))).alias("h"))
    near = keys.join(anchors.select("query_id", "h"), "h").select("query_id", "doc_id")
    met = near.join(docs.select("doc_id", "text"), "doc_id").join(anchors.select("query_id", "_p"), "query_id")
    found = met.filter(F.contains("text", "_p")).select("query_id", "doc_id")
    short = asked.filter(~long_enough).select("query_id", "_p")
    n = short.count()
    if n > BROADCAST_SHORT:
        raise ValueError(f"{n} passages have fewer than {ANCHOR + 2} words")
    if not n:
        return found
    return found.unionByName(docs.join(F.broadcast(short), F.contains("text", "_p")).select("query_id", "doc_id"))
