"""Mixing sources to target weights on a low-discrepancy schedule.

Slot i of the mix belongs to the source into whose share of [0, 1) the fraction of i times the golden ratio falls,
so every stretch of the schedule holds the sources in their shares. The k-th slot of a source takes the k-th block
of its shuffled stream of words, all blocks being equally long; past its end the stream is taken again. A source's
last block ends at its target.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekspark.llm.common import free_names, pin, prefix_sums, settled

#: Words of a block.
BLOCK = 64
#: A source's words are taken this many times at most.
REPEATS = 3
WORD = r"[^\x20\x09-\x0D]+"
#: The golden ratio's fraction, as a multiple of 2**-31; odd, so the points repeat after 2**31 slots only.
GOLDEN, POINTS = 1327217885, 1 << 31
#: Rows of a chunk in which rows are numbered or summed.
CHUNK = 1 << 11


def targets(sizes: list[int], weights: list[int], repeats: int = REPEATS) -> list[float]:
    """Each source's share of the words of all, by weight, none over ``repeats`` times its size; the excess is reshared."""
    goal = [0.0] * len(sizes)
    open_, left = [i for i, s in enumerate(sizes) if s > 0], float(sum(sizes))
    while open_:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / total > repeats * sizes[i]]
        if not full:
            for i in open_:
                goal[i] = left * weights[i] / total
            break
        for i in full:
            goal[i] = float(repeats * sizes[i])
        left -= sum(goal[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return goal


def recipe(stats: list[tuple[str | None, int]], weights: tuple[int, ...] = (1, 2, 3)) -> list[tuple[int, str | None, int, float]]:
    """(number, source, size, target): sources by code point, null last, with weights that repeat."""
    order = sorted(stats, key=lambda x: (x[0] is None, (x[0] or "").encode("utf-8", "surrogatepass")))
    goal = targets([s for _, s in order], [weights[i % len(weights)] for i in range(len(order))])
    return [(i, source, size, t) for i, ((source, size), t) in enumerate(zip(order, goal))]


def schedule(spark: SparkSession, sources: list[tuple[int, str | None, int, float]], block: int) -> DataFrame:
    """(src, id, k): the slots of each source, numbered from 0 in the order of the schedule."""
    total = sum(t for *_, t in sources)
    n = math.ceil(total / block) if total else 0
    some = [(i, t) for i, _, _, t in sources if t > 0]
    numbers, edges = np.array([i for i, _ in some], np.int32), np.cumsum([t / total for _, t in some])[:-1]

    def owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slot = b.column(0).to_numpy()
            point = (slot % POINTS * GOLDEN) % POINTS / POINTS
            src = numbers[np.searchsorted(edges, point, side="right")]
            yield pa.RecordBatch.from_arrays([pa.array(src), b.column(0), pa.array(slot // CHUNK)], ["src", "id", "chunk"])

    rows = spark.range(n).mapInArrow(owned, "src int, id long, chunk long")
    return prefix_sums(rows, ["src"], "chunk", [F.col("id")], F.lit(1), "k").select("src", "id", "k")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), block: int = BLOCK, seed: int = 17) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of every row of ``docs`` (doc_id, text, source).

    size: words of the text, which blanks (a space, \\t to \\r) separate; null and empty: 0. Sources weigh as
    ``weights`` say, in the order of their code points, null last, and share as many words as there are. A target
    stops at 3 times its source's size; the excess is reshared by weight. taken: words of the document in the mix,
    repeats counted; at most 3 times its size. Empty documents take 0. Reruns agree: the shuffle is by a hash of
    doc_id and text. The recipe, one row a source, is made on the driver; everything else is spread in chunks
    whatever a source's share. Repeated rows have each their own place, null ids are allowed, an empty table gives
    no rows. Only the three columns are read, whatever others there are. Texts are counted whole.
    """
    return settled(docs.sparkSession, lambda: _mix(docs, weights, block, seed))


def _mix(docs: DataFrame, weights: tuple[int, ...], block: int, seed: int) -> DataFrame:
    spark = docs.sparkSession
    sizes = pin(
        docs.select(
            "doc_id",
            "source",
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.xxhash64(F.lit(seed), "doc_id", "text").alias("order"),
        )
    )
    stats = [(r["source"], r["size"]) for r in sizes.groupBy("source").agg(F.sum("size").alias("size")).collect()]
    sources = recipe(stats, weights)
    named = F.broadcast(spark.createDataFrame(sources, "src int, source string, source_size long, target double"))
    rows = sizes.withColumnRenamed("source", "_source").join(named, F.col("_source").eqNullSafe(named["source"])).drop("_source")

    # Each document's place in its source's stream; streams are ordered by hash, so a chunk is a range of hashes.
    chunks = max(1, math.ceil(rows.count() / CHUNK))
    chunk = F.floor((F.col("order").cast("double") / 2.0**64 + 0.5) * chunks)
    full = rows.filter("size > 0").withColumn("chunk", chunk)
    placed = prefix_sums(full, ["src"], "chunk", [F.col("order"), F.col("doc_id").asc_nulls_first(), F.col("size")], F.col("size"), "at")
    placed = pin(placed.drop("chunk", "order"))

    # The k-th slot of a source takes block k of its stream, which is its documents up to 3 times over.
    words_of = F.broadcast(spark.createDataFrame([(i, round(t)) for i, _, _, t in sources], "src int, words long"))
    slots = schedule(spark, sources, block).join(words_of, "src").filter(F.col("k") * block < F.col("words"))
    taken = slots.select("src", F.col("k").alias("block"), F.least((F.col("k") + 1) * block, F.col("words")).alias("upto"))

    rounds = F.sequence(F.lit(0), F.ceil(F.col("target") / F.col("source_size")).cast("int"))
    begin, end = F.col("round") * F.col("source_size") + F.col("at"), F.col("begin") + F.col("size")
    parts = (
        placed.filter("target > 0")
        .withColumn("round", F.explode(rounds))
        .withColumn("begin", begin)
        .filter(F.col("begin") < F.col("target"))
        .select("src", "at", "begin", end.alias("end"))
        .withColumn("block", F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("end") - 1) / block))))
    )
    common = F.least("end", "upto") - F.greatest(F.col("begin"), F.col("block") * block)
    words = (
        parts.join(taken, ["src", "block"])
        .groupBy("src", "at")
        .agg(F.sum(F.greatest(common, F.lit(0))).alias("taken"))
    )
    keep = ["doc_id", "source", "size", "source_size", "target"]
    some = placed.join(words, ["src", "at"], "left").select(*keep, F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    none = rows.filter("size = 0").select(*keep, F.lit(0).cast("long").alias("taken"))
    return some.unionByName(none)


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), block: int = BLOCK, seed: int = 17) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them: taken words by size, to the nearest whole number.

    A document's rest of up to a half of it thus rounds away or up, evenly over a source. Empty documents have no
    word to take and stay once. Needs unique doc_ids (rows that repeat one are taken as often as all of them);
    rows without a doc_id stay once. All columns pass through, whatever their names; an empty table gives no rows.
    """
    share = mix(docs, weights, block, seed).filter("doc_id is not null and size > 0")
    of, times, copy = free_names(docs, "of", "times", "copy")
    by_id = share.groupBy("doc_id").agg((F.sum("taken") / F.sum("size")).alias("t"))
    counted = by_id.select(F.col("doc_id").alias(of), F.floor(F.col("t") + 0.5).cast("int").alias(times)).hint("shuffle_hash")
    both = docs.join(counted, F.col("doc_id") == F.col(of), "left").withColumn(times, F.coalesce(times, F.lit(1)))
    copies = both.filter(F.col(times) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times))))
    return copies.select(*[F.col(f"`{c}`") for c in docs.columns])
