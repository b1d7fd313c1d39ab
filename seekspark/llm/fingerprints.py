"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch is the k smallest different 64-bit hashes of a text's shingles, ascending; with fewer than k it holds
all of them and its answers are exact. Sketches of parts merge into the sketch of the whole.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seekspark.llm import bytehash
from seekspark.llm.common import shuffle_partitions, without

#: Hashes of a sketch, and words of a shingle.
K, SHINGLE = 128, 5
_STEPS = bytehash.mix(np.arange(101, 133, dtype=np.uint64))


def shingle_hashes(words: np.ndarray, counts: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, text by text, and their number in each text (1 if a text has 1 to shingle words)."""
    if shingle > len(_STEPS):
        raise ValueError(f"at most {len(_STEPS)} words a shingle")
    ends = np.cumsum(counts)
    starts = ends - counts
    n = np.where(counts >= shingle, counts - shingle + 1, np.minimum(counts, 1))
    first = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())
    short = np.flatnonzero((counts > 0) & (counts < shingle))
    padded = np.concatenate((words, np.zeros(shingle, np.uint64)))
    total = np.zeros(len(first), np.uint64)
    for j in range(shingle):
        total += padded[first + j] * _STEPS[j]
    at = np.cumsum(n) - n
    for i in short:
        own = words[starts[i] : ends[i]]
        total[at[i]] = (own * _STEPS[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))
    return bytehash.mix(total), n


def sketches(texts: list[str], k: int = K, shingle: int = SHINGLE) -> list[np.ndarray]:
    """A sketch a text: words are what blanks separate, A-Z lower-cased."""
    words, counts = bytehash.word_hashes([t.encode("utf-8", "surrogatepass").lower() for t in texts])
    hashes, n = shingle_hashes(words, counts, shingle)
    ends = np.cumsum(n).tolist()
    out, at = [], 0
    for end in ends:
        own = hashes[at:end]
        if len(own) > 8 * k:
            # Repeats may fill the smallest few, so widen until k different ones are in or all are.
            take = 2 * k
            while take < len(own):
                low = np.unique(np.partition(own, take)[: take + 1])
                if len(low) >= k:
                    break
                take *= 4
            else:
                low = np.unique(own)
        else:
            low = np.unique(own)
        out.append(low[:k])
        at = end
    return out


def encode(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype(">u8").tobytes()).decode()


def decode(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), ">u8").astype(np.uint64)


def merge(sketch: np.ndarray, other: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of what both stand for together."""
    return np.union1d(sketch, other)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimates the share of the different shingles of both texts that both hold; 1 for two texts without any."""
    if len(a) == len(b) and np.array_equal(a, b):
        return 1.0
    union = merge(a, b, k)
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.count_nonzero(both <= union[-1]) / len(union)) if len(both) else 0.0


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimates the number of different shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) / (float(a[-1]) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimates the share of the first text's shingles that the second holds too; 1 for a text without any."""
    if not len(a):
        return 1.0
    common = resemblance(a, b, k) * distinct(merge(a, b, k), k)
    return min(1.0, common / distinct(a, k))


def fingerprint(docs: DataFrame, text: str = "text", k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """Add ``fingerprint``: the text's sketch (null: as an empty text) as base64 of big-endian hashes.

    Other columns pass through; one named fingerprint is replaced.
    """
    docs = without(docs, "fingerprint")
    schema = docs.select("*", F.lit("").alias("fingerprint")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(b.schema.get_field_index(text)).to_pylist()]
            made = pa.array([encode(s) for s in sketches(texts, k, shingle)], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, made], [*b.schema.names, "fingerprint"])

    return docs.mapInArrow(run, schema)


def merge_fingerprints(prints: DataFrame, group: list[str], k: int = K) -> DataFrame:
    """(group, fingerprint): the sketch of each group's texts together, from the texts' sketches.

    The rows are hashes, of which each group keeps its k smallest: in each of many parts first, then over the
    parts, so that no task gets a whole large group.
    """
    def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = [decode(f) for f in b["fingerprint"]]
            rows = b[group].loc[np.repeat(b.index.to_numpy(), [len(x) for x in own])].reset_index(drop=True)
            flat = np.concatenate(own or [np.zeros(0, np.uint64)])
            # Signed, in the same order as unsigned.
            yield rows.assign(h=(flat ^ np.uint64(1 << 63)).view(np.int64))

    schema = prints.select(*group, F.lit(0).cast("long").alias("h")).schema
    rows = prints.select(*group, "fingerprint").mapInPandas(opened, schema).withColumn("part", F.pmod(F.xxhash64("h"), F.lit(64)))
    w = Window.partitionBy(*group, "part").orderBy("h")
    low = rows.distinct().withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k)
    w = Window.partitionBy(*group).orderBy("h")
    low = low.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k)
    gathered = low.groupBy(*group).agg(F.array_sort(F.collect_list("h")).alias("hs"))

    @F.pandas_udf("string")
    def closed(hs: pd.Series) -> pd.Series:
        return hs.map(lambda x: encode(np.asarray(x, np.int64).view(np.uint64) ^ np.uint64(1 << 63)))

    groups = prints.select(*group).distinct()
    pairs = [groups[g].eqNullSafe(gathered[g]) for g in group]
    return groups.join(gathered, pairs, "left").select(*[groups[g] for g in group], F.coalesce(closed("hs"), F.lit("")).alias("fingerprint"))


def likeness(a: Column, b: Column, k: int = K) -> Column:
    """The resemblance of two fingerprint columns."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else resemblance(decode(p), decode(q), k) for p, q in zip(x, y)], dtype="float64")

    return run(a, b)


EDIT_SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, shingles double, edited_shingles double, edited_contains double"
)


def _edited_rows(batches: Iterator[pa.RecordBatch], k: int, shingle: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows (part, doc_id, own, text), where each part ends with a row of the next part (own false)."""
    held: tuple | None = None

    def made(rows: list[tuple]) -> pa.RecordBatch:
        texts = [r[3] for r in rows]
        edits = []
        for (_, _, own, text), after in zip(rows, texts[1:]):
            half = len(text) // 2
            edits.append(text[: len(text) - half] + after[:half] if own else "")
        all_ = sketches(texts + edits, k, shingle)
        prints, edited = all_[: len(texts)], all_[len(texts) :]
        out = []
        for i, (_, doc_id, own, text) in enumerate(rows[:-1]):
            if own:
                digest = hashlib.sha256(edits[i].encode("utf-8", "surrogatepass")).hexdigest()
                a, b, c = prints[i], edited[i], prints[i + 1]
                out.append((doc_id, len(text), digest, encode(a), encode(b), resemblance(a, b, k), resemblance(a, c, k), distinct(a, k), distinct(b, k), containment(b, a, k)))
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "shingles", "edited_shingles", "edited_contains"]
        kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 5]
        columns = list(zip(*out)) if out else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    for b in batches:
        rows, size = [held] if held else [], 0
        for r in zip(*[c.to_pylist() for c in b.columns]):
            rows.append(r)
            size += len(r[3])
            if size > bytehash.CHUNK and len(rows) > 1:
                yield made(rows)
                rows, size = [rows[-1]], 0
        held = rows[-1] if rows else held
        if len(rows) > 1:
            yield made(rows)


def edited_likeness(docs: DataFrame, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """Fingerprints of every text and of its edit with the next document, and their likeness (EDIT_SCHEMA).

    The edited text has the text's last floor(n/2) code points replaced by the first as many (or all) of the next
    document, in ascending doc_id, after the last the first. Null texts are empty. Rows that repeat a doc_id
    follow each other in the order of a hash of their texts; rows without a doc_id come first. A single document is
    its own next one. An empty table gives no rows. Only doc_id and text are read, whatever other columns there are.
    Texts of any length are read whole, each by one task.

    Documents are dealt out by ranges of doc_id that a quantile sketch of the ids proposes, and sorted there; each
    range also gets the first document of the next one. An id that holds many rows (or none, as null) has several
    ranges, by the texts' hash. So each text is shuffled once and no task gets more than a range.
    """
    parts = 4 * shuffle_partitions(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    at = [i / parts for i in range(1, parts)]
    cuts = [int(x) for x in rows.approxQuantile("doc_id", at, 0.1 / parts)]
    n = rows.agg(F.count("*").alias("n"), F.count("doc_id").alias("ids")).first()
    nulls = -(-(n["n"] - n["ids"]) * parts // max(n["n"], 1))
    # Not as a scratch table, which would hold all sketches on disk beside the shuffled texts.
    return _edited_by_part(rows, cuts, nulls, k, shingle)


def _parts(ids: pd.Series, hashes: pd.Series, cuts: list[int], nulls: int) -> pd.Series:
    """The range of each row: rising with (doc_id, hash), nulls first. An id that is a cut m times has m ranges."""
    known, times = np.unique(np.array(cuts, np.int64), return_counts=True)
    most = int(max(times.max(initial=1), nulls))
    none = ids.isna().to_numpy()
    own = ids.fillna(0).astype("int64").to_numpy()
    base = np.searchsorted(known, own, side="right")
    hot = (base > 0) & (known[np.maximum(base, 1) - 1] == own) if len(known) else np.zeros(len(own), bool)
    share = hashes.to_numpy().astype(float) / 2.0**64 + 0.5
    ranges = np.where(hot, times[np.maximum(base, 1) - 1] if len(known) else 1, most)
    sub = np.where(hot, np.minimum((share * ranges).astype(np.int64), ranges - 1), most)
    # Each base has ranges 0 to most - 1 for its first id, and most for all others.
    part = (base + 1) * (most + 1) + sub
    lone = np.minimum((share * max(nulls, 1)).astype(np.int64), max(nulls, 1) - 1)
    return pd.Series(np.where(none, lone, part).astype("int32"))


def _edited_by_part(rows: DataFrame, cuts: list[int], nulls: int, k: int, shingle: int) -> DataFrame:
    spark = rows.sparkSession

    @F.pandas_udf("int")
    def part_of(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        return _parts(ids, hashes, cuts, nulls)

    # A struct sorts nulls first, then by doc_id, then by hash.
    key = F.struct("doc_id", "h")
    heads = rows.select("doc_id", "h", part_of("doc_id", "h").alias("part")).groupBy("part").agg(F.min(key).alias("first")).collect()
    heads = sorted(((r["part"], r["first"]["doc_id"], r["first"]["h"]) for r in heads), key=lambda x: x[0])
    if not heads:
        return spark.createDataFrame([], EDIT_SCHEMA)
    # At most one row a part: its first document, due at the end of the part before it.
    due = [(heads[i - 1][0], doc_id, h) for i, (_, doc_id, h) in enumerate(heads)]
    table = F.broadcast(spark.createDataFrame(due, "part int, due long, due_h long"))
    own = rows.select(part_of("doc_id", "h").alias("part"), "doc_id", F.lit(True).alias("own"), "h", "text")
    firsts = rows.join(table, F.col("doc_id").eqNullSafe(F.col("due")) & (F.col("h") == F.col("due_h")))
    firsts = firsts.groupBy("part", "doc_id", "h").agg(F.min("text").alias("text"))
    both = own.unionByName(firsts.select("part", "doc_id", F.lit(False).alias("own"), "h", "text"))
    return (
        both.repartition(shuffle_partitions(spark), "part")
        .sortWithinPartitions("part", F.desc("own"), F.asc_nulls_first("doc_id"), "h", "text")
        .select("part", "doc_id", "own", "text")
        .mapInArrow(lambda batches: _edited_rows(batches, k, shingle), EDIT_SCHEMA)
    )
