"""SimHash near-duplicates, found through Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments. If two fingerprints differ in at most 4 bits, two of the three
segments together differ in at most 2 bits (the third has at least as many as either). For each pair of segments
the keys of a fingerprint are the pairs of codeword indices reached by flipping at most one bit of the two
segments: two fingerprints within 2 bits there have a fingerprint within one bit of both, so they share a key.
That makes about 29 keys of 26 bits a fingerprint; what shares a key is verified on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekspark.llm import golay
from seekspark.llm.common import pin, settled, shuffle_partitions, skew_join, trimmed, without
from seekspark.llm.components import components

#: (shift, bits) of the three segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Runs of a key up to this many fingerprints have all their pairs compared at once.
SMALL_RUN = 48
#: Fingerprints of a key that one task compares with another such block.
BLOCK = 8192


def fingerprints_of(texts: list[str | None], shingle: int) -> np.ndarray:
    """A 64-bit SimHash a text, unsigned."""
    out = np.zeros(len(texts), np.uint64)
    for i, text in enumerate(texts):
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII blanks
        if not words:
            continue
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        if len(words) > shingle:
            starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
        else:
            starts, ends = starts[:1], ends[-1:]
        ones, n = np.zeros(64, np.int64), len(starts)
        for at in range(0, n, 1 << 16):
            pieces = [joined[a:b] for a, b in zip(starts[at : at + (1 << 16)].tolist(), ends[at : at + (1 << 16)].tolist())]
            h = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(42)), np.uint64, len(pieces))
            ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[i] = np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0]
    return out


def simhash(docs: DataFrame, shingle: int = 5, text: str = "text") -> DataFrame:
    """Add ``fp``, the SimHash of each text as a signed long; other columns pass through, one of that name is replaced."""
    docs = without(docs, "fp")
    schema = docs.select("*", F.lit(0).cast("long").alias("fp")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = fingerprints_of(b.column(b.schema.get_field_index(text)).to_pylist(), shingle)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fp.view(np.int64))], [*b.schema.names, "fp"])

    return docs.mapInArrow(trimmed(run), schema)


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, index into fps): every fuzzy key of every fingerprint."""
    parts = [((fps >> np.uint64(s)) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in SEGMENTS]
    balls = [golay.ball_keys(p) for p in parts]
    keys, of = [], []
    rows = np.arange(len(fps))
    for tag, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        (ki, ni), (kj, nj) = balls[i], balls[j]
        base = np.int64(tag << 24)
        for c in range(6):
            m = ni > c
            keys.append(base | ki[m, c] << 12 | kj[m, 0])
            of.append(rows[m])
            if c:
                m = nj > c
                keys.append(base | ki[m, 0] << 12 | kj[m, c])
                of.append(rows[m])
    return np.concatenate(keys), np.concatenate(of)


def close_pairs(keys: np.ndarray, fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of fps within ``bits`` that stand in one run of equal keys; keys are in order and runs short."""
    left, right = [], []
    rows = np.arange(len(keys))
    shift = 1
    while len(rows):
        rows = rows[rows + shift < len(keys)]
        rows = rows[keys[rows] == keys[rows + shift]]
        near = rows[np.bitwise_count(fps[rows] ^ fps[rows + shift]) <= bits]
        left.append(fps[near])
        right.append(fps[near + shift])
        shift += 1
    return np.concatenate(left or [fps[:0]]), np.concatenate(right or [fps[:0]])


def forest(own: np.ndarray, other: np.ndarray | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is within ``bits`` in a block (or between two): at most one a fingerprint.

    Exact: it compares everything, but stops as soon as all are connected, as in a group of near copies.
    """
    both = own if other is None else np.concatenate((own, other))
    n = len(both)
    label = np.arange(n)
    left, right = [], []
    parts = n
    for i in range(len(own)):
        if parts == 1:
            break
        near = np.flatnonzero(np.bitwise_count(both ^ both[i]) <= bits)
        labels = np.unique(label[near])
        new = labels[labels != label[i]]
        if len(new):
            first = near[np.unique(label[near], return_index=True)[1]]
            joined = first[label[first] != label[i]]
            left.append(np.full(len(joined), both[i]))
            right.append(both[joined])
            label[np.isin(label, new)] = label[i]
            parts -= len(new)
    return np.concatenate(left or [both[:0]]), np.concatenate(right or [both[:0]])


def _links(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Links of sorted (k, fp) rows. Only one key's rows are held beyond a batch, and a block of them at most."""

    def sent(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        pairs = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b))), axis=1) if len(a) else np.zeros((2, 0), np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in np.ascontiguousarray(pairs)], ["a", "b"])

    kept_k, kept_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def runs(k: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(k):
            return
        at = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        size = np.diff(np.concatenate((at, [len(k)])))
        each = np.repeat(size, size)
        m = (each > 1) & (each <= SMALL_RUN)
        a, b = close_pairs(k[m], f[m], bits)
        if len(a):
            yield sent(a, b)
        for i in np.flatnonzero(size > SMALL_RUN):
            a, b = forest(f[at[i] : at[i] + size[i]], None, bits)
            if len(a):
                yield sent(a, b)

    for batch in batches:
        k = np.concatenate((kept_k, batch.column(0).to_numpy(zero_copy_only=False)))
        f = np.concatenate((kept_f, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
        end = int(np.searchsorted(k, k[-1], side="left")) if len(k) else 0
        yield from runs(k[:end], f[:end])
        kept_k, kept_f = k[end:], f[end:]
    yield from runs(kept_k, kept_f)


def near_links(fps: DataFrame, bits: int) -> DataFrame:
    """(a, b) links that connect all distinct ``fp`` within ``bits`` of each other (4 or fewer), each verified."""
    if bits > 4:
        raise ValueError("the segments find differences of at most 4 bits")
    spark = fps.sparkSession
    parts = shuffle_partitions(spark)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(f), 1 << 14):
                own = f[at : at + (1 << 14)]
                k, of = golay_keys(own)
                yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(own[of].view(np.int64))], ["k", "fp"])

    rows = fps.select("fp").mapInArrow(trimmed(keyed), "k int, fp long")
    # A key with more than BLOCK fingerprints is cut into blocks, and every two of its blocks meet in a task.
    blocks = F.ceil(F.col("count") / BLOCK).cast("int")
    large = pin(rows.groupBy("k").count().filter(F.col("count") > BLOCK).select("k", blocks.alias("blocks")))
    some = not large.isEmpty()
    links = (
        (rows.join(large, "k", "left_anti") if some else rows)
        .repartition(parts, "k")
        .sortWithinPartitions("k", "fp")
        .mapInArrow(trimmed(lambda batches: _links(batches, bits)), "a long, b long")
    )
    if some:
        links = links.unionByName(_block_links(rows.join(large, "k"), bits))
    return links.distinct()


def _block_links(rows: DataFrame, bits: int) -> DataFrame:
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    tiles = (
        rows.withColumn("mine", mine)
        .withColumn("other", other)
        .select("k", "fp", "mine", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"))
    )

    def tile(key, pdf):
        import pandas as pd

        f, first = pdf["fp"].to_numpy().view(np.uint64), (pdf["mine"] == key[1]).to_numpy()
        a, b = forest(f[first], None if key[1] == key[2] else f[~first], bits)
        return pd.DataFrame({"a": np.minimum(a, b).view(np.int64), "b": np.maximum(a, b).view(np.int64)})

    return tiles.groupBy("k", "x", "y").applyInPandas(tile, "a long, b long")


def near_duplicates(docs: DataFrame, bits: int = 4, shingle: int = 5) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs`` (doc_id, text).

    A text's words are what blanks (a space, \\t to \\r) separate, A-Z lower-cased; its shingles are all runs of
    ``shingle`` words, repeats included, or the whole text if it has fewer; no words: fingerprint zero. A bit of
    ``fp`` is set if it is set in over half of the shingles' XXH64 hashes. Rows whose fingerprints differ in at
    most ``bits`` bits are linked; component_id is the smallest doc_id reachable. Null texts have no words. Rows
    with equal fingerprints form one class, so copies cost nothing but their own row. Rows without a doc_id take
    part and may be in a component without any doc_id (null). Repeated rows come out as often as they go in.
    """
    own = pin(simhash(docs.select("doc_id", "text"), shingle).select("doc_id", "fp"))
    classes = pin(own.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = pin(components(near_links(classes, bits)))
    named = classes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left")
    named = pin(named.withColumn("root", F.coalesce("root", "fp")))
    smallest = pin(named.groupBy("root").agg(F.min("first").alias("component_id")))
    by_class = pin(skew_join(named.select("fp", "root"), smallest, ["root"], "inner").select("fp", "component_id"))
    return skew_join(own, by_class, ["fp"], "inner").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, bits: int = 4, shingle: int = 5) -> DataFrame:
    """The rows of ``docs`` whose doc_id is their component's smallest; one row of each doc_id that repeats there.

    Rows without a doc_id cannot be told apart from their copies and stay.
    """
    return keep_firsts(docs, near_duplicates(docs, bits, shingle))


def keep_firsts(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``groups`` (doc_id, component_id), a table, has as their component's smallest."""
    stay = groups.filter("doc_id = component_id")
    repeated = pin(stay.groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    stay = stay.join(repeated, "doc_id", "left_anti").select("doc_id").hint("shuffle_hash")
    kept = docs.join(stay, "doc_id", "left_semi").unionByName(docs.filter("doc_id is null"))
    if repeated.isEmpty():
        return kept
    return kept.unionByName(docs.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
