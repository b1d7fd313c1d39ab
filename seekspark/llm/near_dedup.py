"""Near-dedup by the share of common shingles (Jaccard): SimHash links first, completed by MinHash, verified exactly.

Texts with equal sets of shingles form one class. Candidates are the classes whose SimHash fingerprints the Golay
keys link (operator 9, at most 4 of 64 bits apart), and those that share one of BANDS keys of ROWS minima of hashed
shingles. SimHash alone cannot reach the bound: at a similarity of 0.8 two fingerprints differ in about 10 bits, where
64 bits tell nothing apart in a large corpus. Two classes of similarity s share a key of minima with probability
1 - (1 - s**ROWS)**BANDS, at 0.8 all but 0.003 %. Of what shares such a key, pairs go on whose minima agree in EASY
of all places (at 0.8, 4.5 standard deviations below what is expected). The sets of all candidates are compared in full.

Keys of few classes have all their pairs compared at once. In larger ones each class first meets the key's first
class and the one before it; then whatever the links so far have not joined is compared pair by pair. So a group of
near copies, which SimHash links, costs a few links a row, and still no pair is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekspark.llm import bytehash, fingerprints
from seekspark.llm.common import pin, settled, shuffle_partitions, skew_join, trimmed
from seekspark.llm.components import components
from seekspark.llm.simhash_golay import keep_firsts, near_links

BANDS, ROWS = 20, 4
PLACES = BANDS * ROWS
#: Share of a signature's places that agree, at least, for a pair to be compared in full: this much below the bound.
EASY = 0.2
#: Classes of a key up to which all its pairs are compared at once.
SMALL_RUN = 16
#: Pairs sent at a time.
SENT = 1 << 15
_XOR, _ODD = np.random.default_rng(11).integers(0, 1 << 64, (2, PLACES), dtype=np.uint64)
_ODD = _ODD | np.uint64(1)


def simhash_of(hashes: np.ndarray) -> int:
    """The SimHash of a text's shingle hashes: a bit is 1 if it is set in over half of them."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        own = np.ascontiguousarray(hashes[at : at + (1 << 16)])
        ones += np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def summaries(texts: list[str | None], shingle: int) -> list[tuple[int, int, bytes, bytes]]:
    """(class, SimHash, keys and signature, sorted shingle hashes) of each text; without words the last two are empty.

    A shingle counts once a text. Equal sets of shingles have equal SimHashes.
    """
    words, counts = bytehash.word_hashes([(t or "").encode("utf-8", "surrogatepass").lower() for t in texts])
    hashes, n = fingerprints.shingle_hashes(words, counts, shingle)
    ends = np.cumsum(n)
    some = np.flatnonzero(n)
    low = np.zeros((len(texts), PLACES), np.uint64)
    if len(some):
        starts = (ends - n)[some]
        for j in range(PLACES):
            low[some, j] = np.minimum.reduceat((hashes ^ _XOR[j]) * _ODD[j], starts)
    mixed = bytehash.mix(low)
    keys = (mixed.reshape(-1, BANDS, ROWS) * _ODD[:ROWS]).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
    keys, places = bytehash.mix(keys), mixed.astype(np.uint8)
    out = []
    for i, (end, m) in enumerate(zip(ends.tolist(), n.tolist())):
        once = np.unique(hashes[end - m : end])
        own = once.tobytes()
        out.append((xxhash.xxh64_intdigest(own, 42), simhash_of(once), keys[i].tobytes() + places[i].tobytes() if m else b"", own))
    return out


def summarised(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, c, fp, sig, shingles) of every row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                b = whole.slice(at, 128)
                c, fp, sig, own = zip(*summaries(b.column(1).to_pylist(), shingle))
                made = [pa.array(np.array(c, np.uint64).view(np.int64)), pa.array(fp, pa.int64()), pa.array(sig, pa.binary()), pa.array(own, pa.binary())]
                yield pa.RecordBatch.from_arrays([b.column(0), *made], ["doc_id", "c", "fp", "sig", "shingles"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(trimmed(run), "doc_id long, c long, fp long, sig binary, shingles binary")


def _places(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, c, places): a row a class (c, sig) and band."""
    for whole in batches:
        for at in range(0, whole.num_rows, 2048):
            b = whole.slice(at, 2048)
            sig = _places(b.column(1))
            keys = np.ascontiguousarray(sig[:, : 8 * BANDS]).view(np.int64)
            rest = np.repeat(sig[:, 8 * BANDS :], BANDS, axis=0)
            places = pa.FixedSizeBinaryArray.from_buffers(pa.binary(PLACES), len(rest), [None, pa.py_buffer(rest.tobytes())])
            c = np.repeat(b.column(0).to_numpy(zero_copy_only=False), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(c), places.cast(pa.binary())], ["k", "c", "places"])


def _alike(places: np.ndarray, i: np.ndarray, j: np.ndarray, agree: float) -> np.ndarray:
    return (places[i] == places[j]).sum(axis=-1) >= agree * PLACES


def first_pairs(k: np.ndarray, places: np.ndarray, agree: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of sorted keys: all pairs of short runs; in long ones each row with the first and the one before."""
    at = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    size = np.diff(np.concatenate((at, [len(k)])))
    start, each = np.repeat(at, size), np.repeat(size, size)
    rows = np.arange(len(k))
    left, right = [], []
    for shift in range(1, int(min(SMALL_RUN, size.max()))):
        m = rows[(rows - shift >= start) & ((each <= SMALL_RUN) | (shift == 1))]
        left.append(m - shift)
        right.append(m)
    m = rows[(each > SMALL_RUN) & (rows > start + 1)]
    i, j = np.concatenate([*left, start[m]]), np.concatenate([*right, m])
    near = np.concatenate([_alike(places, i[s : s + SENT], j[s : s + SENT], agree) for s in range(0, len(i), SENT)] or [np.zeros(0, bool)])
    return i[near], j[near]


def other_pairs(places: np.ndarray, root: np.ndarray, agree: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (i, j) of one run that are in different components, each pair once."""
    names, label, count = np.unique(root, return_inverse=True, return_counts=True)
    if len(names) == 1:
        return
    most = label == count.argmax()
    rows = np.arange(len(root))
    for i in np.flatnonzero(~most).tolist():
        j = rows[(label != label[i]) & (most | (rows > i))]
        j = j[_alike(places, np.array([i]), j, agree)]
        yield np.full(len(j), i), j


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of sorted rows, cut so that no key is in two; ``places`` as a matrix."""
    kept: list[np.ndarray] | None = None
    for b in batches:
        if not b.num_rows:
            continue
        own = [_places(x) if n == "places" else x.to_numpy(zero_copy_only=False) for n, x in zip(b.schema.names, b.columns)]
        own = [np.concatenate(x) for x in zip(kept, own)] if kept else own
        end = int(np.searchsorted(own[0], own[0][-1], side="left"))
        if end:
            yield [x[:end] for x in own]
        kept = [x[end:] for x in own]
    if kept:
        yield kept


def _pairs(i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    both = np.unique(np.stack((np.minimum(i, j), np.maximum(i, j))), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in np.ascontiguousarray(both)], ["a", "b"])


def _by_key(rows: DataFrame, run: Callable) -> DataFrame:
    parts = shuffle_partitions(rows.sparkSession)
    return rows.repartition(parts, "k").sortWithinPartitions("k", "c").mapInArrow(trimmed(run), "a long, b long").filter("a <> b").distinct()


def verified(pairs: DataFrame, own: DataFrame, least: float) -> DataFrame:
    """The (a, b) of ``pairs`` whose shingles in ``own`` (c, shingles) are as similar as ``least`` or more."""
    needed = pin(pairs.select(F.col("a").alias("c")).unionByName(pairs.select(F.col("b").alias("c"))).distinct())
    sets = pin(skew_join(own.select("c", "shingles"), needed, ["c"], "left_semi").dropDuplicates(["c"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if min(len(x), len(y)) < least * max(len(x), len(y)):
                    ok.append(False)
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both >= least * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left = sets.select(F.col("c").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("c").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(trimmed(run), "a long, b long")


def simhash_pairs(classes: DataFrame) -> DataFrame:
    """(a, b): classes with words that operator 9 links; one link a fingerprint, and one a class that repeats one."""
    some = classes.filter(F.length("sig") > 0)
    firsts = pin(some.groupBy("fp").agg(F.min("c").alias("rep"), F.count("*").alias("n")))
    links = pin(near_links(firsts.select("fp"), 4))
    named = links.join(firsts.select(F.col("fp").alias("a"), F.col("rep").alias("x")), "a").join(firsts.select(F.col("fp").alias("b"), F.col("rep").alias("y")), "b")
    pairs = named.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    repeated = skew_join(some.select("fp", "c"), firsts.filter("n > 1").select("fp", "rep"), ["fp"], "inner").filter("c <> rep")
    return pairs.unionByName(repeated.select(F.col("rep").alias("a"), F.col("c").alias("b")))


def similar_links(own: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """(a, b) links that connect all classes (c, fp, sig) of similarity ``least`` or more, each verified."""
    agree = least - EASY
    rows = classes.filter(F.length("sig") > 0).select("c", "sig").mapInArrow(trimmed(_keyed), "k long, c long, places binary")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, c, places in _runs(batches):
            i, j = first_pairs(k, places, agree)
            yield _pairs(c[i], c[j])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, c, places, root in _runs(batches):
            at = [*np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))).tolist(), len(k)]
            for s, e in zip(at, at[1:]):
                for i, j in other_pairs(places[s:e], root[s:e], agree):
                    if len(j):
                        yield _pairs(c[s:e][i], c[s:e][j])

    links = pin(verified(pin(simhash_pairs(classes).unionByName(_by_key(rows, first)).distinct()), own, least))
    large = pin(rows.groupBy("k").count().filter(F.col("count") > SMALL_RUN).select("k"))
    if large.isEmpty():
        return links
    roots = components(links).select(F.col("node").alias("c"), "root")
    rest = rows.join(large, "k").join(roots, "c", "left").select("k", "c", "places", F.coalesce("root", "c").alias("root"))
    more = pin(_by_key(rest, others))
    return links if more.isEmpty() else links.unionByName(pin(verified(more, own, least)))


def _similar(docs: DataFrame, least: float, shingle: int) -> DataFrame:
    own = pin(summarised(docs, shingle))
    classes = pin(own.groupBy("c").agg(F.min("doc_id").alias("first"), F.first("fp").alias("fp"), F.first("sig").alias("sig")))
    roots = components(similar_links(own, classes, least))
    named = classes.select("c", "first").join(roots.select(F.col("node").alias("c"), "root"), "c", "left")
    named = pin(named.withColumn("root", F.coalesce("root", "c")))
    smallest = pin(named.groupBy("root").agg(F.min("first").alias("component_id")))
    by_class = pin(skew_join(named.select("c", "root"), smallest, ["root"], "inner").select("c", "component_id"))
    return skew_join(own.select("doc_id", "c"), by_class, ["c"], "inner").select("doc_id", "component_id")


def similar(docs: DataFrame, least: float = 0.8, shingle: int = 5) -> DataFrame:
    """(doc_id, component_id) of every row of ``docs`` (doc_id, text), whatever other columns there are.

    Words and shingles are those of simhash_golay.near_duplicates, but a shingle counts once a text. Rows whose
    shingles have a Jaccard similarity of ``least`` or more are linked, rows without words (null, empty) with each
    other; component_id is the smallest doc_id reachable. Rows without a doc_id take part. Repeated rows come out as
    often as they go in; an empty table gives no rows. Texts are read whole, whatever their length.
    """
    return settled(docs.sparkSession, lambda: _similar(docs, least, shingle))


def drop_similar(docs: DataFrame, least: float = 0.8, shingle: int = 5) -> DataFrame:
    """The rows of ``docs`` whose doc_id is their component's smallest, as simhash_golay.drop_near_duplicates."""
    return keep_firsts(docs, similar(docs, least, shingle))
