"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing.

A table's hash of a vector x is floor((a.x + b) / w) for several Gaussian a (2-stable: differences are distributed
as the distance times a Gaussian) and uniform b. A query looks up its own bucket and then perturbed ones, with some
coordinates moved by one, in the order of their estimated success: the sum of squared distances to the borders
crossed. Candidates of all tables are merged and ranked by the exact measure.

Vectors get one more component that makes all lengths equal, so the nearest by distance is the one of the largest
inner product. Rows are split into bands by length, each with a common length of its own: a few long vectors would
crowd all others into the same buckets. A query's buckets are the same for all bands, so bands share buckets.

Whether a row and a query meet depends on the two alone, not on how many others there are: one index for all sizes.
A query that has found too few goes on with half the hashes, and again, until no hash is left and all rows meet it.

Every row goes once to its bucket of each table, and every query to the buckets that it probes; they meet there, in
tiles of bounded size, so no work is done for buckets that no query probes. Rows with equal vectors are one class
with the few smallest ids that can matter, and so are queries: copies cost nothing.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seekspark.llm.common import pin, settled, skew_join

#: Ratio of the longest to the shortest length of a band.
BAND = 1.05
#: Rows and queries of a tile, and queries that are scored at a time.
ROWS, QUERIES, SCORED = 8192, 4096, 128


@dataclass(frozen=True)
class Index:
    """tables x hashes projections of width ``width`` (in units of the vectors' common length); probes a table."""

    tables: int = 6
    hashes: int = 4
    width: float = 1.8
    probes: int = 12
    seed: int = 7

    def coarser(self) -> "Index":
        """Half the hashes. Without any, all rows have one bucket, for which one table does."""
        return replace(self, hashes=self.hashes // 2, tables=self.tables if self.hashes > 1 else 1)

    def drawn(self, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The projections and shifts of all tables, and odd numbers that make one number of a table's cells."""
        rng = np.random.default_rng([self.seed, dim])
        a, b = rng.standard_normal((self.tables, self.hashes, dim)), rng.uniform(0, self.width, (self.tables, self.hashes))
        return a, b, np.random.default_rng([self.seed, 1]).integers(1 << 40, 1 << 60, self.hashes) | 1

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """(tables, rows): the bucket of each vector, all of length 1."""
        a, b, odd = self.drawn(x.shape[1])
        cells = np.floor((np.einsum("nd,thd->tnh", x, a) + b[:, None]) / self.width).astype(np.int64)
        return (cells * odd).sum(axis=2)

    def probed(self, x: np.ndarray) -> np.ndarray:
        """(tables, rows, probes): the buckets that each query visits, its own first."""
        a, b, odd = self.drawn(x.shape[1])
        at = (np.einsum("nd,thd->tnh", x, a) + b[:, None]) / self.width
        cell = np.floor(at)
        low = at - cell
        # The distances to the lower borders, then to the upper ones; the nearest first.
        near = np.argsort(np.concatenate((low, 1 - low), axis=2), axis=2, kind="stable")
        base, step = (cell.astype(np.int64) * odd).sum(axis=2), np.concatenate((-odd, odd))[near]
        return np.stack([base + step[:, :, list(s)].sum(axis=2) for s in perturbations(self.hashes, self.probes)], axis=2)


@lru_cache(maxsize=8)
def perturbations(hashes: int, probes: int) -> list[tuple[int, ...]]:
    """Sets of places in the order of borders by distance, most promising first.

    Place j stands for the (j+1)-th nearest of the 2 x hashes borders of a query; a place and its mirror image
    are the two borders of one coordinate and exclude each other. Sets are scored by the expected squares of
    uniform order statistics and come from a heap, each set giving its last place shifted, or one more place.
    """
    n = hashes
    expected = [j * (j + 1) / (4 * (n + 1) * (n + 2)) for j in range(1, n + 1)]
    expected += [1 - (2 * n + 1 - j) / (n + 1) + (2 * n + 1 - j) * (2 * n + 2 - j) / (4 * (n + 1) * (n + 2)) for j in range(n + 1, 2 * n + 1)]
    out: list[tuple[int, ...]] = [()]
    heap = [(expected[0], (0,))] if n else []
    while heap and len(out) < probes:
        score, own = heapq.heappop(heap)
        if not any(2 * n - 1 - j in own for j in own):
            out.append(own)
        last = own[-1]
        if last + 1 < 2 * n:
            heapq.heappush(heap, (score - expected[last] + expected[last + 1], (*own[:-1], last + 1)))
            heapq.heappush(heap, (score + expected[last + 1], (*own, last + 1)))
    return out


def _vectors(column: pa.Array) -> np.ndarray:
    return column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() : column.offsets[-1].as_py()].reshape(len(column), -1)


def _by_dim(batch: pa.RecordBatch, at: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, vectors) of the rows of each number of components."""
    sizes = np.array([len(v) for v in batch.column(at)])
    for dim in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == dim)
        yield own, _vectors(batch.column(at).take(pa.array(own)))


def _bands(x: np.ndarray) -> np.ndarray:
    """The band of each vector's length: BAND to the power of band - 0.5 up to band + 0.5."""
    scale = np.abs(x).max(axis=1)
    return np.floor((np.log(scale) + np.log(np.linalg.norm(x / scale[:, None], axis=1))) / np.log(BAND) + 0.5).astype(np.int64)


def _sent(batch: pa.RecordBatch, of: np.ndarray, table: int, bucket: np.ndarray) -> pa.RecordBatch:
    rows = batch.take(pa.array(of))
    more = [pa.array(np.full(len(of), table, np.int32)), pa.array(bucket)]
    return pa.RecordBatch.from_arrays([*rows.columns, *more], [*rows.schema.names, "t", "bucket"])


def _lengths(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1)
    return scale * np.linalg.norm(x / scale[:, None], axis=1)


KEYED = "t int, bucket long"


def best_of_tile(x: np.ndarray, ids: list, q: np.ndarray, own: list, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, id, score) of the ``keep`` best for each query, ties to the smaller id; ``own`` takes no part."""
    size = np.array([len(i) for i in ids])
    flat, first = np.concatenate([np.asarray(i, np.int64) for i in ids]), np.cumsum(size) - size
    got: list[tuple[np.ndarray, ...]] = []
    # What rounding may change in a product, for each row and query: their lengths may differ by much.
    off = 4 * np.finfo(float).eps * x.shape[1] * _lengths(x)
    for at in range(0, len(q), SCORED):
        part = q[at : at + SCORED]
        s, error = part @ x.T, np.outer(_lengths(part), off)
        m = min(keep + 1, len(x))
        least = np.partition(s - error, len(x) - m, axis=1)[:, len(x) - m]
        # Whatever may be among the best, then its exact score, whose value does not depend on the tile.
        qi, ri = np.nonzero(~(s + error < least[:, None]))
        exact = (x[ri] * part[qi]).sum(axis=1)
        n = size[ri]
        place = np.repeat(first[ri] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        qi, exact, found = np.repeat(qi, n), np.repeat(exact, n), flat[place]
        free = np.array([o is None or o != o for o in own[at : at + SCORED]])
        other = np.array([0 if f else int(o) for o, f in zip(own[at : at + SCORED], free)])
        m = free[qi] | (found != other[qi])
        qi, exact, found = qi[m], exact[m], found[m]
        order = np.lexsort((found, -exact, qi))
        qi, exact, found = qi[order], exact[order], found[order]
        begin = np.searchsorted(qi, qi, side="left")
        m = np.arange(len(qi)) - begin < keep
        got.append((qi[m] + at, found[m], exact[m]))
    return tuple(np.concatenate(c) for c in zip(*got))


def usable(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, v double[], h1, h2) of the vectors that are not null or zero and hold numbers only; equal ones hash alike."""
    v = F.col("v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & v.isNotNull()).filter(fine)
    # Zeros lose their sign.
    rows = rows.withColumn("v", F.transform("v", lambda x: x + 0.0))
    return rows.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit("second"), "v")})


CLASS = ["h1", "h2"]
ASKED = ["h1", "h2", "own"]
PLACE = ["dim", "t", "bucket"]
FOUND = "h1 long, h2 long, own long, vec_id long, score double"


def _met(rows: DataFrame, asked: DataFrame, keep: int) -> DataFrame:
    """FOUND of keyed rows and queries, bucket by bucket, each in tiles of at most about ROWS x QUERIES."""
    blocks = rows.groupBy(*PLACE).agg(F.count("*").alias("_r")).join(asked.groupBy(*PLACE).agg(F.count("*").alias("_q")), PLACE)
    cut = lambda n, size: F.ceil(F.col(n) / size).cast("int")
    blocks = blocks.select(*PLACE, cut("_r", ROWS).alias("rb"), cut("_q", QUERIES).alias("qb")).filter("rb > 1 or qb > 1")
    blocks = pin(blocks)

    def dealt(side: DataFrame, mine: str, theirs: str, x: str, y: str) -> DataFrame:
        if blocks.isEmpty():
            return side.withColumns({x: F.lit(0), y: F.lit(0)})
        both = skew_join(side, blocks, PLACE, "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("rb", "qb")})
        placed = both.withColumn(x, F.pmod(F.xxhash64("h2", "h1"), F.col(mine)).cast("int"))
        return placed.withColumn(y, F.explode(F.sequence(F.lit(0), F.col(theirs) - 1))).drop("rb", "qb")

    by = [*PLACE, "x", "y"]
    left, right = dealt(rows, "rb", "qb", "x", "y"), dealt(asked, "qb", "rb", "y", "x")

    def tile(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(theirs):
            return pd.DataFrame({"h1": [], "h2": [], "own": [], "vec_id": [], "score": []})
        x, q = np.stack(mine["v"].to_numpy()), np.stack(theirs["v"].to_numpy())
        qi, ids, score = best_of_tile(x, mine["ids"].tolist(), q, theirs["own"].tolist(), keep)
        out = theirs[ASKED].iloc[qi].reset_index(drop=True)
        return out.assign(own=out["own"].astype("Int64"), vec_id=ids, score=score)

    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(tile, FOUND)


def _probed(classes: DataFrame, asked: DataFrame, index: Index, keep: int) -> DataFrame:
    """FOUND of the rows in the buckets that each query probes."""

    def rows_keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for own, x in _by_dim(b, 2):
                y = x / (BAND ** (_bands(x) + 0.5))[:, None]
                y = np.column_stack((y, np.sqrt(np.maximum(0.0, 1.0 - (y * y).sum(axis=1)))))
                for t, keys in enumerate(index.buckets(y)):
                    yield _sent(b, own, t, keys)

    def asked_keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for own, x in _by_dim(b, 3):
                x = x / np.abs(x).max(axis=1)[:, None]
                y = np.column_stack((x / np.linalg.norm(x, axis=1)[:, None], np.zeros(len(x))))
                for t, keys in enumerate(index.probed(y)):
                    yield _sent(b, np.repeat(own, keys.shape[1]), t, keys.ravel())

    keyed = classes.select(*CLASS, "v", "ids", "dim").mapInArrow(rows_keyed, f"h1 long, h2 long, v array<double>, ids array<long>, dim int, {KEYED}")
    probes = asked.select(*ASKED, "v", "dim").mapInArrow(asked_keyed, f"h1 long, h2 long, own long, v array<double>, dim int, {KEYED}")
    return _met(pin(keyed), pin(probes), keep)


def _searched(vectors: DataFrame, queries: DataFrame, k: int, id_col: str, vector: str, index: Index | None) -> DataFrame:
    spark = vectors.sparkSession
    empty = "query_id long, rank int, vec_id long, score double"
    rows = pin(usable(vectors, id_col, vector))
    keep = k + 1  # one may be the query's own
    w = Window.partitionBy(*CLASS).orderBy("id")
    few = rows.groupBy(*CLASS, "id").agg(F.first("v").alias("v")).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= keep)
    classes = pin(few.groupBy(*CLASS).agg(F.first("v").alias("v"), F.array_sort(F.collect_list("id")).alias("ids")).withColumn("dim", F.size("v")))
    # An id with several vectors is asked for on its own, without all of them.
    several = rows.groupBy("id").agg(F.count_distinct(*CLASS).alias("_n")).filter("_n > 1").select("id", F.col("id").alias("own"))
    ids = pin(usable(queries, id_col, vector).join(several, "id", "left").select(F.col("id").alias("query_id"), *ASKED, "v"))
    asked = pin(ids.groupBy(*ASKED).agg(F.first("v").alias("v")).withColumn("dim", F.size("v")))
    if classes.isEmpty() or asked.isEmpty():
        return spark.createDataFrame([], empty)
    index = index or Index()
    found = pin(_best(_probed(classes, asked, index, keep), keep))
    while index.hashes:
        # A query that found too few goes on with larger buckets.
        enough = found.filter(F.size("best") >= keep)
        lacking = pin(asked.join(enough, _same(asked, enough), "left_anti"))
        if lacking.isEmpty():
            break
        index = index.coarser()
        before = found.filter(F.size("best") < keep).select(*ASKED, F.inline("best"))
        own = classes.join(F.broadcast(lacking.select("dim").distinct()), "dim", "left_semi")
        more = pin(_best(_probed(own, lacking, index, keep).unionByName(before), keep))
        found = pin(enough.unionByName(more))
    each = skew_join(ids.select("query_id", *CLASS, F.coalesce("own", F.lit(-(2**63))).alias("own")).distinct(), found.withColumn("own", F.coalesce("own", F.lit(-(2**63)))), ASKED, "inner")
    best = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k)
    out = each.select("query_id", *CLASS, F.posexplode(best).alias("rank", "b"))
    out = out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))
    return out


def _same(a: DataFrame, b: DataFrame):
    return [a[c].eqNullSafe(b[c]) for c in ASKED]


def _best(found: DataFrame, keep: int) -> DataFrame:
    """(h1, h2, own, best): the ``keep`` best different rows of each query, nearest first, in one array."""
    w = Window.partitionBy(*ASKED).orderBy(F.desc("score"), "vec_id")
    ranked = found.distinct().withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= keep)
    best = F.array_sort(F.collect_list(F.struct("_r", "vec_id", "score")))
    return ranked.groupBy(*ASKED).agg(F.transform(best, lambda b: F.struct(b["vec_id"].alias("vec_id"), b["score"].alias("score"))).alias("best"))


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector: str = "embedding", index: Index | None = None
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products found for each query among all rows but its own.

    Ties go to the smaller id. Fewer come out only if there are fewer candidates: a query whose buckets hold too
    few goes on with larger ones, the last of which holds all rows. Vectors that are null, zero or hold null or
    non-finite components take no part; nor do rows without an id. Vectors meet only those of their own number of
    components. Rows that repeat an id and vector count once; several vectors of one id are one candidate each. Only
    the id and the vector are read, whatever other columns there are. No rows or no queries give no rows. ``index``:
    by default the same for tables of any size.

    All rows are indexed. A hot bucket is cut into tiles, so a task's memory is bounded; near but unequal vectors
    that crowd a bucket meet all queries that probe it.
    """
    return settled(vectors.sparkSession, lambda: _searched(vectors, queries, k, id_col, vector, index))
