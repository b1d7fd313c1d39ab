import numpy as np
import pytest
from pyspark.sql import functions as F

from seekspark.llm import multiprobe


def table(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), None if v is None else [None if c is None else float(c) for c in v]) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")


def plain(x, ids, q, own, k):
    s = (x * q).sum(axis=1)
    order = [j for j in np.lexsort((ids, -s)) if ids[j] != own][:k]
    return [(int(ids[j]), s[j]) for j in order]


LENGTHS = {"equal": lambda r: 1.0, "one long": None, "lognormal": lambda r: r.lognormal(0, 0.5)}


@pytest.mark.parametrize("kind", LENGTHS)
def test_recall_and_whole_results(spark, kind):
    r = np.random.default_rng(3)
    x = r.standard_normal((700, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[5] *= 10 if kind == "one long" else 1
    if LENGTHS[kind]:
        x *= np.array([LENGTHS[kind](r) for _ in x])[:, None]
    rows = table(spark, x)
    got = multiprobe.nearest(rows, rows.filter("vec_id % 20 = 0"), k=20).toPandas()
    ids, hit = np.arange(len(x)), 0
    for q in range(0, 700, 20):
        own = got[got.query_id == q].sort_values("rank")
        assert list(own["rank"]) == list(range(1, 21)) and q not in set(own.vec_id)
        assert np.allclose(own.score, (x[own.vec_id] * x[q]).sum(axis=1), atol=0, rtol=0)
        hit += len(set(own.vec_id) & {i for i, _ in plain(x, ids, x[q], q, 20)})
    assert hit >= 0.9 * 35 * 20


def test_hot_buckets_are_tiled_and_copies_are_whole(spark, monkeypatch):
    """A third of all rows are copies, another third near copies: tiles, ties by id, nothing lost."""
    monkeypatch.setattr(multiprobe, "ROWS", 40)
    monkeypatch.setattr(multiprobe, "QUERIES", 7)
    r = np.random.default_rng(4)
    x = r.standard_normal((600, 16))
    x[200:400] = x[200]
    x[400:] = x[400] + 1e-3 * r.standard_normal((200, 16))
    ids = r.permutation(600)
    rows = table(spark, x, ids)
    got = multiprobe.nearest(rows, rows.filter("vec_id % 5 = 0"), k=12, index=multiprobe.Index(probes=200, tables=8)).toPandas()
    for j in np.flatnonzero((ids % 5 == 0) & (np.arange(600) >= 200)):
        own = got[got.query_id == ids[j]].sort_values("rank")
        assert [(a, round(b, 9)) for a, b in zip(own.vec_id, own.score)] == [(a, round(b, 9)) for a, b in plain(x, ids, x[j], ids[j], 12)]


def test_small_tables_give_all_there_is(spark):
    r = np.random.default_rng(5)
    for n in (1, 2, 15, 90):
        x = r.standard_normal((n, 8)) * r.lognormal(0, 2, (n, 1))
        rows = table(spark, x)
        got = multiprobe.nearest(rows, rows, k=20).toPandas()
        assert (got.groupby("query_id").size() == min(20, n - 1)).all() and got.query_id.nunique() == (n if n > 1 else 0)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    v = [[1, 0], [1, 0], [0, 0], None, [nan, 1], [None, 1], [1, 0], [inf, 0], [-0.0, 1], [0.0, 1], [1, 2, 3], [2, 2, 2], []]
    rows = table(spark, v).withColumns({c: F.lit("x") for c in ("id", "v", "dim", "band", "score", "rank")})
    rows = rows.unionByName(rows).unionByName(rows.limit(1).withColumn("vec_id", F.lit(None).cast("long")))
    got = multiprobe.nearest(rows, rows.filter("vec_id in (0, 2, 3, 8, 10)"), k=5).collect()
    want = [(0, 1, 1, 1.0), (0, 2, 6, 1.0), (0, 3, 8, 0.0), (0, 4, 9, 0.0), (8, 1, 9, 1.0), (8, 2, 0, 0.0), (8, 3, 1, 0.0), (8, 4, 6, 0.0), (10, 1, 11, 12.0)]
    assert sorted(tuple(r) for r in got) == want
    assert multiprobe.nearest(rows.limit(0), rows, k=5).count() == multiprobe.nearest(rows, rows.limit(0), k=5).count() == 0


def test_an_id_with_several_vectors(spark):
    rows = table(spark, [[1, 0], [0, 1], [1, 1], [2, 1]], [7, 7, 8, 9])
    got = multiprobe.nearest(rows, rows.filter("vec_id = 7"), k=2).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got) == [(1, 8, 1.0), (1, 9, 2.0), (2, 8, 1.0), (2, 9, 1.0)]


def test_rows_meet_alike_in_a_table_of_any_size(spark):
    """32 rows of a length, then 8 more of it that cannot be among the best: the same are found. (32 were once compared in full.)"""
    r = np.random.default_rng(6)
    x = np.zeros((40, 64))
    x[:32, :32], x[32:, 32:] = r.standard_normal((32, 32)), r.standard_normal((8, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[32:] = np.where(x[32:], -np.abs(x[32:]), 0.0)
    index = multiprobe.Index(tables=2, hashes=4, probes=6)
    few, more = table(spark, x[:32]), table(spark, x)
    found = [{tuple(g) for g in multiprobe.nearest(t, few, k=2, index=index).collect()} for t in (few, more)]
    assert found[0] == found[1]
    whole = {(q, i + 1, j) for q in range(32) for i, (j, _) in enumerate(plain(x[:32], np.arange(32), x[q], q, 2))}
    assert {g[:3] for g in found[0]} != whole  # by hashing, which misses some


def test_one_index_for_any_size(spark):
    """Beyond 131,072 rows the index once had more hashes, which found other rows, fewer of them the nearest."""
    rows = spark.range(140_000, numPartitions=4).select(F.col("id").alias("vec_id"), F.array(*[F.randn(i) for i in range(16)]).alias("embedding"))
    asked = rows.filter("vec_id % 7000 = 0")
    got, fixed = (multiprobe.nearest(rows, asked, k=20, index=i).toPandas() for i in (None, multiprobe.Index()))
    assert set(got.itertuples(index=False, name=None)) == set(fixed.itertuples(index=False, name=None))
    x = np.stack(rows.orderBy("vec_id").toPandas()["embedding"].to_numpy())
    hit = sum(len(set(own.vec_id) & {j for j in np.argsort(-(x @ x[q]))[:21] if j != q}) for q, own in got.groupby("query_id"))
    assert len(got) == 400 and hit >= 0.9 * 400


def test_too_few_found_go_on_probing(spark):
    """Narrow buckets hold almost nothing; every query still gets its k, the nearest, and no more than there are."""
    x = np.random.default_rng(8).standard_normal((50, 12))
    rows = table(spark, x)
    got = multiprobe.nearest(rows, rows, k=49, index=multiprobe.Index(tables=2, hashes=6, width=0.05, probes=3)).toPandas()
    for q, own in got.groupby("query_id"):
        assert [*own.sort_values("rank").vec_id] == [j for j, _ in plain(x, np.arange(50), x[q], q, 49)]
    assert len(got) == 50 * 49


def test_lengths_of_a_tile_may_differ_by_much():
    r = np.random.default_rng(9)
    x = r.standard_normal((400, 16)) * 10.0 ** r.integers(-9, 9, (400, 1))
    q = r.standard_normal((5, 16)) * 1e-6
    qi, found, score = multiprobe.best_of_tile(x, [[i] for i in range(400)], q, [None] * 5, 30)
    for j in range(5):
        assert list(zip(found[qi == j], score[qi == j])) == plain(x, np.arange(400), q[j], None, 30)
