from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from seekspark.llm import simhash_golay
from tests.llm.test_operators import docs_of, odd_rows, plain_components, plain_line_dedup, toxic_corpus


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    docs, labels = toxic_corpus(spark, 300)
    common = "this very common line stands in many of the documents of this table"
    docs = docs.withColumn("text", F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("\n" + common))).otherwise(F.col("text")))
    copies = docs.filter("doc_id < 20").withColumn("doc_id", F.col("doc_id") + 1000)
    docs.unionByName(copies).write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_against_plain(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    stages = [f for _, f in corpus_pipeline.STAGES]
    clean = stages[0](spark, docs, small).cache()
    left = {r["doc_id"] for r in clean.collect()}
    assert len([i for i, t in labels.items() if t and i in left]) <= 3
    assert len([i for i, t in labels.items() if not t and i not in left]) <= 2
    lines = stages[1](spark, clean, small).cache()
    rows = sorted((r["doc_id"], r["text"]) for r in clean.collect())
    want = dict(zip([i for i, _ in rows], plain_line_dedup([t for _, t in rows], 40, 5)))
    assert {r["doc_id"]: r["text"] for r in lines.collect()} == want
    one = stages[2](spark, lines, small).cache()
    ids = sorted(want)
    roots = plain_components(simhash_golay.fingerprints_of([want[i] for i in ids], 5), 4)
    assert sorted(r["doc_id"] for r in one.collect()) == [i for k, i in enumerate(ids) if roots[k] == k]
    mix = stages[3](spark, one, small).cache()
    assert mix.columns == docs.columns and max(Counter(r["doc_id"] for r in mix.collect()).values()) <= 3
    packed = stages[4](spark, mix, small).toPandas()
    assert packed.groupby("sequence_id").length.sum().max() <= 1024
    assert packed[packed.piece == 0].doc_id.value_counts().to_dict() == dict(Counter(r["doc_id"] for r in mix.collect()))


def test_run_is_the_stages(spark, small):
    out = corpus_pipeline.run(spark, small)
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(out.columns)


def test_odd_rows_and_columns(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows and clashing columns; then an empty table."""
    names = ["toxic", "p_toxic", "kept_text", "n_lines", "of", "gone", "c", "fp", "size", "taken", "times", "piece", "start", "offset", "sequence_id", "group"]
    odd = odd_rows(spark).withColumns({n: F.lit("x") for n in names})
    more = docs_of(spark, [f"a clean text number {i} that stays as it is {i * i}" for i in range(30)]).withColumn("doc_id", F.col("doc_id") + 100)
    for name, docs in (("odd", odd.unionByName(more, allowMissingColumns=True)), ("none", odd.limit(0))):
        path = str(tmp_path / name)
        docs.write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame([(100 + i, 1, 0) for i in range(20)] + [(None, 1, 1), (2, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        kept = docs
        for stage, f in corpus_pipeline.STAGES[:-1]:
            kept = f(spark, kept, path)
            assert kept.columns == docs.columns, stage
        out = corpus_pipeline.run(spark, path).toPandas()
        if name == "none":
            assert not len(out)
            continue
        # Clean documents go on; of the copies 3 and 4 one is left, and the row without an id stays.
        ids = set(out.doc_id.dropna())
        assert 2 in ids and len(ids & {3, 4}) == 1 and len(ids & set(range(100, 130))) >= 20 and out.doc_id.isna().any()
        for _, s in out.groupby("sequence_id"):
            s = s.sort_values("offset")
            assert list(s.offset) == list(s.length.cumsum() - s.length) and s.length.sum() <= 1024
