import random

import pytest

import corpus_pipeline
from seekspark.llm import near_dedup
from tests.llm.test_operators import docs_of, odd_rows, words


def shingles(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def plain_roots(texts, least):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


def near_texts():
    """Bases of 60 to 800 words, each with copies whose similarity is 0.6 to 0.95, and a group that many keys hold."""
    r, texts = random.Random(4), []
    for i in range(60):
        w = words(r.choice([60, 200, 800]), i)
        texts.append(" ".join(w))
        for rate in (0.005, 0.01, 0.02, 0.04):
            texts.append(" ".join(x if r.random() > rate else f"zz{r.random()}" for x in w))
    big = words(300, 99)
    texts += [" ".join(big[:i] + ["other"] + big[i + 1 :]) for i in range(80)]
    return texts + ["", None, " ", "A b", "a  b", "a b c d e", "b c d e f"]


@pytest.mark.parametrize("small_run", [near_dedup.SMALL_RUN, 2])
def test_similar_against_plain(spark, monkeypatch, small_run):
    monkeypatch.setattr(near_dedup, "SMALL_RUN", small_run)
    texts = near_texts()
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.similar(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == plain_roots(texts, 0.8)


def test_pipeline_stage_finds_similarity_08(spark):
    texts = near_texts()
    kept = corpus_pipeline.one_of_each(spark, docs_of(spark, texts), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i, r in enumerate(plain_roots(texts, 0.8)) if i == r]


def test_simhash_links_near_copies(spark):
    """Candidates of operator 9: a third and more of the group's links, and none of texts that share nothing."""
    big = words(300, 99)
    texts = [" ".join(big[:i] + ["other"] + big[i + 1 :]) for i in range(80)] + [" ".join(words(300, i)) for i in range(40)]
    classes = near_dedup.summarised(docs_of(spark, texts), 5)
    of = {r["c"]: r["doc_id"] for r in classes.collect()}
    pairs = [(of[r["a"]], of[r["b"]]) for r in near_dedup.simhash_pairs(classes).collect()]
    assert len(pairs) > 25 and all(a < 80 and b < 80 for a, b in pairs)


def test_similar_odd_rows(spark):
    df = odd_rows(spark)
    assert near_dedup.similar(df).count() == df.count()
    assert near_dedup.drop_similar(df).filter("doc_id in (3, 4)").count() == 1
    assert near_dedup.similar(df.limit(0)).count() == 0
