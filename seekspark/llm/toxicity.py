"""Toxicity by classifier chains: categories are predicted in turn, later ones with the earlier ones' probabilities.

Each category has a logistic model over words and word beginnings (which stand for all endings of a stem), a few
measures of the text's style and the log-odds of the categories before it. In training those come from models of
other folds. A fold's model takes its features, too, from the counts of the other folds, so a model never learns
from a probability that has seen the row's own label, and the threshold is set on probabilities that have not.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekspark.llm import bytehash
from seekspark.llm.common import pin, trimmed, union_all, without

#: Labelled rows that the models are fitted on, at most; features of a category, at most; folds.
SAMPLE, FEATURES, FOLDS = 8000, 1024, 4
#: Code points of the word beginnings; 0: the whole word.
BEGINNINGS = (0, 4, 5, 6)
#: A feature must be in so many rows, and so many standard deviations from the rate of the labels.
LEAST_ROWS, LEAST_SCORE = 4, 4.0
STYLE = 4
_TAGS = bytehash.mix(np.arange(1, len(BEGINNINGS) + 1, dtype=np.uint64))
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_SIGN = np.zeros(256, bool)
_SIGN[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = True


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, text number) pairs, repeats included, and a (texts, STYLE) array of measures between 0 and 1."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    hashes, of = [], []
    sums = np.zeros((len(raw), STYLE))
    for buf, lengths, numbers in bytehash.groups(raw, bytehash.ALNUM):
        at = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        for j, table in enumerate((_UPPER, _SIGN)):
            np.add.at(sums[:, j], numbers, np.add.reduceat(table[buf].astype(np.int64), at))
        np.add.at(sums[:, 2], numbers, lengths)
        low = np.where(_UPPER[buf], buf + np.uint8(32), buf)
        starts, ends = bytehash.spans_of(low, bytehash.ALNUM)
        text = numbers[np.searchsorted(np.cumsum(lengths), starts, side="right")]
        np.add.at(sums[:, 3], text, 1)
        cut = bytehash.Sums(low)
        lead = (low & 0xC0) != 0x80
        places = np.append(np.flatnonzero(lead), len(low))
        number = np.cumsum(lead) - 1
        for tag, n in zip(_TAGS, BEGINNINGS):
            if n == 0:
                m = np.ones(len(starts), bool)
                upto = ends
            else:
                upto = places[np.minimum(number[starts] + n, len(places) - 1)]
                m = upto <= ends
            hashes.append(cut.hashes(starts[m], upto[m]) ^ tag)
            of.append(text[m])
    empty = np.zeros(0, np.int64)
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    size = np.maximum(sums[:, 2:3], 1)
    style = np.column_stack((sums[:, :2] / size, np.minimum(1, 5 * sums[:, 3:] / size), np.minimum(1, np.log1p(sums[:, 3:]) / 12)))
    return h, np.concatenate(of or [empty]), style


@dataclass
class Link:
    """One category's model: weights of hashed features (sorted), of style measures and of earlier log-odds."""

    name: str
    known: np.ndarray
    weights: np.ndarray
    rest: np.ndarray
    bias: float


@dataclass
class Chain:
    links: list[Link] = field(default_factory=list)
    #: Out-of-fold probabilities of the training rows, by category, and the labels.
    held_out: dict[str, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    def threshold(self, name: str) -> float:
        """The cut, in twentieths, of the best F1 on the out-of-fold probabilities; of equals the nearest to 0.5.

        0.5 where nothing was held out, or no row has the category.
        """
        p, y = self.held_out.get(name, (np.zeros(0), np.zeros(0)))
        if not (y == 1).any():
            return 0.5
        cuts = np.arange(2, 19) / 20
        over = p[:, None] >= cuts
        f1 = 2 * (over & (y == 1)[:, None]).sum(axis=0) / (over.sum(axis=0) + (y == 1).sum())
        return float(cuts[np.lexsort((cuts, np.abs(cuts - 0.5), -f1))[0]])

    def probabilities(self, texts: list[str]) -> np.ndarray:
        """(texts, categories)."""
        h, of, style = features(texts)
        earlier = np.zeros((len(texts), 0))
        out = np.zeros((len(texts), len(self.links)))
        for j, link in enumerate(self.links):
            z = link.bias + np.column_stack((style, earlier)) @ link.rest
            if len(link.known):
                sieve = np.zeros(1 << 16, bool)
                sieve[(link.known & np.uint64(0xFFFF)).astype(np.int64)] = True
                m = sieve[(h & np.uint64(0xFFFF)).astype(np.int64)]
                hm, om = h[m], of[m]
                i = np.minimum(np.searchsorted(link.known, hm), len(link.known) - 1)
                hit = link.known[i] == hm
                pairs = np.unique(om[hit] * np.int64(1 << 20) + i[hit])  # a feature counts once a text
                np.add.at(z, pairs >> 20, link.weights[pairs & ((1 << 20) - 1)])
            out[:, j] = _sigmoid(z)
            earlier = np.column_stack((earlier, np.clip(z, -6, 6) / 6))
        return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 2e-4, rounds: int = 250) -> tuple[np.ndarray, float]:
    """Weights and bias, by accelerated gradient steps on the mean log loss with an L2 penalty."""
    return _fit_with_ones(np.column_stack((x, np.ones(len(x), x.dtype))), y, l2, rounds)


def _fit_with_ones(x: np.ndarray, y: np.ndarray, l2: float = 2e-4, rounds: int = 250) -> tuple[np.ndarray, float]:
    """``fit_logistic`` of ``x`` whose last column is ones."""
    # The largest eigenvalue bounds the curvature.
    v = np.ones(x.shape[1], x.dtype)
    for _ in range(12):
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v) + 1e-12
    step = 1 / (0.25 * float(np.linalg.norm(x @ v) ** 2) / len(x) + l2)
    w = look = np.zeros(x.shape[1], x.dtype)
    t = 1.0
    for _ in range(rounds):
        g = x.T @ (_sigmoid(x @ look) - y).astype(x.dtype) / len(x) + l2 * np.append(look[:-1], 0).astype(x.dtype)
        new = look - step * g
        t, old = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        look = new + (old - 1) / t * (new - w)
        w = new
    return w[:-1].astype(float), float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], sample: int = SAMPLE, seed: int = 5) -> Chain:
    """Fit a chain over ``categories``: name to a 0/1 column of ``labels`` (doc_id, ...), predicted in that order.

    At most ``sample`` labelled ids are used, those that hash lowest, each with one text (the smallest, if rows
    repeat an id); this bound is the only limit, and features are counted over all of them. Folds go by a hash of
    the id. A category with one label value only gets its rate as a constant. No labelled row: all probabilities
    are 0.
    """
    names = list(categories)
    marks = labels.select("doc_id", *[c.cast("double").alias(n) for n, c in categories.items()]).dropna()
    marks = marks.groupBy("doc_id").agg(*[F.max(n).alias(n) for n in names])
    few = pin(marks.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(sample))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(few.select("doc_id")), "doc_id", "left_semi")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text")).join(F.broadcast(few), "doc_id")
    fold = F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(FOLDS)).cast("int")

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 128):
                s = b.slice(at, 128)
                h, of, style = features([t or "" for t in s.column(1).to_pylist()])
                order = np.lexsort((h, of))
                h, of = h[order], of[order]
                m = np.ones(len(h), bool)
                m[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
                parts = np.split(h[m], np.searchsorted(of[m], np.arange(1, s.num_rows)))
                cells = [s.column(0), pa.array([p.tobytes() for p in parts], pa.binary()), pa.array(list(style), pa.list_(pa.float64()))]
                marks = [s.column(2 + j) for j in range(1 + len(names))]
                yield pa.RecordBatch.from_arrays([*cells, *marks], ["doc_id", "found", "style", "fold", *names])

    schema = "doc_id long, found binary, style array<double>, fold int, " + ", ".join(f"`{n}` double" for n in names)
    table = pin(rows.select("doc_id", "text", fold.alias("fold"), *names).mapInArrow(trimmed(opened), schema))
    base = {r["fold"]: r for r in table.groupBy("fold").agg(F.count("*").alias("n"), *[F.sum(n).alias(n) for n in names]).collect()}
    if not base:
        return Chain([Link(n, np.zeros(0, np.uint64), np.zeros(0), np.zeros(STYLE + j), -30.0) for j, n in enumerate(names)])

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 256):
                for fold, s in b.iloc[at : at + 256].groupby("fold"):
                    own = [np.frombuffer(f, np.uint64) for f in s["found"]]
                    known, place = np.unique(np.concatenate(own), return_inverse=True)
                    out = {"h": known.view(np.int64), "fold": fold, "n": np.bincount(place, minlength=len(known)).astype(float)}
                    for n in names:
                        out[n] = np.bincount(place, np.repeat(s[n].to_numpy(), [len(x) for x in own]), len(known))
                    yield pd.DataFrame(out)

    kinds = "h long, fold int, n double, " + ", ".join(f"`{n}` double" for n in names)
    cells = [F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0.0)).alias(f"{c}_{f}") for c in ["n", *names] for f in range(FOLDS)]
    counts = table.mapInPandas(trimmed(counted), kinds).groupBy("h").agg(F.sum("n").alias("n"), *cells)
    counts = pin(counts.filter(F.col("n") >= LEAST_ROWS))

    def best(name: str, left_out: int | None) -> DataFrame:
        """The features that tell most about a category in all folds but one (or in all)."""
        folds = [f for f in range(FOLDS) if f != left_out]
        total = sum(base[f]["n"] for f in folds if f in base)
        rate = sum(base[f][name] for f in folds if f in base) / max(total, 1)
        n, y = (reduce(add, [F.col(f"{c}_{f}") for f in folds]) for c in ("n", name))
        score = F.abs(y - n * rate) / F.sqrt(n * max(rate * (1 - rate), 1e-9))
        told = counts.filter(n >= LEAST_ROWS).select("h", score.alias("score")).filter(F.col("score") >= LEAST_SCORE)
        place = -1 if left_out is None else left_out
        return told.orderBy(F.desc("score"), "h").limit(FEATURES).select(F.lit(name).alias("name"), F.lit(place).alias("fold"), "h")

    took = union_all([best(n, f) for n in names for f in [*range(FOLDS), None]]).collect()
    chosen = {(n, f): np.zeros(0, np.uint64) for n in names for f in range(-1, FOLDS)}
    for key in chosen:
        chosen[key] = np.sort(np.array([r["h"] for r in took if (r["name"], r["fold"]) == key], np.int64).view(np.uint64))
    every = np.unique(np.concatenate(list(chosen.values())))

    def narrowed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = [np.flatnonzero(np.isin(every, np.frombuffer(f, np.uint64))).astype(np.int32).tobytes() for f in b["found"]]
            yield b.drop(columns="found").assign(found=own)

    got = table.mapInPandas(trimmed(narrowed), "doc_id long, style array<double>, fold int, " + ", ".join(f"`{n}` double" for n in names) + ", found binary")
    return _fit_chain(got.orderBy("doc_id").toPandas(), names, chosen, every)


def _fit_chain(data: pd.DataFrame, names: list[str], chosen: dict[tuple[str, int], np.ndarray], every: np.ndarray) -> Chain:
    """``chosen``: features by category and the fold that their choice leaves out (-1: none); ``found`` points into ``every``."""
    own = [np.frombuffer(f, np.int32) for f in data["found"]]
    of, flat = np.repeat(np.arange(len(own)), [len(x) for x in own]), np.concatenate(own)
    style, fold = np.stack(data["style"].to_numpy()), data["fold"].to_numpy()
    chain, earlier = Chain(), np.zeros((len(data), 0))

    def matrix(known: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Features, style, earlier log-odds and ones of the rows; filled in place, since copies of it fill the driver."""
        place, at = np.full(len(every), -1), np.full(len(data), -1)
        place[np.searchsorted(every, known)] = np.arange(len(known))
        at[rows] = np.arange(len(rows))
        x = np.zeros((len(rows), len(known) + STYLE + earlier.shape[1] + 1), np.float32)
        m = (place[flat] >= 0) & (at[of] >= 0)
        x[at[of[m]], place[flat[m]]] = 1
        x[:, len(known) : len(known) + STYLE] = style[rows]
        x[:, len(known) + STYLE : -1] = earlier[rows]
        x[:, -1] = 1
        return x

    for name in names:
        y = data[name].to_numpy()
        known = chosen[name, -1]
        rate = float(y.mean())
        if rate in (0.0, 1.0):
            chain.links.append(Link(name, known, np.zeros(len(known)), np.zeros(STYLE + earlier.shape[1]), 30.0 if rate else -30.0))
            z = np.full(len(y), chain.links[-1].bias)
        else:
            z = np.zeros(len(y))
            for f in range(FOLDS):
                rest, out = fold != f, fold == f
                if rest.any() and out.any() and 0 < y[rest].mean() < 1:
                    w, b = _fit_with_ones(matrix(chosen[name, f], np.flatnonzero(rest)), y[rest])
                    z[out] = matrix(chosen[name, f], np.flatnonzero(out))[:, :-1] @ w + b
                else:
                    z[out] = np.log(rate / (1 - rate))
            w, b = _fit_with_ones(matrix(known, np.arange(len(data))), y)
            chain.links.append(Link(name, known, w[: len(known)], w[len(known) :], b))
        chain.held_out[name] = (_sigmoid(z), y)
        earlier = np.column_stack((earlier, np.clip(z, -6, 6) / 6))
    return chain


def score(docs: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """Add ``p_<category>`` for each category. Null and empty texts score like a text without words.

    Input columns of those names are replaced. Texts are read whole, whatever their length. Rows are scored each
    for itself, so repeated rows and ids do not matter; an empty table gives no rows.
    """
    names = [f"p_{link.name}" for link in chain.links]
    docs = without(docs, *names)
    schema = docs.select("*", *[F.lit(0.0).alias(n) for n in names]).schema
    sent = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                b = whole.slice(at, 128)
                p = own.probabilities([t or "" for t in b.column(b.schema.get_field_index(text)).to_pylist()])
                cells = [pa.array(np.ascontiguousarray(p[:, j])) for j in range(len(names))]
                yield pa.RecordBatch.from_arrays([*b.columns, *cells], [*b.schema.names, *names])

    return docs.mapInArrow(trimmed(run), schema)


def labelled_chain(docs: DataFrame, labels: DataFrame) -> Chain:
    """The chain over what ``labels`` (doc_id, quality, toxic) tells: low quality, then toxic."""
    return fit(docs, labels, {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1})


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float | None = None) -> DataFrame:
    """``docs`` with p_low_quality, p_toxic and ``toxic``, 1 where p_toxic is ``threshold`` or more.

    None takes the threshold that does best on the out-of-fold probabilities of the labelled rows. Input columns
    of those three names are replaced; for odd rows see ``score`` and ``fit``.
    """
    chain = labelled_chain(docs, labels)
    least = chain.threshold("toxic") if threshold is None else threshold
    return score(without(docs, "toxic"), chain).withColumn("toxic", (F.col("p_toxic") >= least).cast("int"))
