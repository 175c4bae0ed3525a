"""Toxicity by classifier chains of linear models.

The categories are predicted one after another. Each model is a logistic regression over words and word beginnings, and over
the probabilities of the categories before it. For training these are out-of-fold: the labelled rows are dealt into folds by
a hash of their text, so copies share a fold, and each fold's probabilities come from a model fitted on the others. For
scoring they come from the models fitted on all training rows. Rejection compares the last probability with a threshold that
the out-of-fold predictions choose.

Training takes at most TRAIN_ROWS labelled rows, those with the smallest hashes of their ids (the documented bound of what
reaches the driver; the model holds at most MAX_FEATURES words). Scoring reads every whole text.

Null texts count as empty and have the probabilities of a text without known words. A null label or a label without a text
trains nothing; a category without both outcomes has a constant probability, and without labels nothing is rejected.
Repeated rows are scored each.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.shared import column, map_batches, unused

TRAIN_ROWS, MAX_FEATURES, MIN_DOCUMENTS, FOLDS = 8192, 65536, 4, 5
#: Distinct words of the training rows that reach the driver, in bytes.
TRAIN_BYTES = 128 << 20
#: Hash buckets of the first count; fewer than 65,536 texts are counted in each.
BUCKETS = 1 << 22
#: Letters of a word beginning.
BEGINNING = 5
L2, STEPS = 0.5, 60
#: A feature takes part in a model if its rows' outcomes are this many standard deviations from the mean.
SCREEN = 4.5
WORD = re.compile(r"[^\W\d_]+")


def terms(text: str | None) -> set[str]:
    """The distinct lower-case words of a whole text."""
    return set(WORD.findall((text or "").lower()))


def expand(words: set[str]) -> set[str]:
    return words | {w[:BEGINNING] + "*" for w in words if len(w) > BEGINNING}


@dataclass
class Rows:
    """Sparse rows of ones: the features of row i are at[bounds[i]:bounds[i + 1]]."""

    at: np.ndarray
    bounds: np.ndarray

    def take(self, chosen: np.ndarray) -> Rows:
        sizes = np.diff(self.bounds)[chosen]
        parts = [self.at[self.bounds[i] : self.bounds[i + 1]] for i in chosen]
        return Rows(np.concatenate(parts) if parts else self.at[:0], np.concatenate(([0], np.cumsum(sizes))))

    def dot(self, w: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0.0], np.cumsum(w[self.at])))
        return sums[self.bounds[1:]] - sums[self.bounds[:-1]]

    def back(self, r: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.at, np.repeat(r, np.diff(self.bounds)), size)


@dataclass
class Linear:
    words: np.ndarray
    before: np.ndarray
    bias: float

    def score(self, x: Rows, chain: np.ndarray) -> np.ndarray:
        return _sigmoid(x.dot(self.words) + chain @ self.before + self.bias)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-3, 1 - 1e-3)
    return np.log(p / (1 - p))


def fit(x: Rows, chain: np.ndarray, y: np.ndarray, size: int) -> Linear:
    """Logistic regression with an L2 penalty on the weights, by L-BFGS, over the features that the given rows' outcomes screen."""
    n, k = len(y), chain.shape[1]
    rate = (y.sum() + 0.5) / (n + 1)
    if n == 0 or y.min() == y.max():
        return Linear(np.zeros(size), np.zeros(k), float(_logit(np.array([y[0] if n else 0.0]))[0]))
    seen = x.back(np.ones(n), size)
    apart = np.abs(x.back(y, size) - seen * rate) / np.sqrt(np.maximum(seen, 1) * rate * (1 - rate))
    chosen = np.flatnonzero((apart >= SCREEN) & (seen >= MIN_DOCUMENTS))
    place = np.full(size, -1)
    place[chosen] = np.arange(len(chosen))
    at = place[x.at]
    x = Rows(at[at >= 0], np.concatenate(([0], np.cumsum(at >= 0)))[x.bounds])
    whole, size = size, len(chosen)

    def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
        z = x.dot(p[:size]) + chain @ p[size:-1] + p[-1]
        r = _sigmoid(z) - y
        value = np.logaddexp(0, z).sum() - (z * y).sum() + L2 / 2 * (p[:-1] @ p[:-1])
        return value, np.concatenate((x.back(r, size), chain.T @ r, [r.sum()])) + L2 * np.append(p[:-1], 0)

    p = np.zeros(size + k + 1)
    p[-1] = math.log(rate / (1 - rate))
    value, g = loss(p)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(STEPS):
        q, kept = -g.copy(), []
        for s, d in reversed(moves):
            a = (s @ q) / (s @ d)
            kept.append(a)
            q -= a * d
        q *= (moves[-1][0] @ moves[-1][1]) / (moves[-1][1] @ moves[-1][1]) if moves else 1 / max(1.0, np.abs(g).max())
        for (s, d), a in zip(moves, reversed(kept), strict=True):
            q += s * (a - (d @ q) / (s @ d))
        step, slope = 1.0, g @ q
        while step > 1e-6:
            new, ng = loss(p + step * q)
            if new <= value + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, d = step * q, ng - g
        if s @ d > 1e-12:
            moves = [*moves[-7:], (s, d)]
        done = value - new < 1e-6 * abs(value)
        p, value, g = p + s, new, ng
        if done:
            break
    words = np.zeros(whole)
    words[chosen] = p[:size]
    return Linear(words, p[size:-1], float(p[-1]))


@dataclass
class Chain:
    categories: list[str]
    index: dict[str, int] = field(default_factory=dict)
    models: list[Linear] = field(default_factory=list)
    threshold: float = 2.0
    out_of_fold: np.ndarray | None = None

    def rows(self, texts: Iterable[set[str]]) -> Rows:
        get = self.index.get
        found = [np.sort(np.fromiter((i for i in map(get, expand(t)) if i is not None), np.int32)) for t in texts]  # a set's order would change sums
        return Rows(np.concatenate([np.zeros(0, np.int32), *found]), np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(np.int64))

    def score(self, texts: Sequence[set[str]]) -> np.ndarray:
        """Probabilities, a column for each category, each model fed with those before it."""
        x, chain, out = self.rows(texts), np.zeros((len(texts), 0)), []
        for model in self.models:
            out.append(model.score(x, chain))
            chain = np.column_stack((chain, _logit(out[-1])))
        return np.column_stack(out) if out else np.zeros((len(texts), len(self.categories)))


def _common_features(texts: Sequence[str]) -> list[str]:
    """The MAX_FEATURES most frequent features of at least MIN_DOCUMENTS texts. Features are counted by name only where their hash bucket has that many."""
    place = lambda f: zlib.crc32(f.encode()) & (BUCKETS - 1)
    buckets = np.zeros(BUCKETS, np.uint16)
    for t in texts:
        buckets[np.unique(np.fromiter(map(place, expand(set(t.split()))), np.int64))] += 1
    seen = Counter(f for t in texts for f in expand(set(t.split())) if buckets[place(f)] >= MIN_DOCUMENTS)
    return sorted((f for f, n in seen.items() if n >= MIN_DOCUMENTS), key=lambda f: (-seen[f], f))[:MAX_FEATURES]


def train(texts: Sequence[str], labels: np.ndarray, categories: Sequence[str], folds: Sequence[int]) -> Chain:
    """texts: each one's distinct words, joined by spaces. labels: a row for each text, a column for each category, 0 or 1. folds: each text's fold."""
    chain = Chain(list(categories))
    if not len(texts):
        return chain
    common = _common_features(texts)
    chain.index = {f: i for i, f in enumerate(common)}
    x, size, folds = chain.rows(set(t.split()) for t in texts), len(common), np.asarray(folds)
    before = np.zeros((len(texts), 0))
    for c in range(len(categories)):
        y, honest = labels[:, c].astype(float), np.zeros(len(texts))
        for k in range(FOLDS):
            rest, held = np.flatnonzero(folds != k), np.flatnonzero(folds == k)
            if len(held):
                honest[held] = fit(x.take(rest), before[rest], y[rest], size).score(x.take(held), before[held])
        chain.models.append(fit(x, before, y, size))
        before = np.column_stack((before, _logit(honest)))
    chain.out_of_fold = _sigmoid(before)
    chain.threshold = best_threshold(chain.out_of_fold[:, -1], labels[:, -1])
    return chain


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The threshold of the highest F1, at least a half; over 1 (nothing is rejected) without positives."""
    if not y.sum():
        return 2.0
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = np.where(p[order] >= 0.5, 2 * hits / (np.arange(1, len(p) + 1) + y.sum()), -1)
    best = int(np.argmax(f1))
    after = p[order][best + 1] if best + 1 < len(p) else 0.0
    return float(max(0.5, (p[order][best] + after) / 2)) if f1[best] >= 0 else 0.5


def train_on(docs: DataFrame, labels: DataFrame, categories: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """categories: name to SQL condition over labels, in the order of the chain.

    TRAIN_ROWS rows at most, and TRAIN_BYTES of their distinct words: the rows whose ids and texts have the least hashes.
    """
    named = labels.select(column(id_col).alias("_id"), *[F.expr(sql).cast("int").alias(f"_y{i}") for i, sql in enumerate(categories.values())]).dropna().groupBy("_id").agg(*[F.max(f"_y{i}").alias(f"_y{i}") for i in range(len(categories))])
    chosen = named.orderBy(F.xxhash64("_id"), "_id").limit(TRAIN_ROWS)
    texts = docs.select(column(id_col).alias("_id"), column(text_col).cast("string").alias("_text"))
    labelled = texts.join(F.broadcast(chosen), "_id")  # TRAIN_ROWS rows of a few numbers

    def make():
        def one(batch):
            found = [sorted(terms(t)) for t in batch.column(1).to_pylist()]
            return {"place": batch.column(0), "words": [" ".join(w) for w in found], **{f"_y{i}": batch.column(i + 2) for i in range(len(categories))}}

        return one

    ys = [f"_y{i}" for i in range(len(categories))]
    read = map_batches(labelled.select(F.xxhash64("_id").alias("place"), "_text", *ys), make, "place bigint, words string, " + ", ".join(f"{y} int" for y in ys))
    rows, size = [], 0
    for r in read.orderBy("place", "words", *ys).limit(TRAIN_ROWS).toLocalIterator():
        size += len(r["words"])
        if size > TRAIN_BYTES:
            break
        rows.append(r)
    rows.sort(key=lambda r: (r["words"], *(r[y] for y in ys)))
    return train([r["words"] for r in rows], np.array([[r[y] for y in ys] for r in rows]).reshape(-1, len(ys)), list(categories), [zlib.crc32(r["words"].encode()) % FOLDS for r in rows])


def _shared(docs: DataFrame, chain: Chain):
    # At most MAX_FEATURES words and a few models.
    return docs.sparkSession.sparkContext.broadcast(Chain(chain.categories, chain.index, chain.models, chain.threshold))


def score(docs: DataFrame, chain: Chain, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns keep (all if not given), p_<category> for each category, and toxic (boolean). A column of keep of one of these names is an error."""
    keep = docs.columns if keep is None else keep
    names = [f"p_{c}" for c in chain.categories]
    if clash := {c.lower() for c in keep} & {n.lower() for n in [*names, "toxic"]}:
        raise ValueError(f"columns {sorted(clash)} are the names of scores; rename them or leave them out")
    shared, kinds = _shared(docs, chain), {f.name: f.dataType.simpleString() for f in docs.schema}

    def make():
        model = shared.value

        def one(batch):
            p = model.score([terms(t) for t in batch.column(len(keep)).to_pylist()])
            return {c: batch.column(i) for i, c in enumerate(keep)} | {n: p[:, i] for i, n in enumerate(names)} | {"toxic": p[:, -1] >= model.threshold}

        return one

    source = docs.select(*[column(c) for c in keep], column(text_col).cast("string").alias(unused(docs, "scored")))
    return map_batches(source, make, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), *(f"`{n}` double" for n in names), "toxic boolean"]))


def accepted(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """The rows of docs that aren't toxic, with docs' columns, whatever their names."""
    shared, names, place = _shared(docs, chain), docs.columns, docs.columns.index(text_col)

    def make():
        model = shared.value

        def one(batch):
            fine = model.score([terms(t) for t in batch.column(len(names)).to_pylist()])[:, -1] < model.threshold
            return dict(zip(names, batch.filter(pa.array(fine)).columns, strict=False))

        return one

    source = docs.select(*[column(c) for c in names], column(names[place]).cast("string").alias(unused(docs, "scored")))
    return map_batches(source, make, ", ".join("`" + f.name.replace("`", "``") + f"` {f.dataType.simpleString()}" for f in docs.schema))
