"""Operator 3, toxicity: bags of subword embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the embeddings of its character n-grams (hashed into buckets) and of itself, a text the mean of all
of its words; a softmax layer gives its logit. Embeddings and softmax start at random and are trained together, by Adam
with weight decay, on a bounded sample of labelled texts. A fifth of them is put aside first: on it the number of epochs is
chosen, and the logistic curve that turns a logit into a probability is fitted; then all are trained on for as long.

Null and empty texts and texts without letters get the share of label 1 among the labels. Without labelled rows of both
labels every score is 0. A text of any length is scored whole, in parts of bounded memory. Equal texts have equal scores; repeated
rows each get their own; empty tables give no rows; other columns are left alone.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.common import WordTable, hash_share, per_worker, small_batches, trimmed

WORDS = re.compile(r"[^\W\d_]+")
ORDERS = (3, 4, 5, 6)
#: Of the averages, which are small: a few words of a text tell.
SCALE = 50.0
#: Of a worker's memory, for the values of words, which are slow to find.
WORD_BYTES = 112 << 20


@dataclass
class ToxicityModel:
    buckets: int = 1 << 20
    weight: np.ndarray = field(default_factory=lambda: np.zeros(1, np.float32))  # of each bucket: embedding times softmax
    bias: float = 0.0
    slope: float = 1.0
    offset: float = 0.0
    prior: float = 0.0

    def word(self, w: str) -> tuple[float]:
        return (float(self.weight[subwords(w, self.buckets)].mean()),)


def subwords(word: str, buckets: int) -> list[int]:
    """Bucket numbers of a word and its character n-grams."""
    padded = f"<{word}>"
    out = [crc32(padded.encode()) % buckets]
    for n in ORDERS:
        out += [crc32(padded[i : i + n].encode()) % buckets for i in range(len(padded) - n + 1)]
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


class _Trainer:
    """Full-batch training over bags of words: each text a list of word numbers with their shares."""

    def __init__(self, texts: list[list[str]], y: np.ndarray, parts_of: dict[str, np.ndarray], buckets: int, dim: int, min_texts: int, decay: float, rate: float, seed: int):
        self.y, self.decay, self.rate = y, decay, rate
        vocabulary: dict[str, int] = {}
        text, word, share = [], [], []
        for i, t in enumerate(texts):
            ids, n = np.unique([vocabulary.setdefault(w, len(vocabulary)) for w in t], return_counts=True)
            text.append(np.full(len(ids), i, np.int32))
            word.append(ids.astype(np.int32))
            share.append(n / len(t))
        self.text, self.word, self.share = (np.concatenate(x) for x in (text, word, share))
        parts = [parts_of[w] for w in vocabulary]
        self.n_parts = np.array([len(p) for p in parts])
        seen = np.zeros(buckets, np.int32)
        for ids in word:
            seen[np.unique(np.concatenate([parts[w] for w in ids]))] += 1
        self.flat = np.flatnonzero(seen >= min_texts)  # rarer ones would only be learned by heart
        place = np.full(buckets, -1, np.int32)
        place[self.flat] = np.arange(len(self.flat))
        local, owner = place[np.concatenate(parts)], np.repeat(np.arange(len(parts), dtype=np.int32), self.n_parts)
        self.local, self.owner = local[local >= 0], owner[local >= 0]
        rng = np.random.default_rng(seed)
        self.E, self.W, self.b = rng.normal(0, 0.01, (dim, len(self.flat))), rng.normal(0, 1, (dim, 2)), np.zeros(2)
        self.moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (self.E, self.W, self.b)]
        self.steps = 0

    def epochs(self, n: int) -> None:
        texts, words = len(self.y), len(self.n_parts)
        for _ in range(n):
            v = [np.bincount(self.owner, e.take(self.local), words) / self.n_parts for e in self.E]
            x = SCALE * np.stack([np.bincount(self.text, self.share * d.take(self.word), texts) for d in v], axis=1)
            z = x @ self.W + self.b
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(texts), self.y] -= 1
            g = p / texts
            gx = SCALE * g @ self.W.T
            gv = [np.bincount(self.word, self.share * d.take(self.text), words) / self.n_parts for d in np.ascontiguousarray(gx.T)]
            ge = np.stack([np.bincount(self.local, d.take(self.owner), self.E.shape[1]) for d in gv]) + self.decay * self.E
            self.steps += 1
            for x_, g_, m in zip((self.E, self.W, self.b), (ge, x.T @ g, g.sum(axis=0)), self.moments, strict=True):
                m[0] += 0.1 * (g_ - m[0])
                m[1] += 0.01 * (g_ * g_ - m[1])
                x_ -= self.rate * (m[0] / (1 - 0.9**self.steps)) / (np.sqrt(m[1] / (1 - 0.99**self.steps)) + 1e-9)

    def model(self, buckets: int) -> ToxicityModel:
        weight = np.zeros(buckets, np.float32)
        weight[self.flat] = SCALE * ((self.W[:, 1] - self.W[:, 0]) @ self.E)
        return ToxicityModel(buckets, weight, float(self.b[1] - self.b[0]))


class _Bags:
    """Texts as bags of words for scoring with several models."""

    def __init__(self, texts: list[list[str]], parts_of: dict[str, np.ndarray]):
        vocabulary: dict[str, int] = {}
        self.word = np.array([vocabulary.setdefault(w, len(vocabulary)) for t in texts for w in t])
        self.size = np.array([len(t) for t in texts])
        parts = [parts_of[w] for w in vocabulary]
        self.flat, self.n_parts = np.concatenate(parts), np.array([len(p) for p in parts])

    def logits(self, model: ToxicityModel) -> np.ndarray:
        first = lambda n: np.append(0, np.cumsum(n)[:-1])
        value = np.add.reduceat(model.weight[self.flat].astype(float), first(self.n_parts)) / self.n_parts
        return np.add.reduceat(value[self.word], first(self.size)) / self.size + model.bias


def _curve(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float, float]:
    """Slope and offset of a logistic curve through logits, and its loss."""
    mean, spread, a, b = z.mean(), z.std() + 1e-9, 1.0, 0.0
    u = (z - mean) / spread
    for _ in range(2000):
        p = sigmoid(a * u + b)
        a -= (weight * (p - y) * u).mean() + 1e-3 * a
        b -= (weight * (p - y)).mean()
    p = np.clip(sigmoid(a * u + b), 1e-9, 1 - 1e-9)
    return a / spread, b - a * mean / spread, float(-(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).mean())


def train(
    texts: list[str], labels: list[int], buckets: int = 1 << 20, dim: int = 2, min_texts: int = 8, decay: float = 1e-5, rate: float = 0.08, epochs: int = 75, step: int = 15, seed: int = 11, share: float | None = None
) -> ToxicityModel:
    """Train on labelled texts in numpy; see the module text. share: of label 1 among all labelled rows, for the probabilities."""
    rows = [(w, int(y)) for t, y in zip(texts, labels, strict=True) if (w := WORDS.findall((t or "").lower()))]
    y = np.array([y for _, y in rows])
    if not len(y) or y.all() or not y.any():
        return ToxicityModel(buckets, np.zeros(buckets, np.float32))
    words = [w for w, _ in rows]
    aside = np.zeros(len(y), bool)
    for label in (0, 1):  # every fifth of each label
        aside[np.flatnonzero(y == label)[4::5]] = True
    share = float(y.mean() if share is None else share)
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    if not (y[aside] == 1).any():  # too few to put any aside
        aside[:] = True
    settings = ({w: np.array(subwords(w, buckets), np.int32) for w in set().union(*words)}, buckets, dim, min_texts, decay, rate, seed)
    tried = words if aside.all() else [w for w, x in zip(words, aside, strict=True) if not x]
    trainer = _Trainer(tried, y if aside.all() else y[~aside], *settings)
    bags = _Bags([w for w, x in zip(words, aside, strict=True) if x], settings[0])
    best = None
    for n in range(step, epochs + 1, step):
        trainer.epochs(step)
        made = _curve(bags.logits(trainer.model(buckets)), y[aside], weight[aside])
        if best is None or made[2] < best[0][2]:
            best = made, n
        elif n >= best[1] + 2 * step:
            break
    (slope, offset, _), n = best
    if not aside.all() or trainer.steps > n:
        trainer = _Trainer(words, y, *settings)
        trainer.epochs(n)
    return replace(trainer.model(buckets), slope=slope, offset=offset, prior=share)


def logit(model: ToxicityModel, table: WordTable, words: list[str]) -> float:
    """The mean value of a text's words, and the bias."""
    return sum(float(x.sum()) for x in table.parts(words)) / len(words) + model.bias


def score_of(model: ToxicityModel, text: str | None, table: WordTable | None = None) -> float:
    """The probability of label 1 for one text."""
    words = WORDS.findall(text.lower()) if text else []
    if not words or model.prior == 0:
        return model.prior
    return float(sigmoid(model.slope * logit(model, table or WordTable(model.word, 1), words) + model.offset))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", per_label: int = 2000, **params) -> ToxicityModel:
    """Train on about ``per_label`` labelled rows of each label, taken by a hash of ``key``: the bound of what the driver gets.

    Rows with a null key or label are left out; of several labels of one key the largest holds.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("k")).agg(F.max(label).cast("int").alias("y"))
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    share = [-(-per_label * (1 << 20) // max(1, sizes.get(y, 0))) for y in (0, 1)]
    chosen = known.where(hash_share(F.col("k"), F.when(F.col("y") == 1, share[1]).otherwise(share[0]))).orderBy(F.xxhash64("k"), "k").limit(4 * per_label)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(chosen), "k").orderBy(F.xxhash64("k"), "t").limit(4 * per_label).collect()
    share = sizes.get(1, 0) / max(1, sum(sizes.values()))
    return train([r["t"] for r in rows], [r["y"] for r in rows], share=share, **params)


def scorer(docs: DataFrame, model: ToxicityModel):
    """A column function: text -> probability of label 1. ``docs`` only lends its session."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    name = uuid.uuid4().hex

    @F.pandas_udf(T.DoubleType())
    @trimmed
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model, table = per_worker(name, lambda: (m := shared.value, WordTable(m.word, 1, WORD_BYTES)))
        for texts in batches:
            yield pd.Series([score_of(model, t, table) for t in texts], dtype=float)

    return score


def toxicity(docs: DataFrame, model: ToxicityModel, text: str | Column = "text") -> DataFrame:
    """``docs`` with a column ``toxicity`` between 0 and 1, replacing one of that name."""
    return docs.withColumn("toxicity", scorer(docs, model)(F.col(text) if isinstance(text, str) else text))
