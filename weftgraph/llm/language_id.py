"""Operator 1, language identification: known words first, backing off to ever shorter character n-grams.

A model holds, for each language, the log frequency of the most frequent words of a bounded sample
of labelled texts, and of their character n-grams of five orders. A word that the model knows is
scored by its word frequencies; any other by the longest order of n-grams of which it has a known
one. A text's scores are summed over all of its words and turned into probabilities.

Texts that are null or hold no letter are ``und`` with score 0. Empty tables give empty results, a
model fitted on no labelled row calls every text ``und``; ties between languages go to the first
language in alphabetical order. A text of any length is scored whole, in parts of bounded memory. Repeated rows each
get their own result; other columns are left alone.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.common import WordTable, hash_share, per_worker, small_batches, stored, trimmed

UNDETERMINED = "und"
WORDS = re.compile(r"[^\W\d_]+")
RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


class Logs:
    """key -> row of one matrix: as a dict of arrays, but in a tenth of the memory."""

    def __init__(self, keys: list[str], rows: np.ndarray):
        self.place, self.rows = dict(zip(keys, range(len(keys)), strict=True)), rows

    def __contains__(self, key: str) -> bool:
        return key in self.place

    def __getitem__(self, key: str) -> np.ndarray:
        return self.rows[self.place[key]]

    def get(self, key: str) -> np.ndarray | None:
        at = self.place.get(key)
        return None if at is None else self.rows[at]


@dataclass
class LanguageModel:
    langs: list[str] = field(default_factory=list)
    words: Logs | dict[str, np.ndarray] = field(default_factory=dict)
    grams: list[Logs | dict[str, np.ndarray]] = field(default_factory=list)

    def vector(self, word: str) -> np.ndarray:
        """Centred log frequencies of one word: by the word, else by its longest known n-grams, else zeros."""
        known = self.words.get(word)
        if known is not None:
            return known
        if not word.isascii() and not any(map(str.isalpha, word)):
            return np.zeros(len(self.langs))
        padded = f"<{word}>"
        for order in range(len(self.grams), 0, -1):
            table = self.grams[order - 1]
            hits = [table[g] for i in range(len(padded) - order + 1) if (g := padded[i : i + order]) in table]
            if hits:
                return sum(hits) / len(hits)
        return np.zeros(len(self.langs))


def _log_frequencies(keys: list[str], counts: np.ndarray, totals: np.ndarray, kept: np.ndarray, smooth: float = 0.5) -> Logs:
    logs = np.log(counts + smooth) - np.log(totals + smooth * max(1, len(keys)))
    logs -= logs.mean(axis=1, keepdims=True)
    return Logs([k for k, good in zip(keys, kept.tolist(), strict=True) if good], logs[kept].astype(np.float32))


def units(words: DataFrame, order: int) -> DataFrame:
    """Words (l, w, n) -> (size, unit, l, n): the words themselves, as size 0, and their character n-grams of 1 to ``order``."""
    padded = F.concat(F.lit("<"), F.col("w"), F.lit(">"))

    def of_size(n: int):
        return lambda i: F.struct(F.lit(n).alias("size"), F.substr(padded, i, F.lit(n)).alias("unit"))

    grams = [F.transform(F.sequence(F.lit(1), F.length(padded) - (n - 1)), of_size(n)) for n in range(1, order + 1)]
    # a sequence would run down if a word were shorter than the n-gram
    grams = [F.when(F.length(padded) >= n, g).otherwise(F.array().cast("array<struct<size:int,unit:string>>")) for n, g in enumerate(grams, 1)]
    whole = F.array(F.struct(F.lit(0).alias("size"), F.col("w").alias("unit")))
    return words.select("l", "n", F.inline(F.concat(whole, *grams))).groupBy("size", "unit", "l").agg(F.sum("n").alias("n"))


def fit(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    key: str = "doc_id",
    docs_per_lang: int = 1000,
    max_langs: int = 200,
    max_words: int = 60_000,
    max_grams: int = 40_000,
    order: int = 5,
) -> LanguageModel:
    """Learn from about ``docs_per_lang`` labelled rows of each language, taken by a hash of ``key``; Spark counts their words and n-grams.

    Each language has an equal share of the model's ``max_words`` words and, of each order, ``max_grams`` n-grams, its most
    frequent ones, which is also what the driver gets. Every language of the labels is learned; more than ``max_langs`` are an
    error, since the model has a column for each. Rows with a null text or lang are left out.
    """
    labelled = docs.select(F.col(key).alias("k"), F.col(lang).alias("l"), F.col(text).alias("t")).where("l is not null")
    sizes = labelled.groupBy("l").count().orderBy(F.desc("count"), "l").limit(max_langs + 1).collect()
    if len(sizes) > max_langs:
        raise ValueError(f"more than max_langs = {max_langs} languages")
    if not sizes:
        return LanguageModel()
    langs = sorted(r["l"] for r in sizes)
    share = F.create_map(*[x for r in sizes for x in (F.lit(r["l"]), F.lit(min(1 << 20, -(-docs_per_lang * (1 << 20) // r["count"]))))])
    sample = labelled.where(hash_share(F.col("k"), F.coalesce(share[F.col("l")], F.lit(0)))).where("t is not null")
    words = sample.select("l", F.explode(F.regexp_extract_all(F.lower("t"), F.lit(r"([\p{L}]+)"))).alias("w")).groupBy("l", "w").agg(F.count("*").alias("n"))
    counted = stored(units(words, order))
    totals = {r["size"]: np.array([r[f"n{i}"] for i in range(len(langs))], float) for r in _by_lang(counted.groupBy("size"), langs).collect()}
    if not totals:
        return LanguageModel(langs)
    quota = F.when(F.col("size") == 0, -(-max_words // len(langs))).otherwise(-(-max_grams // len(langs)))
    frequent = Window.partitionBy("size", "l").orderBy(F.desc("n"), "unit")
    chosen = counted.withColumn("r", F.row_number().over(frequent)).where(F.col("r") <= quota).select("size", "unit").distinct()
    found = _by_lang(counted.join(chosen, ["size", "unit"]).groupBy("size", "unit"), langs).toArrow().sort_by([("size", "ascending"), ("unit", "ascending")])
    size, counts = found["size"].to_numpy(), np.stack([found[f"n{i}"].to_numpy() for i in range(len(langs))], axis=1).astype(float)
    tables = []
    for n in range(order + 1):
        mine = np.flatnonzero(size == n)
        c = counts[mine]
        kept = c.sum(axis=1) > (1 if n == 0 else 0)  # a word that was met once goes by its n-grams
        tables.append(_log_frequencies(found["unit"].take(mine).to_pylist(), c, totals.get(n, np.zeros(len(langs))), kept))
    return LanguageModel(langs, tables[0], tables[1:])


def _by_lang(grouped, langs: list[str]) -> DataFrame:
    """Counts n0, n1, ... of each language."""
    return grouped.agg(*[F.sum(F.when(F.col("l") == x, F.col("n")).otherwise(0)).alias(f"n{i}") for i, x in enumerate(langs)])


def predictor(docs: DataFrame, model: LanguageModel):
    """A column function: text -> struct(lang_pred, score). ``docs`` only lends its session."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    name = uuid.uuid4().hex

    @F.pandas_udf(RESULT)
    @trimmed
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model, table = per_worker(name, lambda: (m := shared.value, WordTable(m.vector, max(1, len(m.langs)))))
        for texts in batches:
            names, scores = [], []
            for t in texts:
                words = WORDS.findall(t.lower()) if t else []
                if not model.langs or not words or not any(any(map(str.isalpha, w)) for w in words):
                    names.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                z = sum(x.sum(axis=0) for x in table.parts(words))
                best = int(z.argmax())
                names.append(model.langs[best])
                scores.append(float(1 / np.exp(z - z[best]).sum()))
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    return predict


def language_id(docs: DataFrame, model: LanguageModel, text: str | Column = "text") -> DataFrame:
    """``docs`` with a struct column ``language`` (lang_pred, score), replacing one of that name."""
    return docs.withColumn("language", predictor(docs, model)(F.col(text) if isinstance(text, str) else text))
