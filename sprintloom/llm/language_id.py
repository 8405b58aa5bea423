"""Language identification: known words first, character n-grams for the rest.

A known word contributes its log frequency in each language. A word that was not learned falls back
to its longest known character n-grams: four characters, then three, two and one, with marks for the
word's ends. All counts cover all training rows; the model keeps the most frequent words and n-grams.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sprintloom.llm.common import Shipped, give_back_memory, most_frequent, worker_cache
from sprintloom.session import written

UNKNOWN = "und"
# Bounds of the broadcast model: about 40 bytes a word or n-gram and 4 a cell, that is an item's log frequency in a
# language. Each language has an equal share of the items.
WORDS, GRAMS = 100_000, 30_000
CELLS = 8_000_000
ORDERS = (4, 3, 2, 1)
SMOOTH = 0.5
_WORD = re.compile(r"[^\W\d_]+")
_PIECE = 1 << 20
# Entries that a task counts before it hands them on, some hundred bytes each.
_FLUSH = 500_000


def words_of(text: str) -> Iterator[list[str]]:
    """Lower-cased runs of letters, a list per piece of a long text; pieces end between words."""
    start, end = 0, len(text)
    while start < end:
        stop = min(start + _PIECE, end)
        while stop < end and text[stop].isalnum():
            stop += 1
        yield _WORD.findall(text[start:stop].lower())
        start = stop


def grams_of(word: str, order: int) -> list[str]:
    """The n-grams of a word between end marks; single characters come without marks."""
    marked = word if order == 1 else f"^{word}$"
    return [marked[i:i + order] for i in range(len(marked) - order + 1)]


@dataclass
class Model:
    """Log frequencies: a row per word or n-gram and a column per language, the latter sorted by name."""

    languages: list[str]
    words: dict[str, int]
    word_logs: np.ndarray
    grams: dict[int, dict[str, int]]
    gram_logs: dict[int, np.ndarray]

    def known_grams(self, word: str) -> tuple[int, list[int]]:
        """The longest order of which the word has known n-grams, and their rows; (0, []) without any."""
        for order in ORDERS:
            row_of = self.grams.get(order, {}).get
            rows = [row for row in map(row_of, grams_of(word, order)) if row is not None]
            if rows:
                return order, rows
        return 0, []

    def unseen(self, word: str) -> np.ndarray:
        """The mean log frequencies of a word's known n-grams of the longest order that has any."""
        order, rows = self.known_grams(word)
        return self.gram_logs[order][rows].mean(0, dtype=np.float64) if rows else np.zeros(len(self.languages))

    def predict(self, text: str | None) -> tuple[str, float]:
        total, letters = np.zeros(len(self.languages)), False
        for words in words_of(text or ""):
            letters = letters or any(c.isalpha() for w in words for c in w)
            counts = Counter(words)
            index = np.fromiter(map(self.words.get, counts, repeat(-1)), np.int64, len(counts))
            times = np.fromiter(counts.values(), np.float64, len(counts))
            total += times[index >= 0] @ self.word_logs[index[index >= 0]]
            rest, shares = {o: [] for o in ORDERS}, {o: [] for o in ORDERS}
            for word, new in zip(counts, (index < 0).tolist()):
                if new:  # each known n-gram has an equal share of the word
                    order, rows = self.known_grams(word)
                    if rows:
                        rest[order].extend(rows)
                        shares[order].extend(repeat(counts[word] / len(rows), len(rows)))
            for order, rows in rest.items():
                if rows:
                    total += np.array(shares[order]) @ self.gram_logs[order][rows]
        if not letters or not self.languages:
            return UNKNOWN, 0.0
        share = np.exp(total - total.max())
        best = int(np.argmax(share))
        return self.languages[best], float(1 / share.sum())


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worker_cache("language")
    counts: dict[str, Counter] = {}
    held = 0

    def out() -> Iterator[pa.RecordBatch]:
        for lang, words in counts.items():
            yield pa.record_batch([pa.array([lang] * len(words), pa.string()), pa.array(list(words), pa.string()),
                                   pa.array(list(words.values()), pa.int64())], names=["lang", "word", "n"])
        counts.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            own = counts.setdefault(lang, Counter())
            for words in words_of(text.as_py()):
                own.update(words)
        held = sum(map(len, counts.values()))
        if held > _FLUSH:
            yield from out()
    yield from out()
    give_back_memory()


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[tuple[str, int], dict[str, int]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, order), own in counts.items():
            yield pa.record_batch([pa.array([lang] * len(own), pa.string()), pa.array([order] * len(own), pa.int32()),
                                   pa.array(list(own), pa.string()), pa.array(list(own.values()), pa.int64())],
                                  names=["lang", "size", "gram", "n"])
        counts.clear()

    for batch in batches:
        for lang, word, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
            for order in ORDERS:
                own = counts.setdefault((lang, order), {})
                for gram in grams_of(word, order):
                    own[gram] = own.get(gram, 0) + n
        if sum(map(len, counts.values())) > _FLUSH:
            yield from out()
    yield from out()
    give_back_memory()


def _logs(top: pd.DataFrame, item: str, languages: list[str], totals: np.ndarray) -> tuple[dict[str, int], np.ndarray]:
    """Smoothed log frequencies of the kept items; ``totals`` are those of all items, kept or not."""
    if not len(top):
        return {}, np.zeros((0, len(languages)), np.float32)
    wide = top.pivot(index=item, columns="lang", values="n").reindex(columns=languages).fillna(0).sort_index()
    logs = np.log(wide.to_numpy() + SMOOTH) - np.log(totals + SMOOTH * (len(wide) + 1))
    return {w: i for i, w in enumerate(wide.index)}, logs.astype(np.float32)


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", words: int = WORDS, grams: int = GRAMS) -> Model:
    """A model of all rows with a text and a language; without any, a model that knows no language.

    Words and n-grams are counted in the tasks and summed by Spark. The model keeps, of each language, its share
    of about ``words`` words and ``grams`` n-grams of each order, the most frequent ones, so a small language does not
    lose its words to a large one; with very many languages the shares shrink until the model has ``CELLS`` cells.
    The driver receives the counts of these items, a row for a cell at most, in blocks, and totals by language.
    """
    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).dropna()
    counted = rows.mapInArrow(_count_words, "lang string, word string, n long").groupBy("word", "lang").agg(F.sum("n").alias("n"))
    counted = written(counted, "word-counts")
    totals = {r.lang: r.n for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(totals)

    def top(table: DataFrame, item: str, size: int) -> pd.DataFrame:
        share = max(1, min(size, CELLS // max(1, len(languages))) // max(1, len(languages)))
        chosen = written(most_frequent(table, "n", share, item, "lang").select(item).distinct(), "chosen")
        cells = written(table.join(chosen, item, "left_semi").select(item, "lang", "n"), "cells")
        blocks = 1 + cells.count() // 1_000_000
        return pd.concat([cells.filter(F.pmod(F.xxhash64(item), F.lit(blocks)) == b).toPandas() for b in range(blocks)])

    known, word_logs = _logs(top(counted, "word", words), "word", languages, np.array([totals[x] for x in languages], float))
    by_gram = counted.select("lang", "word", "n").mapInArrow(
        _count_grams, "lang string, size int, gram string, n long").groupBy("size", "gram", "lang").agg(F.sum("n").alias("n"))
    by_gram = written(by_gram, "gram-counts")
    gram_index, gram_logs = {}, {}
    for order in ORDERS:
        own = by_gram.filter(F.col("size") == order)
        sums = {r.lang: r.n for r in own.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
        gram_index[order], gram_logs[order] = _logs(
            top(own, "gram", grams), "gram", languages, np.array([sums.get(x, 0) for x in languages], float))
    return Model(languages, known, word_logs, gram_index, gram_logs)


def predict(model: Model, text: Column, spark) -> Column:
    """``struct<lang_pred, score>`` of each whole text.

    The score is the share of the predicted language in the likelihoods of all. Equal likelihoods go
    to the first language by name. A null text, one without a letter, or a model without languages
    gives ``und`` with score 0.
    """
    shared = Shipped(spark, "language", model)

    @F.pandas_udf("lang_pred string, score double")
    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang_pred", "score"])

    return of(text)


def identify(docs: DataFrame, train: Column, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, train, lang_pred, score`` for every row, learned from the rows where ``train`` holds.

    Rows with a null text or language are not learned from. Repeated rows count as often as
    they occur. Other columns are not read. An empty table gives no rows.
    """
    model = learn(docs.filter(train), text, lang)
    return docs.select(F.col(doc_id).alias("doc_id"), train.alias("train"),
                       predict(model, F.col(text), docs.sparkSession).alias("p")).select("doc_id", "train", "p.*")


def keep_identified(docs: DataFrame, least: float = 0.0, text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` without the rows whose language is ``und``, that the model cannot place, or that score below ``least``; all
    columns stay.

    The model is learned from all rows that have a text and a language. It cannot place a text of which it knows no word
    and no n-gram: then all languages have the same likelihood. Without any row to learn from nothing can be
    told apart, and only rows without a letter go.
    """
    model = learn(docs, text, lang)
    if not model.languages:
        return docs.filter(F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    even = 1 / len(model.languages) + 1e-9 if len(model.languages) > 1 else 0.0
    found = predict(model, F.col(text), docs.sparkSession)
    return docs.filter((found["lang_pred"] != UNKNOWN) & (found["score"] > even) & (found["score"] >= least))
