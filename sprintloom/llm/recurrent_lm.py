"""Scoring of whole documents by a gated recurrent language model and by a unigram base.

Counts cover all training tokens. The network (``gru``) has weights for the most frequent tokens; the others share its last
class in proportion to their smoothed counts. It is trained on all training documents: a round takes
a slice of them, each task trains a copy of the weights on what it reads, and the copies are
averaged by tokens. Scoring reads each document once. Counts of frequent tokens travel with the
model; a document's rare tokens meet theirs in a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from sprintloom.llm.common import Shipped, give_back_memory, most_frequent
from sprintloom.llm.gru import Adagrad, Net, score, train
from sprintloom.session import written

# The end of a document is the token without letters.
END = b""


@dataclass(frozen=True)
class Settings:
    """``words`` tokens have weights and ``known`` counts are broadcast with them: together about 15 MB at most."""

    words: int = 4096
    known: int = 131_072
    hidden: int = 16
    classes: int = 24
    rate: float = 0.3
    rounds: int = 3
    lanes: int = 512
    window: int = 24
    # Training tokens that a copy of the weights takes in a round, so copies grow with the corpus.
    copy_tokens: int = 1 << 22
    # Tokens that a task lays out on its lanes at a time: enough for lanes as long as long documents, so
    # few steps run with most lanes done.
    group_tokens: int = 1 << 22
    # Weights that travel in one row when copies are averaged.
    block: int = 1 << 14


@dataclass
class Model:
    """Everything that scoring needs, of bounded size. Totals are over all training tokens."""

    settings: Settings
    ids: dict[bytes, int]
    logs: np.ndarray
    tokens: int
    distinct: int
    net: Net

    @property
    def base_total(self) -> float:
        return math.log10(self.tokens + 0.5 * (self.distinct + 1))

    @property
    def rest_total(self) -> float:
        """log10 of what the smoothed counts of the last class add up to, one unseen token included."""
        return math.log10(self._rest())

    def _rest(self) -> float:
        own = float(np.sum(10 ** self.logs[:self.net.words] - 0.5))
        return max(0.0, self.tokens - own) + 0.5 * (max(0, self.distinct - self.net.words) + 1)


# Bytes of texts whose words are held at a time, and no less than one text.
_SLICE, _COUNTED = 1 << 22, 1 << 23


def text_slices(texts: pa.Array, size: int = _SLICE) -> Iterator[tuple[int, int]]:
    """Bounds of neighbouring texts of about ``size`` bytes together."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + size, "right")))
        yield start, stop
        start = stop


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words of all texts, one after the other, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, offsets = lists.flatten(), lists.offsets.to_numpy()
    full = pc.greater(pc.binary_length(words), 0)  # white space at either end leaves empty ones
    before = np.r_[0, np.cumsum(full.to_numpy(zero_copy_only=False))]
    return words.filter(full), before[offsets[1:]] - before[offsets[:-1]]


def with_ends(codes: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The codes with ``end`` behind each text's, and the place of each text's first."""
    places = np.cumsum(counts + 1) - 1
    out = np.empty(len(codes) + len(counts), np.int32)
    own = np.ones(len(out), bool)
    own[places] = False
    out[own], out[places] = codes, end
    return out, np.r_[0, places[:-1] + 1]


def numbered(words: pa.Array, ids: pa.Array, rest: int) -> np.ndarray:
    """The number of each word, ``rest`` for those that have none."""
    return pc.fill_null(pc.index_in(words, value_set=ids), rest).to_numpy(zero_copy_only=False).astype(np.int32)


def _words_of(ids: dict[bytes, int]) -> pa.Array:
    return pa.array([w.decode() for w in ids], pa.string())


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ends = 0
    for batch in batches:
        texts = batch.column(0)
        ends += len(texts)
        for start, stop in text_slices(texts, _COUNTED):
            found = split_words(texts[start:stop])[0].dictionary_encode()
            counts = np.bincount(found.indices.to_numpy(), minlength=len(found.dictionary)).astype(np.int64)
            yield pa.record_batch([found.dictionary.cast(pa.binary()), pa.array(counts)], names=["word", "n"])
    if ends:
        yield pa.record_batch([pa.array([END], pa.binary()), pa.array([ends], pa.int64())], names=["word", "n"])
    give_back_memory()


def token_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word, n``: how often each token occurs; each document adds one end, the empty word."""
    return docs.select(F.col(text)).mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _trained(shared, settings: Settings):
    """Trains a copy of the shared weights on the task's documents and returns it in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, net = shared.value
        net, own_words = net.with_flat(net.flat()), _words_of(ids)
        optimizer, docs, held, seen = Adagrad(net, settings.rate), [], 0, 0

        def settle() -> None:
            nonlocal held, seen
            train(net, docs, optimizer, settings.lanes, settings.window)
            seen, held = seen + held, 0
            docs.clear()

        for batch in batches:
            for start, stop in text_slices(batch.column(0)):
                words, counts = split_words(batch.column(0)[start:stop])
                flat, firsts = with_ends(numbered(words, own_words, net.words), counts, ids.get(END, net.words))
                for doc in np.split(flat, firsts[1:]):
                    docs.append(doc)
                    held += len(doc)
                    if held >= settings.group_tokens:
                        settle()
        if docs:
            settle()
        flat = net.flat() if seen else np.empty(0, np.float32)
        parts = [flat[at:at + settings.block].tobytes() for at in range(0, len(flat), settings.block)]
        task = TaskContext.get().partitionId()
        yield pa.record_batch([pa.array(range(len(parts)), pa.int32()), pa.array([task] * len(parts), pa.int32()),
                               pa.array([float(seen)] * len(parts), pa.float64()), pa.array(parts, pa.binary())],
                              names=["block", "copy", "weight", "weights"])
        give_back_memory()

    return run


_BLOCKS = "block int, copy int, weight double, weights binary"


def _averaged(copies: DataFrame) -> dict[int, np.ndarray]:
    """The copies' average by tokens, block by block; first in groups of copies, so no task reads all of them."""

    def mean(rows: pd.DataFrame) -> pd.DataFrame:
        total, out = rows["weight"].sum(), 0.0
        for weight, weights in zip(rows["weight"], rows["weights"]):
            out = out + np.frombuffer(weights, np.float32).astype(np.float64) * (weight / total)
        return pd.DataFrame({"block": [rows["block"].iloc[0]], "copy": [0], "weight": [total], "weights": [out.astype(np.float32).tobytes()]})

    some = copies.groupBy("block", F.pmod("copy", F.lit(64)).alias("part")).applyInPandas(mean, _BLOCKS)
    return {r.block: np.frombuffer(r.weights, np.float32) for r in some.groupBy("block").applyInPandas(mean, _BLOCKS).collect()}


def learn(docs: DataFrame, counts: DataFrame, settings: Settings = Settings(), text: str = "text") -> Model:
    """A model of all ``docs``, of which ``counts`` are the ``token_counts``. Without any it gives every text probability one.

    The driver receives up to ``known`` of the most frequent tokens and in each round one averaged set of
    weights. Tokens are numbered by falling count, ties in byte order."""
    spark = docs.sparkSession
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    tokens, distinct = total.n or 0, total.v
    top = most_frequent(counts, "n", settings.known, "word").orderBy(F.desc("n"), "word").collect()
    ids, numbers = {bytes(r.word): i for i, r in enumerate(top)}, np.array([r.n for r in top], np.float64)
    own = numbers[:settings.words]
    model = Model(settings, ids, np.log10(numbers + 0.5), tokens, distinct, None)
    model.net = Net.new(own, tokens - own.sum() + 0.5 * (distinct - len(own) + 1), settings.hidden, settings.classes)
    copies = max(1, math.ceil(tokens / settings.rounds / settings.copy_tokens))
    frequent = {w: i for w, i in ids.items() if i < len(own)}
    for turn in range(settings.rounds if tokens else 0):
        part = docs.select(F.col(text).alias("text")).filter(F.pmod(F.xxhash64("text"), F.lit(settings.rounds)) == turn)
        shared = Shipped(spark, "scoring", (frequent, model.net))
        blocks = _averaged(part.coalesce(copies).mapInArrow(_trained(shared, settings), _BLOCKS))
        if blocks:
            model.net = model.net.with_flat(np.concatenate([blocks[i] for i in sorted(blocks)]))
        shared.unpersist()
    return model


_SCORED = ("row long, doc_id long, held_out boolean, n_tokens long, known long, base double, net double, "
           "rare array<struct<word: binary, n: long>>")


def _rare(words: pa.Array, docs: np.ndarray, count: int) -> pa.ListArray:
    """For each of ``count`` texts the words that are given for it and how often."""
    found = words.dictionary_encode()
    pairs, times = np.unique(docs * max(1, len(found.dictionary)) + found.indices.to_numpy(), return_counts=True)
    owner, code = np.divmod(pairs, max(1, len(found.dictionary)))
    items = pa.StructArray.from_arrays([found.dictionary.cast(pa.binary()).take(pa.array(code)), pa.array(times.astype(np.int64))], ["word", "n"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(count + 1)), pa.int32()), items)


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        settings, words, known = model.settings, model.net.words, len(model.ids)
        own_words, end = _words_of(model.ids), model.ids.get(END, known)
        logs = np.r_[model.logs, 0.0]  # an unknown token's comes from the join
        shares = np.where(np.arange(known + 1) >= words, logs, 0.0)
        row = TaskContext.get().partitionId() << 33
        docs, held, facts = [], 0, []

        def settle() -> Iterator[pa.RecordBatch]:
            nonlocal held
            nets, at = score(model.net, docs, settings.lanes) / math.log(10), 0
            for columns, rest in facts:
                net = nets[at:at + len(rest)] + rest
                at += len(rest)
                yield pa.record_batch([*columns[:-1], pa.array(net, pa.float64()), columns[-1]],
                                      names=["row", "doc_id", "held_out", "n_tokens", "known", "base", "net", "rare"])
            docs.clear()
            facts.clear()
            held = 0

        for batch in batches:
            for start, stop in text_slices(batch.column(2)):
                size = stop - start
                found, counts = split_words(batch.column(2)[start:stop])
                codes = numbered(found, own_words, known)
                unknown = codes == known
                rare, owner = found.filter(pa.array(unknown)), np.repeat(np.arange(size), counts)[unknown]
                if end == known:
                    rare, owner = pa.concat_arrays([rare, pa.array([""] * size, rare.type)]), np.r_[owner, np.arange(size)]
                flat, firsts = with_ends(codes, counts, end)
                # A token of the last class adds its own share of that class: here where the count is known.
                total = lambda values: np.add.reduceat(values, firsts)
                lengths, last = counts + 1, total((flat >= words).astype(np.int64))
                facts.append(([
                    pa.array(np.arange(row, row + size)), batch.column(0)[start:stop], batch.column(1)[start:stop], pa.array(lengths, pa.int64()),
                    pa.array(total((flat < known).astype(np.int64)), pa.int64()), pa.array(total(logs[flat]) - lengths * model.base_total, pa.float64()),
                    _rare(rare, owner, size)], total(shares[flat]) - last * model.rest_total))
                docs.extend(np.minimum(d, words) for d in np.split(flat, firsts[1:]))
                row, held = row + size, held + len(flat)
                if held >= settings.group_tokens:
                    yield from settle()
        if docs:
            yield from settle()
        give_back_memory()

    return run


def score_documents(docs: DataFrame, held_out: Column, settings: Settings = Settings(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``docs``.

    Rows where ``held_out`` is not true are learned from. Scores are log10 probabilities of whole texts. Null texts count as
    empty and consist of the end alone. Repeated rows are learned from and scored each. Without training rows
    every token is unknown and both scores are 0. Other columns are not read; no rows give no rows.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"),
                       F.col(text).alias("text"))
    training = rows.filter(~F.col("held_out"))
    counts = written(token_counts(training), "token-counts")
    model = learn(training, counts, settings)
    shared = Shipped(docs.sparkSession, "scoring", model)
    scored = written(rows.mapInArrow(_scored(shared), _SCORED), "scored")
    rare = scored.select("row", F.explode("rare").alias("r")).select("row", "r.word", F.col("r.n").alias("times"))
    met = rare.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("logs"),
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("met"))
    logs = F.coalesce("logs", F.lit(0.0))
    return scored.join(met, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("met", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"), (F.col("base") + logs).alias("base_score"),
        (F.col("net") + logs).alias("score"))
