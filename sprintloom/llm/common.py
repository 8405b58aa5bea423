"""Small helpers that several of the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import pickle
import sys
import uuid
from collections.abc import Iterator
from types import ModuleType

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# ASCII white space. ``bytes.split()`` and ``bytes.lower()`` use these very bytes and A-Z only.
_SPACES = b" \t\n\x0b\x0c\r"
_PIECE = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(doc_id: str | Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id counts as the empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(divisor))


def word_lists(text: str | None, size: int = _PIECE) -> Iterator[list[bytes]]:
    """The lower-cased words of a text in order, a list per piece, so that the lists of a very long
    text are never held together. Words are runs of bytes other than ASCII white space."""
    data = (text or "").encode().lower()
    start, end = 0, len(data)
    while start < end:
        stop = start + size
        while stop < end and data[stop] not in _SPACES:
            stop += 1
        yield data[start:stop].split()
        start = stop


def worker_cache(purpose: str) -> dict:
    """A dictionary that lives as long as the Python worker, which runs many tasks one after another. A worker
    keeps that of one purpose at a time: what another stage has left in it is given up."""
    home = sys.modules.setdefault("_sprintloom_worker_caches", ModuleType("_sprintloom_worker_caches"))
    kept = home.__dict__.setdefault("kept", {})
    others = [p for p in kept if p != purpose]
    if others:
        for other in others:
            del kept[other]
        give_back_memory()
    return kept.setdefault(purpose, {})


def give_back_memory() -> None:
    """Hand what Python and Arrow have freed in this worker back to the system: workers are many and live long."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


class Shipped:
    """A value of bounded size for all tasks. It travels with its classes, so executors need not have them installed, and is
    unpacked once per Python worker, into the ``worker_cache`` of its purpose."""

    def __init__(self, spark: SparkSession, purpose: str, value: object):
        self.name, self.purpose = uuid.uuid4().hex, purpose
        self.data = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self) -> object:
        cache = worker_cache(self.purpose).setdefault("shipped", {})
        if self.name not in cache:
            while len(cache) >= 2:
                cache.pop(next(iter(cache)))
            cache[self.name] = pickle.loads(self.data.value)
            self.data.__dict__.pop("_value", None)  # the packed form is not needed beside it
        return cache[self.name]

    def unpersist(self) -> None:
        self.data.unpersist()


def most_frequent(counted: DataFrame, count: str, most: int, item: str, within: str | None = None) -> DataFrame:
    """The rows of the largest counts, about ``most``; of each ``within`` if that is given, whose null takes no part.

    They are all above a bound that is found from a histogram of 32 steps for each doubling, which is small
    whatever the table. Of the step in which the bound lies, those rows are taken whose ``item`` has a hash below the share
    that is left, so equal counts are divided alike each time, and nothing is sorted.
    """
    step = F.floor(F.log2(F.col(count)) * 32).cast("int")
    group = F.lit("") if within is None else F.col(within)
    rows = counted.filter((F.col(count) > 0) & group.isNotNull())
    sizes: dict[str, list] = {}
    for row in rows.groupBy(group.alias("group"), step.alias("step")).agg(F.count("*").alias("n")).collect():
        sizes.setdefault(row.group, []).append((row.step, row.n))
    cuts = []
    for name, steps in sizes.items():
        left, bound, share = most, 1 << 30, 0
        for at, n in sorted(steps, reverse=True):
            if n > left:
                share = int((1 << 31) * max(0.0, left - 4 * left ** 0.5) / n)
                break
            left, bound = left - n, at
        # The step below the last whole one that has rows is the one that is divided.
        part = max((at for at, _ in steps if at < bound), default=bound - 1)
        cuts.append((name, bound, part, share))
    if not cuts:
        return counted.filter(F.lit(False))
    cut = counted.sparkSession.createDataFrame(cuts, "_group string, _whole int, _part int, _share long")
    met = rows.join(F.broadcast(cut), group == F.col("_group"))
    place = F.pmod(F.xxhash64(item), F.lit(1 << 31))
    taken = (step >= F.col("_whole")) | ((step == F.col("_part")) & (place < F.col("_share")))
    return met.filter(taken).select(*counted.columns)


# A group is hot when it holds more than 1/HOT_SHARE of the rows, so fewer than HOT_SHARE groups are.
HOT_SHARE = 1000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, spread: Column) -> DataFrame:
    """``rows`` left-joined with ``groups``: one row per non-null ``key``, and its size ``n``, which is dropped.

    Hot groups are broadcast, as there are fewer than HOT_SHARE. All other rows meet their group in a
    shuffle; there the rows of hot groups are dealt by ``spread``. ``groups`` is read three times, so it
    should be a written table. ``rows`` have no column ``_hot`` or ``_to``.
    """
    total = groups.agg(F.sum("n")).first()[0] or 0
    large = F.col("n") * HOT_SHARE > total
    values = [c for c in groups.columns if c not in (key, "n")]
    packed = groups.select(key, F.struct(*values).alias("_value"), large.alias("_large"))
    hot = packed.filter("_large").select(key, F.col("_value").alias("_hot"))
    cold = packed.filter("not _large").select(F.concat(F.lit("="), key).alias("_to"), "_value")
    met = rows.join(F.broadcast(hot), key, "left").withColumn(
        "_to", F.when(F.col("_hot").isNull(), F.concat(F.lit("="), F.coalesce(key, F.lit("")))).otherwise(
            F.concat(F.lit("-"), F.xxhash64(spread).cast("string"))))
    value = F.coalesce("_hot", "_value")
    return met.join(cold, "_to", "left").select(
        *[f"`{c}`" for c in rows.columns], *[value[c].alias(c) for c in values])
