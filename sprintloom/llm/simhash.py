"""SimHash near-duplicates by covering locality-sensitive hashing."""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from sprintloom.llm.common import word_lists, worker_cache
from sprintloom.llm.components import components
from sprintloom.session import written

BITS = 64
# Buckets up to this size are compared whole. The rest go another way that loses nothing either.
SMALL_BUCKET = 256


def fingerprint_of(text: str | None, words: int = 3) -> int:
    """The unsigned 64-bit SimHash of a text's word shingles, repeats included.

    A bit is set if it is set in more than half of the shingles' XXH64 (seed 42). A text with fewer
    words than a shingle is one shingle; a null text or one without words has the fingerprint zero.
    """
    digest, ones, total, tail = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64), 0, []
    for piece in word_lists(text):
        run = tail + piece
        for at in range(0, len(run) - words + 1, 1 << 16):
            part = run[at:at + (1 << 16) + words - 1]
            shingles = map(b" ".join, zip(*(part[i:] for i in range(words))))
            hashes = np.fromiter((digest(s, 42) for s in shingles), np.uint64, len(part) - words + 1)
            bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(0, dtype=np.int64)
            total += len(hashes)
        tail = run[max(0, len(run) - words + 1):]
    if not total:
        return digest(b" ".join(tail), 42) if tail else 0
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprint(text: Column, words: int = 3) -> Column:
    """``fingerprint_of`` as a signed long column."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        worker_cache("fingerprints")  # what other stages left in the worker goes
        found = np.fromiter((fingerprint_of(t, words) for t in texts), np.uint64, len(texts))
        return pd.Series(found.view(np.int64))

    return of(text)


def covering_masks(radius: int) -> list[int]:
    """2^(radius+1) - 1 masks of which at least one avoids any ``radius`` bits.

    Every bit gets a non-zero vector of radius+1 binary digits. The mask of a non-zero vector v holds the bits
    whose vector has an odd product with v. The vectors of ``radius`` bits span at most ``radius``
    dimensions, so some v is orthogonal to all of them and its mask has none of them. That holds for any
    vectors; they are dealt in turn if there are few, else those of a few random deals are taken whose
    smallest mask is largest, so that no table has large buckets.
    """
    count = 2 ** (radius + 1) - 1

    def masks(vectors: list[int]) -> list[int]:
        return [sum(1 << bit for bit, w in enumerate(vectors) if (w & v).bit_count() % 2) for v in range(1, count + 1)]

    if count < BITS:
        return masks([bit % count + 1 for bit in range(BITS)])
    deals = [masks(random.Random(seed).sample(range(1, count + 1), BITS)) for seed in range(20)]
    return max(deals, key=lambda m: min(x.bit_count() for x in m))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def spanning_links(values: np.ndarray, within: int) -> list[tuple[int, int]]:
    """Index pairs that join ``values`` as all pairs of at most ``within`` differing bits would: a minimum
    spanning tree without its longer edges, so of n values there are fewer than n pairs."""
    size = len(values)
    if size == 2:
        return [(0, 1)] if int(values[0] ^ values[1]).bit_count() <= within else []
    best, parent, outside = np.full(size, BITS + 1), np.zeros(size, np.int64), np.ones(size, bool)
    found, at = [], 0
    for _ in range(size - 1):
        outside[at] = False
        far = np.bitwise_count(values ^ values[at])
        nearer = outside & (far < best)
        best[nearer], parent[nearer] = far[nearer], at
        at = int(np.argmin(np.where(outside, best, BITS + 2)))
        if best[at] <= within:
            found.append((int(parent[at]), at))
    return found


_FOUND = "crowded boolean, a long, b long"


def _bucket_links(within: int, small: int):
    """Rows ``k, fp`` sorted by bucket ``k`` to links (a, b) of small buckets; rows (k, fp) of larger
    ones pass through as ``crowded``. At most one small bucket is held between batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, open_crowd = None, np.empty(0, np.int64), False
        for batch in batches:
            keys, values = (batch.column(i).to_numpy() for i in (0, 1))
            if not len(keys):
                continue
            cuts = np.flatnonzero(np.diff(keys)) + 1
            starts, ends = np.r_[0, cuts], np.r_[cuts, len(keys)]
            out: list[tuple[bool, int, int]] = []

            def close() -> None:
                if not open_crowd and len(held) > 1:
                    own = held.view(np.uint64)
                    out.extend((False, int(held[i]), int(held[j])) for i, j in spanning_links(own, within))

            lone = (ends - starts == 1)
            for s, e, single in zip(starts.tolist(), ends.tolist(), lone.tolist()):
                if keys[s] != key:
                    close()
                    if single and e < len(keys):
                        key, held, open_crowd = None, held[:0], False
                        continue
                    key, held, open_crowd = keys[s], values[s:e], False
                else:
                    held = np.r_[held, values[s:e]]
                if open_crowd or len(held) > small:
                    out.extend((True, int(key), int(v)) for v in held)
                    held, open_crowd = held[:0], True
            yield _found(out)
        out = []
        if not open_crowd and len(held) > 1:
            out = [(False, int(held[i]), int(held[j])) for i, j in spanning_links(held.view(np.uint64), within)]
        yield _found(out)

    return run


def _found(out: list[tuple[bool, int, int]]) -> pa.RecordBatch:
    kinds, a, b = zip(*out) if out else ((), (), ())
    return pa.record_batch([pa.array(kinds, pa.bool_()), pa.array(a, pa.int64()), pa.array(b, pa.int64())],
                           names=["crowded", "a", "b"])


def links(prints: DataFrame, radius: int = 2, within: int | None = None, small: int = SMALL_BUCKET) -> DataFrame:
    """Pairs ``a, b`` of values of ``prints(fp)`` that differ in at most ``within`` bits (default:
    ``radius``) and join all values within ``radius`` of each other, directly or by way of others.

    ``prints`` holds each value once. Every value goes to one bucket per mask. A bucket's values are
    joined by fewer pairs than it has values. Buckets above ``small`` values are divided: see
    ``_neighbours`` and ``_block_pairs``.
    """
    within = radius if within is None else within
    masks = F.array(*[F.lit(_signed(m)) for m in covering_masks(radius)])
    key = F.xxhash64("t", F.col("fp").bitwiseAND(F.get(masks, F.col("t"))))
    tables = F.sequence(F.lit(0), F.lit(2 ** (radius + 1) - 2))
    buckets = prints.select("fp", F.explode(tables).alias("t")).repartition(key).select(
        key.alias("k"), "fp").sortWithinPartitions("k")
    found = written(buckets.mapInArrow(_bucket_links(within, small), _FOUND), "buckets")
    near = found.filter("not crowded").select("a", "b")
    crowd = found.filter("crowded").select(F.col("a").alias("k"), F.col("b").alias("fp"))
    more = _neighbours(crowd) if radius == within == 2 else _block_pairs(crowd, within, small)
    return near.union(more).distinct()


def _neighbours(crowd: DataFrame) -> DataFrame:
    """Links of at most two bits. Two such values share a neighbour, that is a value one bit or none away
    from both. At most 65 values share one, and each is linked to the smallest of them."""
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << bit)) for bit in range(BITS)])
    around = crowd.select("fp").distinct().select(
        "fp", F.explode(F.transform(flips, lambda f: F.col("fp").bitwiseXOR(f))).alias("via"))
    met = around.groupBy("via").agg(F.sort_array(F.collect_list("fp")).alias("l")).filter("size(l) > 1")
    return met.select(F.col("l")[0].alias("a"), F.explode(F.slice("l", 2, BITS + 1)).alias("b"))


def _block_pairs(crowd: DataFrame, within: int, small: int) -> DataFrame:
    """Links of a crowded bucket: blocks of about ``small`` values, every two blocks compared in a cell."""
    sizes = crowd.groupBy("k").agg(F.ceil(F.count("*") / small).cast("int").alias("blocks"))
    dealt = crowd.join(sizes, "k").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    cells = dealt.select("k", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))

    def cell(rows: pd.DataFrame) -> pd.DataFrame:
        values = rows["fp"].to_numpy()
        joined = spanning_links(values.view(np.uint64), within) if len(values) > 1 else []
        return pd.DataFrame([(values[i], values[j]) for i, j in joined], columns=["a", "b"], dtype="int64")

    return cells.groupBy("k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).applyInPandas(
        cell, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2, text: str = "text",
                    doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``, repeated rows included.

    Documents link when their fingerprints differ in ``radius`` bits or fewer; a component is what links
    reach, named by its smallest doc_id. A null id takes no part in the minimum; a component of
    null ids only has a null name. Null and empty texts share the fingerprint zero. Other columns
    are not read. An empty table gives no rows.

    The texts are read once. From then on there are numbers only: one row per document, one per
    distinct fingerprint, and one per fingerprint and mask.
    """
    rows = written(docs.select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(text), words).alias("fp")), "prints")
    values = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "values")
    roots = components(links(values.select("fp"), radius)).withColumnRenamed("node", "fp")
    rooted = written(values.join(roots, "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(rooted.join(names, "root").select("fp", "component_id"), "named")
    return rows.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each component that ``near_duplicates`` finds, all columns as they were.

    The row with the smallest doc_id stays, null ids last; of rows that repeat that id the one whose text has the smaller
    digest. Rows that repeat id and text differ in other columns at most; any one of them stays. Texts
    are read for their fingerprints and once more when the rows that go are taken out.
    """
    known = F.col(doc_id).cast("string")
    key = F.md5(F.concat(F.coalesce(F.concat(F.length(known).cast("string"), F.lit("="), known), F.lit("-")), F.lit(":"),
                         F.coalesce(F.col(text), F.lit(""))))
    prints = docs.select(F.col(doc_id).alias("doc_id"), key.alias("key"), fingerprint(F.col(text), words).alias("fp"))
    rows = written(prints.groupBy("key").agg(
        F.first("doc_id").alias("doc_id"), F.first("fp").alias("fp"), F.count("*").alias("n")), "prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    values = written(rows.groupBy("fp").agg(first.alias("first")), "values")
    roots = components(links(values.select("fp"), radius)).withColumnRenamed("node", "fp")
    rooted = written(values.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "rooted")
    named = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("stays")), "root")
    goes = rows.join(named.select("fp", "stays"), "fp").filter(F.col("key") != F.col("stays.key"))
    goes = written(goes.select(F.col("key").alias("_key")), "near-copies")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    left = docs.select(row, key.alias("_key")).join(goes, "_key", "left_anti")
    twice = rows.filter("n > 1").select(F.col("key").alias("_key"))
    if twice.isEmpty():
        return left.select("_row.*")
    once = left.join(twice, "_key", "left_anti").select("_row.*")
    return once.unionByName(left.join(twice, "_key", "left_semi").dropDuplicates(["_key"]).select("_row.*"))
