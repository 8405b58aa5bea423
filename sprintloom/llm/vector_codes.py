"""Vector codes over Hilbert-sorted flat blocks.

Vectors are cut into equal parts, and each part position has a codebook. The parts of a chunk of vectors are
sorted along a Hilbert curve and cut into flat blocks that keep their smallest and largest components and their
sum. In each round the distances between a block's box and the entries leave a short list: an entry is
on it unless the entry of the least greatest distance is nearer to every place of the box. A block with one entry on its list is assigned as a
whole, from its stored sum; the others run an exact integer kernel of their parts against their list.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sprintloom.llm.common import join_groups
from sprintloom.session import written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
# Vectors whose parts are sorted together, and parts in a block.
CHUNK, BLOCK = 1 << 15, 64
_LIMB = 32


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of rows of ``bits``-bit coordinates (Skilling's transposed form)."""
    x = np.array(cells, np.int64).T.copy()
    for level in range(bits - 1, 0, -1):
        q = 1 << level
        for i in range(len(x)):
            turned = (x[i] & q) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(turned, q - 1, swap)
            x[i] ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for axis in x:
            key = (key << 1) | ((axis >> level) & 1)
    return key


def hilbert_order(points: np.ndarray) -> np.ndarray:
    """Row numbers of ``points`` along a Hilbert curve through their box. Only the order of work depends on it."""
    axes = points[:, :62].astype(np.float64)
    bits = max(1, min(10, 62 // axes.shape[1]))
    low, high = axes.min(0), axes.max(0)
    span = np.where(high > low, high - low, 1.0)
    cells = ((axes - low) / span * ((1 << bits) - 1)).astype(np.int64)
    return np.argsort(hilbert_keys(cells, bits), kind="stable")


def exact(values: np.ndarray, *others: np.ndarray) -> list[np.ndarray]:
    """Whole numbers, as int64 where sums of a few squares stay below 2^62, else as Python's integers."""
    most = max((float(np.abs(v).max()) for v in (values, *others) if v.size), default=0.0)
    kind = np.int64 if values.shape[-1] * 8 * most * most < 2.0 ** 62 else object
    return [v.astype(np.int64) if kind is np.int64 else np.vectorize(int, otypes=[object])(v) if v.size else v.astype(object)
            for v in (values, *others)]


class Blocks:
    """The flat blocks of one part position of a chunk. Components are whole numbers held as doubles."""

    def __init__(self, points: np.ndarray, order: np.ndarray | None = None):
        self.order = hilbert_order(points) if order is None else order
        self.points = points[self.order] if order is None else points
        edges = np.arange(0, len(self.points), BLOCK)
        self.edges = np.r_[edges, len(self.points)]
        self.low = np.minimum.reduceat(self.points, edges, axis=0)
        self.high = np.maximum.reduceat(self.points, edges, axis=0)

    def sums(self) -> np.ndarray:
        whole, = exact(self.points)
        if whole.dtype != object and np.abs(whole).max(initial=0) < 1 << 40:
            return np.add.reduceat(whole, self.edges[:-1], axis=0)
        return np.add.reduceat(whole.astype(object), self.edges[:-1], axis=0)

    def short_lists(self, book: np.ndarray) -> np.ndarray:
        """For each block, the entries that can be nearest to some place of its box; ties stay.

        The entry whose greatest distance to the box is least is the rival. By how much an entry can be nearer than the
        rival is linear in the place, so its maximum over the box is that of each axis's two ends.
        """
        low, high, entries = exact(self.low, self.high, book)
        across = np.maximum(abs(entries[None] - low[:, None]), abs(high[:, None] - entries[None]))
        rival = entries[(across * across).sum(2).argmin(1)]
        shift = 2 * (entries[None] - rival[:, None])
        gain = np.maximum(shift * low[:, None], shift * high[:, None]).sum(2)
        return gain + (rival * rival).sum(1)[:, None] - (entries * entries).sum(1)[None] >= 0

    def kernels(self, book: np.ndarray, single: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Row numbers in the blocks' order, their entries and squared distances, for blocks with several
        entries on their list, and with one if ``single``. Blocks of like size and list run together."""
        lists, sizes = self.short_lists(book), np.diff(self.edges)
        lengths = lists.sum(1)
        for size, length in sorted(set(zip(sizes.tolist(), lengths.tolist()))):
            if length == 1 and not single:
                continue
            alike = np.flatnonzero((sizes == size) & (lengths == length))
            for some in np.array_split(alike, -(-len(alike) * size * length // (1 << 18))):
                candidates = np.nonzero(lists[some])[1].reshape(len(some), length)
                rows = self.edges[some][:, None] + np.arange(size)
                points, entries = exact(self.points[rows], book[candidates])
                apart = points[:, :, None] - entries[:, None]
                far = (apart * apart).sum(3)
                best = far.argmin(2)  # the first of equals, and candidates ascend
                yield (rows.ravel(), np.take_along_axis(candidates, best, 1).ravel(),
                       np.take_along_axis(far, best[:, :, None], 2).ravel())


def _floats(column: pa.ListArray, width: int) -> np.ndarray:
    return np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE).reshape(len(column), width)


def _bytes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def _sort_blocks(width: int):
    """Rows ``id, label, vector`` to a row per chunk: ids, labels, each part position's parts in block order, and that order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def settle() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            parts = _floats(table.column("vector").chunk(0), width).reshape(len(table), PARTS, -1)
            blocks = [Blocks(parts[:, p]) for p in range(PARTS)]
            cells = {name: pa.ListArray.from_arrays(pa.array([0, len(table)], pa.int32()), table.column(name).chunk(0))
                     for name in ("id", "label")}
            return pa.record_batch([
                cells["id"], cells["label"], pa.array([b"".join(_bytes(b.points) for b in blocks)], pa.binary()),
                pa.array([b"".join(_bytes(b.order.astype(np.int32)) for b in blocks)], pa.binary()),
            ], names=["ids", "labels", "points", "orders"])

        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                if held and sum(b.num_rows for b in held) + part.num_rows > CHUNK:
                    yield settle()
                if part.num_rows:
                    held.append(part)
        if held:
            yield settle()

    return run


def _stored(points: bytes, orders: bytes, rows: int) -> Iterator[tuple[int, Blocks]]:
    order = np.frombuffer(orders, np.int32).reshape(PARTS, rows)
    parts = np.frombuffer(points, np.float64).reshape(PARTS, rows, -1)
    for p in range(PARTS):
        yield p, Blocks(parts[p], order[p])


def _limbs(value: int) -> Iterator[int]:
    """Signed 32-bit digits, lowest first: sums of any size are added up in longs."""
    while True:
        low = value & ((1 << _LIMB) - 1)
        value >>= _LIMB
        if value in (0, -1):
            yield low + (value << _LIMB)
            return
        yield low


def _totals(books: np.ndarray):
    """Rows ``part, entry, place, limb, value``: a task's sums of the parts assigned to each entry; place -1 is their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((PARTS, *books.shape[1:]), object)
        counts = np.zeros((PARTS, books.shape[1]), np.int64)
        for batch in batches:
            for ids, points, orders in zip(*(batch.column(n) for n in ("ids", "points", "orders"))):
                for p, blocks in _stored(points.as_py(), orders.as_py(), len(ids)):
                    lists = blocks.short_lists(books[p])
                    alone = lists.sum(1) == 1
                    entry = lists.argmax(1)[alone]
                    np.add.at(sums[p], entry, blocks.sums()[alone].astype(object))
                    np.add.at(counts[p], entry, np.diff(blocks.edges)[alone])
                    for rows, entries, _ in blocks.kernels(books[p], single=False):
                        order = np.argsort(entries, kind="stable")
                        given, starts, n = np.unique(entries[order], return_index=True, return_counts=True)
                        whole, = exact(blocks.points[rows[order]])
                        sums[p][given] += np.add.reduceat(whole, starts, axis=0).astype(object)
                        counts[p][given] += n
        out = [(p, e, place, limb, value)
               for p in range(PARTS) for e in np.flatnonzero(counts[p]).tolist()
               for place, total in enumerate((int(counts[p][e]), *sums[p][e]), -1)
               for limb, value in enumerate(_limbs(int(total)))]
        columns = zip(*out) if out else [()] * 5
        yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["part", "entry", "place", "limb", "value"])

    return run


def _codes(books: np.ndarray):
    """The final entries and errors, a row per vector. An error that no long can hold is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, points, orders in zip(*(batch.column(n) for n in ("ids", "labels", "points", "orders"))):
                chosen = np.zeros((len(ids), PARTS), np.uint8)
                error = np.zeros(len(ids), object)
                for p, blocks in _stored(points.as_py(), orders.as_py(), len(ids)):
                    for rows, entries, far in blocks.kernels(books[p], single=True):
                        own = blocks.order[rows]
                        chosen[own, p] = entries
                        error[own] += far.astype(object)
                fits = [int(e) if e < 1 << 63 else None for e in error]
                yield pa.record_batch([ids.values, labels.values, pa.array([bytes(c).hex() for c in chosen], pa.string()),
                                       pa.array(fits, pa.int64())], names=["vec_id", "label", "code", "error"])

    return run


def trained(store: DataFrame, books: np.ndarray, rounds: int) -> np.ndarray:
    """The codebooks after ``rounds`` of assigning all parts and replacing each used entry by its parts' floored mean."""
    for _ in range(rounds):
        sums = store.mapInArrow(_totals(books), "part long, entry long, place long, limb long, value long")
        summed = sums.groupBy("part", "entry", "place", "limb").agg(F.sum("value").alias("value")).collect()
        totals: dict[tuple[int, int, int], int] = {}
        for r in summed:
            where = (r.part, r.entry, r.place)
            totals[where] = totals.get(where, 0) + (r.value << (_LIMB * r.limb))
        books = books.copy()
        for (p, e, place), total in totals.items():
            if place >= 0:
                books[p, e, place] = total // totals[p, e, -1]
    return books


def compressed(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES, vector: str = "embedding",
               vec_id: str = "vec_id", label: str = "label") -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256``, a row per kept vector, repeated rows included.

    Vectors that are null, or hold null or non-finite components, are left out; so are those whose length
    is not 16 times some number or differs from that of the first, which is the one of the smallest id (null ids
    come last, then smaller vectors first). A component x counts as floor(256 x). The codebook of a part
    position starts as that part of the first ``entries`` (256 at most) vectors. ``code`` has two hex digits per part,
    ``error`` the sum of the squared distances to the final entries, ``label_error`` its sum over equal labels,
    null labels being equal; what no long can hold is null. Other columns are not read. An empty table gives no rows.

    The parts are sorted where they are read, a chunk of vectors at a time, so nothing is shuffled but sums. The driver
    holds the codebooks, whose size is that of ``entries`` vectors.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits a part")
    spark, finite = vectors.sparkSession, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    kept = vectors.select(F.col(vec_id).alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector")).filter(
        F.col("vector").isNotNull() & (F.size("vector") > 0) & (F.size("vector") % PARTS == 0) & F.forall("vector", finite))
    order = [F.col("id").asc_nulls_last(), F.col("vector")]
    first = kept.orderBy(*order).limit(entries).collect()
    kinds = {f.name: f.dataType.simpleString() for f in kept.schema}
    if not first:
        nothing = f"vec_id {kinds['id']}, code string, error long, label_error long, codebooks_sha256 string"
        return spark.createDataFrame([], nothing)
    width = len(first[0].vector)
    if any(len(r.vector) != width for r in first):
        first = kept.filter(F.size("vector") == width).orderBy(*order).limit(entries).collect()
    start = np.floor(np.array([r.vector for r in first], np.float64) * SCALE)
    books = np.vectorize(int, otypes=[object])(start.reshape(len(first), PARTS, -1).transpose(1, 0, 2))
    store = written(kept.filter(F.size("vector") == width).mapInArrow(
        _sort_blocks(width), f"ids array<{kinds['id']}>, labels array<{kinds['label']}>, points binary, orders binary"), "blocks")
    books = trained(store, books, rounds)
    digest = hashlib.sha256(",".join(str(x) for x in books.ravel()).encode()).hexdigest()
    named = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("-")).alias("_label")
    coded = written(store.mapInArrow(
        _codes(books), f"vec_id {kinds['id']}, label {kinds['label']}, code string, error long").select("vec_id", named, "code", "error"), "codes")
    whole = F.count("*") == F.count("error")
    sums = written(coded.groupBy("_label").agg(
        F.count("*").alias("n"), F.when(whole, F.try_sum("error")).alias("label_error")), "labels")
    return join_groups(coded, sums, "_label", F.struct("vec_id", "code")).select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
