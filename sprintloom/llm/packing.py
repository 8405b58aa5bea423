"""Cost-balanced packing of documents into fixed-length training sequences.

A piece of n tokens costs ``linear * n + quadratic * n * n``, the quadratic part being attention within the
piece. Whole stretches of a sequence's length fill a sequence each. What is left of the documents is
taken in descending length, and each goes to the sequence of the lowest cost so far that has room; what
does not fit there is cut and goes on to the next.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from sprintloom.llm.bpe import _PIECES, Encoder

LENGTH = 1024
END_ID = b"\0\0\0\0"
LINEAR, QUADRATIC = 1.0, 1 / LENGTH
# Documents packed together: bounds what a task holds to this many rests of less than a sequence.
GROUP = 8192
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                     ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])


def assign(sizes: list[int], length: int = LENGTH, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """Pieces (item, start in the item, size, sequence, offset) of items shorter than a sequence.

    There are as few sequences as can hold all tokens, so less than one sequence's length is padding.
    Equal sizes go in the order given, equal costs to the first sequence.
    """
    sequences = -(-sum(sizes) // length)
    heap = [(0.0, s, 0) for s in range(sequences)]
    out = []
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        start, left = 0, sizes[item]
        while left:
            cost, sequence, filled = heapq.heappop(heap)
            size = min(left, length - filled)
            out.append((item, start, size, sequence, filled))
            start, left, filled = start + size, left - size, filled + size
            if filled < length:
                heapq.heappush(heap, (cost + linear * size + quadratic * size * size, sequence, filled))
    return out


def _pack(path: str, length: int, linear: float, quadratic: float, group: int, with_ids: bool, remembered: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, width = Encoder.of(path, remembered), 4
        sequence = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        rests: list[tuple] = []

        def add(doc_id, start: int, ids: bytes, tokens: int, number: int, offset: int) -> None:
            rows.append((doc_id, start, len(ids) // width, zlib.crc32(ids), tokens, number, offset, ids if with_ids else None))

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * len(_SCHEMA)
            rows.clear()
            return pa.record_batch([pa.array(c, t.type) for c, t in zip(columns, _SCHEMA)], schema=_SCHEMA)

        def settle() -> None:
            nonlocal sequence
            for item, start, size, number, offset in assign([len(r[2]) // width for r in rests], length, linear, quadratic):
                doc_id, before, ids, tokens = rests[item]
                add(doc_id, before + start, ids[start * width:(start + size) * width], tokens, sequence + number, offset)
            sequence += -(-sum(len(r[2]) // width for r in rests) // length)
            rests.clear()

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encoder.encode(text.as_py() or "") + END_ID
                tokens = len(ids) // width
                whole = tokens - tokens % length
                for start in range(0, whole, length):
                    add(doc_id, start, ids[start * width:(start + length) * width], tokens, sequence, 0)
                    sequence += 1
                if whole < tokens:
                    rests.append((doc_id, whole, ids[whole * width:], tokens))
                if len(rests) >= group:
                    settle()
                if len(rows) >= 1 << 14:
                    yield out()
        settle()
        yield out()

    return run


def pack(docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH, linear: float = LINEAR,
         quadratic: float = QUADRATIC, group: int = GROUP, with_ids: bool = True, text: str = "text", doc_id: str = "doc_id",
         remembered: int = _PIECES) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and, if asked for, ``ids`` (little-endian
    32-bit), a row per piece.

    A document is the ids of its whole text and then id 0, so a null or empty text is the one id 0. Every row is a
    document of its own, also if ids repeat or are null. Each task packs what it reads, a group of documents at a
    time, so nothing is shuffled and a repeated task gives the same pieces; sequence numbers start at the task's
    number times 2^40. Less than one sequence of padding arises in a group. Other columns are not
    read. An empty table gives no rows. A Python worker remembers the ids of up to ``remembered`` pieces of text.
    """
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
    packed = rows.mapInArrow(_pack(path, length, linear, quadratic, group, with_ids, remembered), schema)
    return packed if with_ids else packed.drop("ids")
