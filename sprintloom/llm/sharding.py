"""Sharding by extendible hashing: a bucket that is too large splits on one more bit of the hash.

A shard is a prefix of the 60-bit hash. The first 32 bits come from the document's id and the other 28 from its
text, so that even many texts under one id can be told apart. The directory has a slot for every prefix of
as many bits as the deepest shard has; a shallower shard owns several neighbouring slots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sprintloom.session import written

HASH_BITS = 60
LIMIT = 1 << 20
# Bits looked at in one pass over the rows, so a pass counts at most 2^STEP parts of each bucket.
STEP = 10
# Rows of a table that is broadcast, about 4 MB of the driver's memory. Spark would go by the size of compressed files.
FEW = 1 << 14


def hash_of(doc_id: Column, text: Column) -> Column:
    digits = F.concat(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 8),
                      F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, 7))
    return F.conv(digits, 16, 10).cast("long")


def _bits(prefix: Column, depth: Column) -> Column:
    return F.when(depth == 0, "").otherwise(F.lpad(F.bin(prefix), depth, F.lit("0")))


def _met(rows: DataFrame, found: DataFrame, key: str, how: str) -> DataFrame:
    """``rows`` joined with ``found``, a written table of one row per ``key``: broadcast if they are few, else never."""
    return rows.join(found.hint("broadcast" if found.count() <= FEW else "merge"), key, how)


def _leaves(parts: DataFrame, base: int, top: int, limit: int) -> DataFrame:
    """``fine, leaf`` of the ``parts`` (``fine, bytes, docs``) that have a shard of ``base`` to ``top`` bits.

    Parts of a bucket, 2^(top - base) at most, meet in one window partition. They are sorted once, bit by bit, so that those of
    any shorter prefix lie together and are each other's peers.
    """
    bits = {depth: F.shiftright("fine", top - depth).alias(f"p{depth}") for depth in range(base, top)}
    sized = parts.select("*", *bits.values())
    for depth in reversed(bits):
        peers = Window.partitionBy(f"p{base}")
        if depth > base:
            peers = peers.orderBy(*[f"p{d}" for d in range(base + 1, depth + 1)]).rangeBetween(Window.currentRow, Window.currentRow)
        sized = sized.select("*", F.sum("bytes").over(peers).alias(f"bytes{depth}"), F.sum("docs").over(peers).alias(f"docs{depth}"))

    def leaf(depth: int, prefix: str, docs: str, size: str) -> Column:
        fits = F.col(size) <= limit
        return F.when(fits | F.lit(depth == HASH_BITS), F.struct(
            F.lit(depth).alias("depth"), F.col(prefix).alias("prefix"), F.col(docs).alias("shard_docs"), F.col(size).alias("shard_bytes"), fits.alias("fits")))

    first = F.coalesce(*[leaf(d, f"p{d}", f"docs{d}", f"bytes{d}") for d in bits], leaf(top, "fine", "docs", "bytes"))
    return sized.select("fine", first.alias("leaf")).filter("leaf is not null")


def shards(docs: DataFrame, limit: int = LIMIT, text: str = "text", doc_id: str = "doc_id", step: int = STEP) -> DataFrame:
    """``doc_id, hash, shard, depth, shard_docs, shard_bytes, fits`` for every row of ``docs``.

    ``shard`` is the prefix in binary digits, empty if all rows fit in one shard. A shard has the fewest bits
    with which its texts' UTF-8 bytes are at most ``limit``. Rows with equal id and text cannot be told
    apart, and a text above the limit cannot be divided: such a shard ends at 60 bits and ``fits`` is
    false. A null id or text counts as empty; repeated rows count each time. Other columns are not
    read. An empty table gives no rows.

    Texts are read once, for their hash and size. A pass sums sizes by the next ``step`` bits, sums combined
    before they are shuffled, and settles all depths in between; only rows of buckets that are still too
    large go into the next pass. Nothing that grows with the table is broadcast.
    """
    rest = written(docs.select(F.col(doc_id).alias("doc_id"), hash_of(F.col(doc_id), F.col(text)).alias("hash"),
                               F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("bytes")), "hashes")
    base, out = 0, None
    while True:
        top = min(base + step, HASH_BITS)
        fine = F.shiftright("hash", HASH_BITS - top)
        parts = written(rest.groupBy(fine.alias("fine")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("docs")), "parts")
        leaves = written(_leaves(parts, base, top, limit), "leaves")
        found = written(_met(rest.withColumn("fine", fine), leaves, "fine", "left"), "settled")
        done = found.filter("leaf is not null").select(
            "doc_id", "hash", _bits(F.col("leaf.prefix"), F.col("leaf.depth")).alias("shard"), "leaf.depth", "leaf.shard_docs", "leaf.shard_bytes", "leaf.fits")
        out = done if out is None else out.union(done)
        rest = found.filter("leaf is null").select("doc_id", "hash", "bytes")
        if top == HASH_BITS or rest.isEmpty():
            return out
        base = top


def directory(assigned: DataFrame) -> DataFrame:
    """``shard, depth, first_slot, slots, shard_docs, shard_bytes, fits``: the directory's slots that each shard owns.

    The directory's depth is that of the deepest shard that fits; a deeper one owns part of a slot,
    given as zero slots."""
    each = assigned.groupBy("shard", "depth", "fits").agg(F.max("shard_docs").alias("shard_docs"), F.max("shard_bytes").alias("shard_bytes"))
    depth = F.coalesce(each.filter("fits").agg(F.max("depth")).scalar(), F.lit(0))
    prefix = F.when(F.col("depth") == 0, F.lit(0)).otherwise(F.conv("shard", 2, 10).cast("long"))
    return each.withColumn("bits", depth).select(
        "shard", "depth", F.floor(prefix * F.pow(F.lit(2.0), F.col("bits") - F.col("depth"))).cast("long").alias("first_slot"),
        F.floor(F.pow(F.lit(2.0), F.col("bits") - F.col("depth"))).cast("long").alias("slots"), "shard_docs", "shard_bytes", "fits")


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT, text: str = "text", doc_id: str = "doc_id") -> None:
    """Write ``docs`` as Parquet below ``path``, a folder ``_shard=<prefix>`` per shard (``root`` for the empty prefix).

    Should ``docs`` have a column of the name ``_shard``, the folders' is called ``__shard``, and so on.
    """
    folder = "_shard"
    while folder in {c.lower() for c in docs.columns}:
        folder = f"_{folder}"
    assigned = written(shards(docs, limit, text, doc_id).select("hash", F.concat(F.lit("root"), "shard").alias("shard")).distinct(), "assigned")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    placed = _met(docs.select(row, hash_of(F.col(doc_id), F.col(text)).alias("hash")), assigned, "hash", "inner")
    placed.select("_row.*", F.col("shard").alias(folder)).write.partitionBy(folder).parquet(path)
