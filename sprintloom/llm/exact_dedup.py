"""Exact duplicates by deterministic block naming.

A text is cut into blocks of a fixed number of UTF-8 bytes. Equal blocks are brought together by
sorting and get one integer name, the smallest row number among them. Then adjacent names are paired
and equal pairs get a name in the same way, until each document has a single name. Names are given by
comparing content, so two documents share a name at one level exactly when their texts are equal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from sprintloom.session import written

BLOCK_BYTES = 4096
# A key is hot with more than 1/HOT_SHARE of the rows and at least HOT_ROWS of them. So there are fewer
# than HOT_SHARE hot keys, and HOT_SHARE * SALTS bounds the rows of what is broadcast for them.
HOT_SHARE, HOT_ROWS, SALTS = 1000, 1000, 64


def _named(rows: DataFrame, keys: list[str], carry: list[str]) -> DataFrame:
    """``rows`` with ``name``, the smallest ``id`` among the rows of equal ``keys``; ``carry`` are kept.

    Rows of a hot key are divided by their id and named within each division. The divisions of one key
    are then made one by comparing the key itself again, a row each. The hash only finds hot keys: keys
    that share one are divided needlessly but never mixed up.
    """
    marked = rows.withColumn("_mark", F.xxhash64(*keys))
    counts = marked.groupBy("_mark").agg(F.count("*").alias("_n"))
    hot = counts.filter((F.col("_n") >= HOT_ROWS) & (
        F.col("_n") * HOT_SHARE > counts.agg(F.sum("_n")).scalar())).select("_mark", F.lit(True).alias("_hot"))
    salted = marked.join(F.broadcast(hot), "_mark", "left").withColumn(
        "_salt", F.when(F.col("_hot"), F.pmod("id", F.lit(SALTS))).otherwise(F.lit(-1)))
    same = Window.partitionBy(*keys, "_salt")
    local = salted.withColumn("_local", F.min("id").over(same)).select(
        *carry, "id", "_local",
        F.when(F.col("_hot") & (F.col("id") == F.col("_local")), F.struct(*keys)).alias("_key"))
    local = written(local, "names")
    whole = Window.partitionBy("_key")
    merged = local.filter(F.col("_key").isNotNull()).select(
        "_local", F.min("_local").over(whole).alias("_name"))
    return local.join(F.broadcast(merged), "_local", "left").select(
        *carry, "id", F.coalesce("_name", "_local").alias("name"))


def identities(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``id, doc_id, sha, level, name``, a row per row of ``docs``; equal texts agree in level and name.

    ``id`` numbers the rows. A null text counts as empty. The text is read and shuffled once, as
    blocks; the levels above handle numbers, half as many each time.
    """
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.sha2("text", 256).alias("sha"),
        F.col("text").cast("binary").alias("bytes"),
        F.greatest(F.lit(1), F.ceil(F.octet_length("text") / block_bytes)).cast("int").alias("n"))
    cut = F.transform(F.sequence(F.lit(0), F.col("n") - 1),
                      lambda i: F.substring(F.col("bytes"), i * block_bytes + 1, F.lit(block_bytes)))
    first = F.col("pos") == 0
    blocks = texts.select("row", "doc_id", "sha", "n", F.posexplode(cut).alias("pos", "block")).select(
        "row", "n", "pos", "block", F.when(first, F.col("doc_id")).alias("doc_id"),
        F.when(first, F.col("sha")).alias("sha"), F.monotonically_increasing_id().alias("id"))
    carry = ["row", "n", "pos", "doc_id", "sha"]
    level, done = 0, []
    names = _named(blocks, ["block"], carry)
    while True:
        done.append(names.filter("n = 1").select("id", "doc_id", "sha", F.lit(level).alias("level"), "name"))
        rest = names.filter("n > 1")
        if rest.isEmpty():
            break
        side = lambda odd: F.max(F.when(F.col("pos") % 2 == odd, F.col("name")))
        pairs = rest.groupBy("row", F.ceil(F.col("n") / 2).cast("int").alias("n"), F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(
            side(0).alias("left"), side(1).alias("right"), F.min("id").alias("id"),
            F.max("doc_id").alias("doc_id"), F.max("sha").alias("sha"))
        names, level = _named(pairs, ["left", "right"], carry), level + 1
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def exact_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row, dropped ones too.

    Of equal texts the row with the largest doc_id stays; null ids lose against any other, and of rows
    that repeat an id exactly one stays. Null text counts as empty. Other columns are not read. No
    rows give no rows. Group sizes are combined before they are shuffled, and come back to a hot group's
    rows in a join that adaptive execution divides.
    """
    ids = written(identities(docs, text, doc_id, block_bytes), "identities")
    groups = written(ids.groupBy("level", "name").agg(
        F.count("*").alias("group_size"), F.max(F.struct("doc_id", (-F.col("id")).alias("id"))).alias("keep")), "groups")
    return ids.join(groups, ["level", "name"]).select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size",
        (F.col("id") == -F.col("keep.id")).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they were.

    Rows that repeat both id and text differ in other columns at most; any one of them stays.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    sha = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    judged = exact_duplicates(docs, text, doc_id)
    stays = judged.filter(judged.doc_id.eqNullSafe(judged.keep_id)).groupBy("text_sha256", "doc_id").agg(
        F.count("*").alias("_rows"))
    stays = written(stays.select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"), "_rows"), "stays")
    kept = docs.select(row, sha.alias("_text"), F.col(doc_id).alias("_doc")).join(
        stays, (F.col("_text") == F.col("_sha")) & F.col("_doc").eqNullSafe(F.col("_id")))
    once = kept.filter("_rows = 1").select("_row.*")
    repeated = kept.filter("_rows > 1").dropDuplicates(["_text"]).select("_row.*")
    return once.unionByName(repeated)

