"""Chat formatting by prefix-target expansion: every assistant turn is an example of its own.

A conversation's formatted text is the concatenation of its turns, each ``<s>ROLE[INST]TEXT</s>``. The example of an
assistant turn is that text up to and including the turn: all preceding turns are context, and the loss mask
covers the reply's text alone. As all examples of a conversation are prefixes of one text, the text is
stored once, a segment per turn, and ``examples`` says where an example's prefix ends and its mask lies. ``expanded``
makes every example of it, its whole text and its mask; ``digests`` reads the loss text out of these.

Inside roles and texts ``<``, ``[`` and the backslash are spelled ``\\l``, ``\\b`` and ``\\e``, so no control string can occur
there, and reading back gives what was written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sprintloom.session import written

OPEN, BODY, CLOSE = "<s>", "[INST]", "</s>"
# Turns of one stretch; windows and sorts never take more than a stretch of one conversation at once.
STRETCH = 256
ASSISTANT = "assistant"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\e")), F.lit("<"), F.lit("\\l")), F.lit("["), F.lit("\\b"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("[")), F.lit("\\e"), F.lit("\\"))


def segments(conversations: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """``conv_id, position, segment, segment_start, mask_start, mask_chars``, a row per turn.

    ``position`` counts turns from 0 in order of ``turn`` (null first), then role, then text, so ties and repeated
    rows are each kept in a defined order. ``segment_start`` is the segment's first character in the
    formatted conversation. The mask (relative to the segment) is the text of an assistant's turn and
    null for other roles. Null roles and texts count as empty; a null conv_id is a conversation as any
    other. Lengths are in code points. No rows give no rows.

    Positions and offsets are sums within stretches of turn numbers, to which the sums of the stretches before
    are added, so a conversation with a large part of all rows still spreads over many tasks.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = conversations.select("conv_id", "turn", F.floor(F.col("turn") / stretch).alias("part"), role.alias("role"), text.alias("text"))
    head = F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(BODY))
    made = rows.select("conv_id", "part", "turn", "role", "text", F.concat(head, escaped(F.col("text")), F.lit(CLOSE)).alias("segment"),
                       F.when(F.col("role") == ASSISTANT, F.length(head)).alias("mask_start"),
                       F.when(F.col("role") == ASSISTANT, F.length(escaped(F.col("text")))).alias("mask_chars"))
    order = Window.partitionBy("conv_id", "part").orderBy("turn", "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    inner = written(made.select(
        "conv_id", "part", "segment", "mask_start", "mask_chars", (F.row_number().over(order) - 1).alias("own_position"),
        F.coalesce(F.sum(F.length("segment")).over(before), F.lit(0)).alias("own_start")), "segments")
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = inner.groupBy("conv_id", "part").agg(F.count("*").alias("turns"), F.sum(F.length("segment")).alias("chars")).select(
        F.col("conv_id").alias("c"), F.col("part").alias("p"), F.coalesce(F.sum("turns").over(earlier), F.lit(0)).alias("turns_before"),
        F.coalesce(F.sum("chars").over(earlier), F.lit(0)).alias("chars_before"))
    parts = written(parts, "stretches")
    return inner.join(parts, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("part").eqNullSafe(F.col("p"))).select(
        "conv_id", (F.col("turns_before") + F.col("own_position")).alias("position"), "segment",
        (F.col("chars_before") + F.col("own_start")).alias("segment_start"), "mask_start", "mask_chars")


def examples(turns: DataFrame) -> DataFrame:
    """``conv_id, target, context_turns, context_chars, reply, mask_start, mask_chars`` of ``segments``: a row per assistant turn.

    The example's text is the first ``context_chars`` characters of the formatted conversation and then ``reply``; the mask
    is relative to the reply, whose text is the only trainable part."""
    return turns.filter("mask_start is not null").select(
        "conv_id", F.col("position").alias("target"), F.col("position").alias("context_turns"),
        F.col("segment_start").alias("context_chars"), F.col("segment").alias("reply"), "mask_start", "mask_chars")


def _joined(column: str, by: str) -> Column:
    """The texts of a group as one, in order."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(by, column))), lambda s: s[column]), "")


def _concatenated(rows: DataFrame, keys: list[str], order: str, text: str, name: str, stretch: int = STRETCH) -> DataFrame:
    """``keys`` and the texts of each group in order as one string: first by stretches, then their strings, so no
    sort holds more than a stretch of single rows. The final string is one row's own content."""
    part = F.floor(F.col(order) / stretch).alias("_part")
    return rows.groupBy(*keys, part).agg(_joined(text, order).alias("_text")).groupBy(*keys).agg(_joined("_text", "_part").alias(name))


def _with_places(turns: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """``conv_id, formatted, places``: each conversation's formatted text and where its examples lie, put together at once."""
    start = F.col("segment_start") + F.col("mask_start")
    place = F.struct(F.col("position").alias("target"), (F.col("segment_start") + F.length("segment")).cast("int").alias("end"),
                     start.cast("int").alias("loss_start"), (start + F.col("mask_chars")).cast("int").alias("loss_end"))
    part = F.floor(F.col("position") / stretch).alias("_part")
    return turns.groupBy("conv_id", part).agg(_joined("segment", "position").alias("_text"), F.collect_list(
        F.when(F.col("mask_start").isNotNull(), place)).alias("_places")).groupBy("conv_id").agg(
        _joined("_text", "_part").alias("formatted"), F.flatten(F.collect_list("_places")).alias("places"))


def formatted(turns: DataFrame) -> DataFrame:
    """``conv_id, formatted``: the whole formatted text of each conversation."""
    return _with_places(turns).select("conv_id", "formatted")


def _written_out(texts: DataFrame) -> DataFrame:
    """``texts`` with a row for each example: ``target, text, loss_start, loss_end``, which are null without one."""
    kept = [c for c in texts.columns if c not in ("formatted", "places")]
    return texts.select(*kept, "formatted", F.explode_outer("places").alias("_at")).select(
        *kept, "_at.target", F.substring("formatted", F.lit(1), F.col("_at.end")).alias("text"), "_at.loss_start", "_at.loss_end")


def expanded(turns: DataFrame) -> DataFrame:
    """``conv_id, target, text, loss_start, loss_end``: every example written out, which takes room that grows with the
    square of a conversation's turns.

    Only the conversation's one text is shuffled; the prefixes arise row by row behind that."""
    return _written_out(_with_places(turns)).filter("target is not null")


def digests(turns: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars`` read back from the output.

    Turns are parsed out of the formatted text by its markers. The loss text is what the masks of the examples, as
    ``expanded`` has them, cover, unescaped and concatenated; it is empty without an assistant turn."""
    pattern = r"<s>([^<\[]*)\[INST\]([^<\[]*)</s>"
    whole = _with_places(turns).withColumn("roles", F.regexp_extract_all("formatted", F.lit(pattern), F.lit(1))).withColumn(
        "texts", F.regexp_extract_all("formatted", F.lit(pattern), F.lit(2)))
    read = F.transform(F.arrays_zip("roles", "texts"), lambda t: F.concat(unescaped(t["roles"]), F.lit("\n"), unescaped(t["texts"]), F.lit("\n")))
    turned = whole.select("conv_id", F.size("roles").cast("long").alias("n_turns"), F.sha2(F.array_join(read, ""), 256).alias("turns_sha256"),
                          F.length("formatted").cast("long").alias("formatted_chars"), "formatted", "places")
    own = ["conv_id", "n_turns", "turns_sha256", "formatted_chars"]
    masked = _written_out(turned).select(*own, "target", unescaped(
        F.expr("substring(text, loss_start + 1, loss_end - loss_start)")).alias("masked"))
    return _concatenated(masked, own, "target", "masked", "loss").select(
        "conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
