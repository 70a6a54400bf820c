"""Chat formatting by perspective rotation: every participant of a dialogue
takes the assistant's place once, the others become named users, and the loss
mask covers what that participant said."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sqlkiln.llm.running import running
from sqlkiln.session import materialize

# Roles that speak to the model but are never rotated.
CONTEXT_ROLES = ("system",)
UNKNOWN = "unknown"
# A longer dialogue is rendered in segments of about so many characters.
SEGMENT_CHARS = 1 << 18
OPEN, BODY, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def _header(role: Column, speaker: Column) -> Column:
    plain = F.when(role.eqNullSafe(speaker), F.lit("assistant")).when(role.isin(*CONTEXT_ROLES), role).otherwise(
        F.concat(F.lit("user name="), role))
    return F.concat(F.lit(OPEN), plain, F.lit(BODY))


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text", segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """``(conv_id, segment, speaker, n_turns, context, offset, text, spans)``:
    the whole dialogue once for every participant of it, whether or not they
    speak in a segment.

    Every message is rendered between markers under a header: ``assistant``
    for the speaker of the row, ``user name=<role>`` for the others, and the
    role itself for ``CONTEXT_ROLES``. ``spans`` are the (start, end)
    character ranges that the loss covers: the speaker's messages with their
    end marker, so that the model learns to stop.

    A dialogue of up to ``segment_chars`` characters is one row a participant.
    A longer one is cut between messages, where every further
    ``segment_chars`` characters begin (a message is never cut): the texts of
    its segments, in order, join to the whole dialogue, ``offset`` characters
    come before a segment, and ``spans`` count from the start of the dialogue.
    ``context`` is the dialogue's first system message, rendered, for the
    segments after the one that holds it (else empty).

    Messages are ordered by turn, then role, then text; rows repeated with
    their turn are one message. A null role is ``unknown``, a null text is
    empty, a null turn comes first (and is a message of its own each time),
    and null conversation ids are one dialogue. A dialogue with context roles
    only gives no row, nor does an empty table; other columns are ignored.

    What one task gathers is a segment, so neither a long dialogue nor a hot
    or null id is a group in one task: places in a dialogue are running sums
    over ranges, and what is joined per dialogue is its participants."""
    rows = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit(UNKNOWN)).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("said"))
    rows = rows.where("turn is not null").distinct().unionByName(rows.where("turn is null"))
    # A key that is never null: what is grouped by it joins by it as it lies.
    rows = rows.withColumn("key", F.coalesce(F.concat(F.lit("k"), F.col("conv_id").cast("string")), F.lit("")))
    size = F.length(_header(F.col("role"), F.lit(None).cast("string"))) + F.length("said") + len(CLOSE)
    placed = running(rows.withColumn("size", size.cast("long")), ["key"], ["turn", "role", "said"], "size")
    placed = placed.withColumnRenamed("before", "at").withColumn("segment", F.floor(F.col("at") / segment_chars).cast("long"))
    talks = placed.groupBy("key", "segment").agg(
        F.array_sort(F.collect_list(F.struct("at", "role", "said"))).alias("messages"), F.min("conv_id").alias("conv_id"))
    spoken = ~F.col("role").isin(*CONTEXT_ROLES)
    # Who says how much where: all that follows is as long as the segments.
    shares = materialize(placed.groupBy("key", "segment", "role").agg(
        F.count(F.lit(1)).alias("said_here"), F.min("at").alias("at"),
        F.min_by(F.when(~spoken, F.col("said")), "at").alias("told")))
    speakers = shares.where(spoken).groupBy("key", F.col("role").alias("speaker")).agg(F.lit(1).alias("one"))
    lines = shares.groupBy("key", "segment").agg(F.min("at").alias("begin")).join(speakers, "key")
    own = shares.where(spoken).select("key", "segment", F.col("role").alias("speaker"), "said_here")
    lines = lines.join(own, ["key", "segment", "speaker"], "left").select(
        "key", "segment", "speaker", "begin", F.coalesce("said_here", F.lit(0)).alias("said_here"))
    # The speaker's own earlier messages have the other header.
    lines = running(lines, ["key", "speaker"], ["segment"], "said_here")
    shorter = F.length(_header(F.col("speaker"), F.col("speaker"))) - F.length(_header(F.col("speaker"), F.lit(None).cast("string")))
    lines = lines.withColumn("offset", F.col("begin") + F.col("before") * shorter)
    first = shares.where(~spoken).groupBy("key").agg(F.min_by(F.struct("segment", "role", "told"), "at").alias("first"))
    lines = lines.join(first, "key", "left")
    told = F.concat(_header(F.col("first.role"), F.lit(None).cast("string")), F.col("first.told"), F.lit(CLOSE))
    lines = lines.select("key", "segment", "speaker", "offset",
                         F.when(F.col("first.segment") < F.col("segment"), told).otherwise("").alias("context"))
    each = talks.join(lines, ["key", "segment"])
    speaker = F.col("speaker")
    parts = each.withColumn("parts", F.transform("messages", lambda m: F.struct(
        _header(m["role"], speaker).alias("head"), F.concat(m["said"], F.lit(CLOSE)).alias("tail"),
        (m["role"] == speaker).alias("own"))))
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    start = F.struct(F.col("offset").alias("at"), empty.alias("spans"))

    def place(acc: Column, p: Column) -> Column:
        begin = acc["at"] + F.length(p["head"])
        end = begin + F.length(p["tail"])
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(p["own"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    text = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["tail"])), "")
    return parts.select(
        "conv_id", "segment", "speaker", F.size("messages").cast("long").alias("n_turns"), "context", "offset",
        text.alias("text"), F.aggregate("parts", start, place)["spans"].alias("spans"))
