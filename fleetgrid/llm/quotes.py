"""Quotation linking, in DataFrame functions only.

A line's quote level is the number of ``>`` it starts with. Neighbouring lines of one level form a
passage; a passage as a whole, its paragraphs and its lines, each normalised (lower case, runs of
anything but letters and digits as one space), are hashed and joined to the same units of the unquoted text of
earlier messages of the conversation. Passages as a whole count at any length, their parts from ``LEAST_CHARS``
characters on. Each unit speaks for the latest earlier message that holds
it, weighted by its length; the message with the most weight at the lowest level is the one replied to.
Deeper levels name earlier ancestors, and stand in where the lowest level matches nothing.

A reply belongs to the thread of the message it replies to; a message that quotes nothing known
starts a thread of its own. Sorted by (conv_id, thread, turn), every reply follows its original and
threads stay together. The text comes without quotes and without the line that introduces one.

Defined results: null text stays null and quotes nothing; rows without a conversation or a turn are
threads of their own; rows that repeat (conv_id, turn) are one message and get the same links, each
with its own text; a quote of a later message, or of itself, is no link.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgrid.session import durable

QUOTED = "^[ \\t]*>[> \\t]*"

# Normalised characters from which a part of a quoted passage counts by itself; whole passages count at any length.
LEAST_CHARS = 8
TURN_BUCKET = 1024

# Fixed endings of the line before a quote, in five languages.
INTRODUCES = "(wrote|schrieb|écrit|escribió|scritto)\\s*:\\s*$"


def level(line: Column) -> Column:
    """Quote marks that a line starts with."""
    return F.length(F.regexp_replace(F.regexp_extract(line, QUOTED, 0), "[^>]", ""))


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", " "))


def lines_of(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, copy, place, level, body): every line of the messages, marks taken off."""
    split = messages.select("conv_id", "turn", "copy", F.posexplode(F.split("text", "\r?\n")).alias("place", "line"))
    return split.select(
        "conv_id", "turn", "copy", "place", level(F.col("line")).alias("level"), F.regexp_replace("line", QUOTED, "").alias("body")
    )


def units(lines: DataFrame) -> DataFrame:
    """(conv_id, turn, level, unit, weight): distinct hashed lines, paragraphs and passages of the messages."""
    message = ["conv_id", "turn", "copy"]
    order = Window.partitionBy(*message).orderBy("place")
    other_level = F.coalesce((F.col("level") != F.lag("level").over(order)).cast("int"), F.lit(0))
    marked = lines.select("*", other_level.alias("turns"), (F.trim("body") == "").cast("int").alias("blank"))
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    grouped = marked.select(
        "*", F.sum("turns").over(so_far).alias("passage"), F.sum(F.col("turns") + F.col("blank")).over(so_far).alias("paragraph")
    )

    def joined(whole: bool, *keys: str) -> DataFrame:
        parts = F.transform(F.array_sort(F.collect_list(F.struct("place", "body"))), lambda part: part["body"])
        units_ = grouped.groupBy(*message, "level", *keys).agg(F.concat_ws(" ", parts).alias("body"))
        return units_.select(*message, "level", "body", F.lit(whole).alias("whole"))

    listed = grouped.select(*message, "level", "body", F.lit(False).alias("whole"))
    listed = listed.union(joined(True, "passage")).union(joined(False, "passage", "paragraph"))
    # The unquoted text around quotes also counts as one, whatever stands between its parts.
    own = grouped.filter("level = 0")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("place", "body"))), lambda part: part["body"])
    together = own.groupBy(*message, "level").agg(F.concat_ws(" ", parts).alias("body"))
    listed = listed.union(together.select(*message, "level", "body", F.lit(True).alias("whole")))
    plain = listed.select("conv_id", "turn", "level", "whole", normalised(F.col("body")).alias("plain"))
    # Unquoted units are what whole passages are looked up in, so short ones stay.
    kept = plain.filter("plain != ''").filter(F.col("whole") | (F.col("level") == 0) | (F.length("plain") >= LEAST_CHARS))
    return kept.select("conv_id", "turn", "level", F.md5("plain").alias("unit"), F.length("plain").alias("weight")).distinct()


def latest_earlier(asked: DataFrame, originals: DataFrame) -> DataFrame:
    """(conv_id, turn, level, weight, found): per asked unit the latest earlier message that holds it.

    Both sides are laid in turn order per (conversation, unit), first within buckets of turns and
    then over the buckets: no pairs are made, and a hot unit is spread over its buckets.
    """
    has = originals.select("conv_id", "unit", "turn", F.lit(None).cast("int").alias("level"), F.lit(0).alias("weight"), F.col("turn").alias("held"))
    wants = asked.select("conv_id", "unit", "turn", "level", "weight", F.lit(None).cast("long").alias("held"))
    events = has.union(wants).withColumn("bucket", F.floor(F.col("turn") / TURN_BUCKET))
    inside = Window.partitionBy("conv_id", "unit", "bucket").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("conv_id", "unit").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = events.groupBy("conv_id", "unit", "bucket").agg(F.max("held").alias("top"))
    buckets = buckets.select("conv_id", "unit", "bucket", F.max("top").over(before).alias("carried"))
    seen = events.withColumn("here", F.max("held").over(inside)).filter("level IS NOT NULL")
    joined = seen.join(buckets, ["conv_id", "unit", "bucket"])
    return joined.select("conv_id", "turn", "level", "weight", F.coalesce("here", "carried").alias("found")).filter("found IS NOT NULL")


def reply_links(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to, ancestors): per quoting message what it replies to, and the deeper matches."""
    quoting = messages.filter(F.col("text").rlike("(?m)" + QUOTED))
    # Only conversations in which something is quoted are cut into units.
    open_ = messages.join(quoting.select("conv_id").distinct(), "conv_id", "left_semi")
    found = durable(units(lines_of(open_)))
    matched = latest_earlier(found.filter("level > 0"), found.filter("level = 0").select("conv_id", "turn", "unit").distinct())
    votes = matched.groupBy("conv_id", "turn", "level", "found").agg(F.sum("weight").alias("weight"))
    best = votes.groupBy("conv_id", "turn", "level").agg(F.max_by("found", F.struct("weight", "found")).alias("found"))
    return best.groupBy("conv_id", "turn").agg(
        F.min_by("found", "level").alias("reply_to"),
        F.transform(F.array_sort(F.collect_list(F.struct("level", "found"))), lambda one: one["found"]).alias("ancestors"),
    )


def threads(links: DataFrame) -> DataFrame:
    """(conv_id, turn, thread): the first message of every reply's chain, by pointer jumping."""
    state = durable(links.select("conv_id", "turn", F.col("reply_to").alias("thread")))
    while True:
        above = state.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("next"))
        jumped = durable(
            state.join(above, ["conv_id", "thread"], "left").select(
                "conv_id", "turn", F.coalesce("next", "thread").alias("thread"), F.col("next").isNotNull().alias("moved")
            )
        )
        state = jumped.drop("moved")
        if not jumped.filter("moved").take(1):
            return state


def without_quotes(text: Column) -> Column:
    """The text without quoted lines, the lines that introduce them, and blank lines at its ends."""
    introduced = "(?m)^[^\\n>]*" + INTRODUCES.rstrip("$") + "\\n(?=[ \\t]*>)"
    text = F.regexp_replace(text, "\\r\\n", "\n")
    text = F.regexp_replace(text, introduced, "")
    text = F.regexp_replace(text, "(?m)^[ \\t]*>.*(\\n|\\z)", "")
    return F.regexp_replace(text, "\\A(?:[ \\t]*\\n)+|(?:\\n[ \\t]*)+\\z", "")


def linked_conversations(
    table: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(conv_id, thread, turn, role, reply_to, ancestors, text) per row of ``table``."""
    rows = table.select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.col(role_col).alias("role"),
        F.col(text_col).alias("text"),
    )
    messages = rows.filter("conv_id IS NOT NULL AND turn IS NOT NULL").select(
        "conv_id", "turn", F.xxhash64("role", "text").alias("copy"), "text"
    )
    links = durable(reply_links(messages))
    joined = rows.join(links, ["conv_id", "turn"], "left").join(threads(links), ["conv_id", "turn"], "left")
    quotes = F.col("text").rlike("(?m)" + QUOTED)
    return joined.select(
        "conv_id",
        F.coalesce("thread", "turn").alias("thread"),
        "turn",
        "role",
        "reply_to",
        F.coalesce("ancestors", F.array().cast("array<long>")).alias("ancestors"),
        F.when(quotes, without_quotes(F.col("text"))).otherwise(F.col("text")).alias("text"),
    )
