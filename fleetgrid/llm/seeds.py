"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A document is contaminated by a benchmark item when 16 consecutive words of both agree but for at
most 3 substituted words. Each mask selects six of the words after a position and ignores the
others; equal hashes of test and training words are hits, and the overlap around a hit is compared
word by word. The two masks find every such overlap: wherever three substitutions fall in 16 words,
one of them has a position that avoids all three (``tests/llm`` tries all 560 cases).

Items of fewer than 16 words are compared as a whole, with a fifth of their words substituted at
most (none below six words), by a third mask of three neighbouring words that is lossless for them.
Items of fewer than three words are no evidence inside a longer text, and match where they are the whole text.

Words are what stands between signs and blanks, in lower case. Defined results: a null or blank text on either
side matches nothing; rows that repeat an id are one document; a row without an id keeps the null;
equal items are one item, reported by the smallest id with their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgrid import session
from fleetgrid.session import durable

WINDOW = 16
SUBSTITUTIONS = 3
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 4, 8, 9, 10))
SHORT_MASK = (0, 1, 2)

# Bytes of item words that every executor may hold a copy of; the rows are bounded by ``BROADCAST_ROWS``.
BROADCAST_BYTES = 64_000_000

# Between words: ASCII and Latin-1 signs, general and CJK punctuation, symbols, full-width signs.
# Plain ranges, since the property classes of the regular expressions took half of the time.
NO_WORD = (
    "[\\x00-/:-@\\[-`{-\\u00bf\\u00d7\\u00f7\\u2000-\\u206f\\u2190-\\u2bff\\u3000-\\u303f\\uff00-\\uff0f\\uff1a-\\uff20]+"
)


def words_of(text: Column) -> Column:
    """Lower-case runs between signs; an empty word stands for signs at either end."""
    return F.split(F.lower(text), NO_WORD)


def pair_hash(words: Column, position: Column) -> Column:
    """Hash of the two words that all masks select first."""
    return F.xxhash64(F.get(words, position), F.get(words, position + 1))


def mask_hash(pair: Column, words: Column, position: Column, number: int, mask: tuple[int, ...]) -> Column:
    """Hash of the words that a mask selects after a position; the mask's number keeps masks apart."""
    return F.xxhash64(F.lit(number), pair, *(F.get(words, position + offset) for offset in mask[2:]))


def around(words: Column, position: Column) -> Column:
    """The words that may lie in one window with a position, and before them the first one's position."""
    low = F.greatest(position - (WINDOW - 1), F.lit(0))
    return F.struct(low.alias("low"), F.slice(words, low + 1, position - low + WINDOW).alias("words"))


def seeds(items: DataFrame) -> DataFrame:
    """(seed, pair, item_id, item_copies, item_position, item_size, item_near), one row per mask position.

    ``item_near`` holds at most the 31 words around the position, however long the item is.
    """
    n = F.size("item_words")
    masks = [(number, mask, n >= WINDOW) for number, mask in enumerate(MASKS)]
    masks.append((len(MASKS), SHORT_MASK, n < WINDOW))
    words, position = F.col("item_words"), F.col("item_position")
    at = items.select("*", F.posexplode("item_words").alias("item_position", "word")).drop("word")
    at = at.withColumn("pair", pair_hash(words, position))
    listed = [
        F.when(use & (position + mask[-1] < n), mask_hash(F.col("pair"), words, position, number, mask))
        for number, mask, use in masks
    ]
    found = at.select("*", F.explode(F.array_compact(F.array(*listed))).alias("seed"))
    near = around(words, position).alias("item_near")
    return found.select("seed", "pair", "item_id", "item_copies", "item_position", n.alias("item_size"), near)


def equal_bits(doc: Column, doc_position: Column, item: Column, item_position: Column) -> Column:
    """Bit ``WINDOW - 1 + j`` says that the words j after a hit agree, for j from 1 - WINDOW to WINDOW - 1.

    Both sides are given as ``around`` gives them.
    """
    bits = F.lit(0)
    for j in range(1 - WINDOW, WINDOW):
        mine = F.get(item["words"], item_position - item["low"] + j)
        same = mine == F.get(doc["words"], doc_position - doc["low"] + j)
        bits = bits.bitwiseOR(F.when(same, 1 << (WINDOW - 1 + j)).otherwise(0))
    return bits


def most_equal() -> Column:
    """Most agreeing words of a window that holds the hit and lies in both texts; null without one."""
    bits, n, m = F.col("bits"), F.col("item_size"), F.col("doc_size")
    at, shift = F.col("item_position"), F.col("doc_position") - F.col("item_position")
    whole = F.when((n < WINDOW) & (shift >= 0) & (shift + n <= m), F.bit_count(bits))
    windows = [
        F.when(
            (at - back >= 0) & (at - back + WINDOW <= n) & (at - back + shift >= 0) & (at - back + shift + WINDOW <= m),
            F.bit_count(bits.bitwiseAND((1 << WINDOW) - 1 << (WINDOW - 1 - back))),
        )
        for back in range(WINDOW)
    ]
    return F.greatest(whole, *windows)


def all_seeds(masks: list[tuple[int, tuple[int, ...]]]) -> Column:
    """The hashes of all masks after a position, one row each."""
    words, position = F.col("doc_words"), F.col("doc_position")
    return F.explode(F.array(*(mask_hash(F.col("pair"), words, position, n, mask) for n, mask in masks))).alias("seed")


def hits_of_few(texts: DataFrame, wanted: DataFrame, masks: list) -> DataFrame:
    """Hits where the seeds fit into every executor: the scan of the texts finds them, nothing is shuffled."""
    words, position = F.col("doc_words"), F.col("doc_position")
    placed = (
        texts.select("doc_id", "doc_words", F.posexplode_outer("doc_words").alias("doc_position", "word"))
        .select("doc_id", "doc_words", "doc_position", pair_hash(words, position).alias("pair"))
        .join(F.broadcast(wanted.select("pair").distinct()), "pair", "left_semi")
        .select("doc_id", "doc_words", "doc_position", all_seeds(masks))
    )
    # The compared words are read while hashes are probed, where generated code holds them; only hits are stored.
    whole = F.struct(F.lit(0).alias("low"), words.alias("words"))
    return placed.join(F.broadcast(wanted.drop("pair")), "seed").select(
        *HIT, F.size(words).alias("doc_size"), equal_bits(whole, position, F.col("item_near"), F.col("item_position")).alias("bits")
    )


def hits_of_many(texts: DataFrame, wanted: DataFrame, masks: list) -> DataFrame:
    """Hits by shuffles: hashes of pairs with their places first, then the texts of documents with a known pair once.

    A seed meets the document's words around its place only, so a row holds 31 words at most.
    """
    words, position = F.col("doc_words"), F.col("doc_position")
    marked = texts.withColumn("mark", F.xxhash64("doc_words"))
    places = marked.select("doc_id", "mark", "doc_words", F.posexplode("doc_words").alias("doc_position", "word"))
    places = places.select("doc_id", "mark", "doc_position", pair_hash(words, position).alias("pair"))
    known = places.join(wanted.select("pair").distinct(), "pair", "left_semi")
    known = known.groupBy(F.col("doc_id").alias("known_id"), F.col("mark").alias("known_mark")).agg(
        F.array_distinct(F.collect_list(F.struct("doc_position", "pair"))).alias("places")
    )
    found = marked.join(known, marked["doc_id"].eqNullSafe(F.col("known_id")) & (F.col("mark") == F.col("known_mark")))
    placed = found.select("doc_id", "doc_words", F.inline("places")).select(
        "doc_id", "doc_position", F.size(words).alias("doc_size"), around(words, position).alias("doc_near"), all_seeds(masks)
    )
    return placed.join(wanted.drop("pair"), "seed").select(
        *HIT, "doc_size", equal_bits(F.col("doc_near"), position, F.col("item_near"), F.col("item_position")).alias("bits")
    )


HIT = ("doc_id", "doc_position", "item_id", "item_copies", "item_position", "item_size")


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(doc_id, item_id, item_copies, window_words, matched_words): confirmed overlaps, one row per pair."""
    read = items.select(F.col(item_id_col).alias("item_id"), F.array_remove(words_of(F.col(item_text_col)), "").alias("item_words"))
    distinct = read.filter(F.size("item_words") > 0).groupBy("item_words").agg(
        F.min("item_id").alias("item_id"), F.count("*").alias("item_copies")
    )
    wanted = durable(seeds(distinct.filter(F.size("item_words") >= len(SHORT_MASK))))
    size = F.sum(F.octet_length(F.concat_ws(" ", "item_near.words")))
    rows, held, short = wanted.agg(F.count("*"), size, F.max(F.col("item_size") < WINDOW)).first()
    masks = [*enumerate(MASKS), *([(len(MASKS), SHORT_MASK)] if short else [])]

    texts = docs.select(F.col(id_col).alias("doc_id"), words_of(F.col(text_col)).alias("doc_words"))
    few = rows <= session.BROADCAST_ROWS and (held or 0) <= BROADCAST_BYTES
    hits = durable((hits_of_few if few else hits_of_many)(texts, wanted, masks))
    n = F.col("item_size")
    allowed = F.when(n >= WINDOW, SUBSTITUTIONS).when(n >= 6, F.floor(n / 5)).otherwise(0).cast("int")
    window = F.least(n, F.lit(WINDOW))
    found = (
        hits.select("doc_id", "item_id", "item_copies", window.alias("window_words"), allowed.alias("allowed"), most_equal().alias("matched_words"))
        .filter(F.col("matched_words") >= F.col("window_words") - F.col("allowed"))
        .groupBy("doc_id", "item_id", "item_copies", "window_words")
        .agg(F.max("matched_words").alias("matched_words"))
    )
    # Items of a word or two are found where they are the whole text.
    tiny = distinct.filter(F.size("item_words") < len(SHORT_MASK))
    brief = texts.filter(F.size("doc_words") < len(SHORT_MASK) + 2)
    brief = brief.select("doc_id", F.array_remove("doc_words", "").alias("item_words")).join(tiny, "item_words")
    width = F.size("item_words")
    whole = brief.select("doc_id", "item_id", "item_copies", width.alias("window_words"), width.alias("matched_words")).distinct()
    return found.unionAll(whole)


def without_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """The documents in which no benchmark passage was found; rows without an id are judged each by its text."""
    nameless = F.when(F.col(id_col).isNull(), F.md5(text_col))
    key = F.struct(F.col(id_col).alias("id"), nameless.alias("text"))
    bad = contaminated(docs.select(key.alias("_key"), F.col(text_col)), items, "_key", text_col, **names)
    bad = bad.select(F.col("doc_id.id").alias("_bad_id"), F.col("doc_id.text").alias("_bad_text")).distinct()
    same = F.col(id_col).eqNullSafe(F.col("_bad_id")) & nameless.eqNullSafe(F.col("_bad_text"))
    return docs.join(bad, same, "left_anti")
