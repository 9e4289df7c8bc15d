"""Packing by cutting-stock column generation.

Every document becomes token ids with an end id, cut into pieces of ``capacity`` tokens and a rest.
The rests are counted by length, in steps of ``UNIT`` tokens rounded up. A linear program over
patterns of lengths covers the histogram with the fewest sequences: knapsack dynamic programming
prices new patterns from the dual values until the bound is within ``GAP``. Rounded patterns, and a
first-fit packing of what rounding leaves, are dealt to the documents by their rank in their length.

The driver solves for at most ``capacity / UNIT`` lengths whatever the input's size; counting,
ranking and dealing are Spark jobs. Ranks come from salted counts, so one length may hold any share
of the rows.

Defined results: a null or empty text is its end id alone; a special string in a text is its special id; repeated rows and rows without an id are
packed like all others.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetgrid.llm.blocks import CACHED_WORDS, WordCodes, blocks, flattened, split_words
from fleetgrid.session import durable

CAPACITY = 2048
END_ID = 1
UNIT = 4
GAP = 1e-3

# Pieces that one salted group of a length holds on average at most.
RANKED_ROWS = 2_000


# Fixed value: how the 49,408-token file cuts lower-case text into parts.
PARTS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
# The same for lines of printable ASCII and the letters of Latin-1, which normalisation leaves alone.
PLAIN_WORD = re.compile("[!-~À-ÖØ-öø-ÿ]+")
PLAIN_PARTS = re.compile("\n|'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9\n]+")
# Special strings begin like this; words with it take the tokenizer's own way.
SPECIAL = "<|"


def byte_signs() -> dict[int, str]:
    """How byte-level vocabularies write the bytes that are no printable Latin-1 sign: from U+0100 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {byte: chr(0x100 + place) for place, byte in enumerate(b for b in range(256) if b not in plain)}


SIGNS = byte_signs()


def cuts_as_known(tokenizer) -> bool:
    """Whether a tokenizer lower-cases and cuts words by ``PARTS``, so that plain parts can be encoded alone."""
    form = json.loads(tokenizer.to_str())
    steps = [step["type"] for step in (form["normalizer"] or {}).get("normalizers", [])]
    cuts = (form["pre_tokenizer"] or {}).get("pretokenizers", [])
    return (
        steps == ["NFC", "Replace", "Lowercase"]
        and [cut["type"] for cut in cuts] == ["Split", "ByteLevel"]
        and cuts[0]["pattern"] == {"Regex": PARTS}
        and not cuts[1]["add_prefix_space"]
        and all(token["content"].startswith(SPECIAL) for token in form["added_tokens"])
    )


class PartIds(dict):
    """Numbers of parts of words; the ids of part n are ``ids[starts[n] : starts[n + 1]]``."""

    def __init__(self, model) -> None:
        super().__init__()
        self.model = model
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.ids, self.starts = array("i"), array("q", [0, 0])
        # The line feed between words, which has no ids.
        self["\n"] = 0

    def __missing__(self, part: str) -> int:
        written = part if part.isascii() else part.encode().decode("latin-1").translate(SIGNS)
        number = self[part] = len(self)
        self.ids.extend(token.id for token in self.model.tokenize(written))
        self.starts.append(len(self.ids))
        return number


class VocabularyWords(WordCodes):
    """Ids per word of a ``tokenizers`` file whose tokens never cross white space.

    Special strings in a text are the special ids, as in the file's own way to encode.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.by_part = cuts_as_known(self.tokenizer)
        self.parts = PartIds(self.tokenizer.model)
        super().__init__(self.encode_words)

    def __exit__(self, *_) -> None:
        self.parts.clear()
        super().__exit__()

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [word.decode("utf-8", "replace") for word in words]
        if not self.by_part:
            return flattened(self.in_running_text(texts))
        plain = np.fromiter((bool(PLAIN_WORD.fullmatch(t)) and SPECIAL not in t for t in texts), bool, len(texts))
        sizes = np.zeros(len(texts), np.int64)
        ids, sizes[plain] = self.from_parts([text for text, easy in zip(texts, plain) if easy])
        if plain.all():
            return ids, sizes
        others, sizes[~plain] = flattened(self.in_running_text([text for text, easy in zip(texts, plain) if not easy]))
        found = np.empty(len(ids) + len(others), np.int32)
        of_plain = np.repeat(plain, sizes)
        found[of_plain], found[~of_plain] = ids, others
        return found, sizes

    def from_parts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain words: cut all at once, look up every part."""
        if len(self.parts) > CACHED_WORDS:
            self.parts.clear()
        cut = PLAIN_PARTS.findall("".join(text + "\n" for text in texts).lower())
        numbers = np.fromiter(map(self.parts.__getitem__, cut), np.int64, len(cut))
        starts = np.frombuffer(self.parts.starts, np.int64)
        ids = np.frombuffer(self.parts.ids, np.int32) if self.parts.ids else np.zeros(0, np.int32)
        each = starts[numbers + 1] - starts[numbers]
        ends = np.cumsum(each)
        at = np.repeat(starts[numbers] - (ends - each), each) + np.arange(int(ends[-1]) if len(ends) else 0)
        return ids[at], np.diff(ends[numbers == 0], prepend=0)

    def in_running_text(self, texts: list[str]) -> list:
        """Many words in one text; a token belongs to the word it starts in."""
        found: list = []
        for start in range(0, len(texts), 1000):
            some = texts[start : start + 1000]
            ends = np.cumsum([len(text) + 1 for text in some])
            coded = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            ids = np.array(coded.ids, np.int32)
            places = np.array([a for a, _ in coded.offsets], np.int64)
            found.extend(np.split(ids, np.searchsorted(places, ends[:-1])))
        return found


@cache
def word_ids(path: str) -> VocabularyWords:
    """The words of a file; one per worker."""
    return VocabularyWords(path)


def pieces(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, capacity: int, end_id: int, with_ids: bool) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]) of every piece."""

    def work(batches):
        with word_ids(tokenizer) as codes:
            for block, texts in blocks(batches, "text"):
                words, counts = split_words(texts)
                tokens, sizes = codes.tokens(codes.numbers(words))
                ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(counts)]
                keys = block.column(0).to_pylist()
                rows: list[tuple] = []
                begin = 0
                for key, end in zip(keys, ends.tolist()):
                    ids = np.append(tokens[begin:end], end_id).astype("<u4")
                    begin = end
                    for start in range(0, len(ids), capacity):
                        part = ids[start : start + capacity]
                        row = (key, start, len(part), zlib.crc32(part.tobytes()), len(ids))
                        rows.append((*row, part.tolist()) if with_ids else row)
                kinds = [pa.int64()] * 5 + [pa.list_(pa.int32())] * with_ids
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    names = [part.split()[0] for part in schema.split(", ")]
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, schema)


def best_pattern(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes within the capacity: unbounded knapsack over capacities."""
    best, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        fitting = int(np.searchsorted(sizes, room, "right"))
        best[room] = best[room - 1]
        if fitting:
            worth = values[:fitting] + best[room - sizes[:fitting]]
            item = int(worth.argmax())
            if worth[item] > best[room] + 1e-12:
                best[room], taken[room] = worth[item], item
    pattern, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if taken[room] < 0:
            room -= 1
        else:
            pattern[taken[room]] += 1
            room -= int(sizes[taken[room]])
    return float(best[capacity]), pattern


def solve(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = GAP) -> list[tuple[np.ndarray, int]]:
    """Patterns (copies per size) and how often each is used; together they cover the demand exactly.

    The simplex starts from one pattern per size. The patterns of a first-fit packing of the scaled
    histogram enter first, then those that the knapsack prices; a pattern once made stays in the pool.
    """
    m = len(sizes)
    if not m:
        return []
    columns = np.diag(capacity // sizes).astype(float)
    inverse = np.diag(1.0 / np.diag(columns))
    level = inverse @ demand
    scale = max(1, int(demand.sum()) // (8 * m))
    pool = np.array([pattern for pattern, _ in first_fit(sizes, -(-demand // scale), capacity)], float).T
    for _ in range(40 * m):
        duals = inverse.sum(0)
        worths = duals @ pool
        at = int(worths.argmax())
        worth, pattern = float(worths[at]), pool[:, at]
        if worth <= 1 + gap:
            worth, pattern = best_pattern(sizes, duals, capacity)
            pool = np.column_stack([pool, pattern])
        if worth <= 1 + gap:
            break
        step = inverse @ pattern
        ratio = np.where(step > 1e-9, level / np.where(step > 1e-9, step, 1), np.inf)
        leaves = int(ratio.argmin())
        pivot = inverse[leaves] / step[leaves]
        inverse -= np.outer(step, pivot)
        inverse[leaves] = pivot
        columns[:, leaves] = pattern
        level = np.maximum(inverse @ demand, 0)
    used, rest = [], demand.astype(np.int64).copy()
    for k in np.argsort(-level):
        pattern = columns[:, k].astype(np.int64)
        held = pattern > 0
        times = min(int(level[k] + 1e-6), int((rest[held] // pattern[held]).min()))
        if times:
            used.append((pattern, times))
            rest -= pattern * times
    return used + first_fit(sizes, rest, capacity)


def first_fit(sizes: np.ndarray, rest: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """What rounding left: a few pieces per pattern, each put where it first fits, largest first."""
    patterns: list[np.ndarray] = []
    room = np.zeros(0, np.int64)
    for k in range(len(sizes) - 1, -1, -1):
        for _ in range(int(rest[k])):
            open_ = np.flatnonzero(room >= sizes[k])
            if len(open_):
                at = int(open_[0])
            else:
                at, room = len(room), np.append(room, capacity)
                patterns.append(np.zeros(len(sizes), np.int64))
            patterns[at][k] += 1
            room[at] -= sizes[k]
    return [(pattern, 1) for pattern in patterns]


@dataclass
class Deal:
    """For one length: from rank ``ranks[i]`` on, ``copies[i]`` pieces go to each sequence from ``first[i]`` on."""

    ranks: list[int] = field(default_factory=list)
    copies: list[int] = field(default_factory=list)
    first: list[int] = field(default_factory=list)
    next: int = 0

    def add(self, copies: int, first: int, times: int) -> None:
        self.ranks.append(self.next)
        self.copies.append(copies)
        self.first.append(first)
        self.next += copies * times


def deals(counts: dict[int, int], units: int) -> dict[int, Deal]:
    """How the ranked pieces of each length (in units) go to sequences."""
    found = {size: Deal() for size in counts}
    sizes = np.array(sorted(size for size in counts if size < units), np.int64)
    demand = np.array([counts[int(size)] for size in sizes], np.int64)
    sequence = 0
    for pattern, times in solve(sizes, demand, units):
        for k in np.flatnonzero(pattern):
            found[int(sizes[k])].add(int(pattern[k]), sequence, times)
        sequence += times
    if units in counts:
        found[units].add(1, sequence, counts[units])
    return found


def ranked(cut: DataFrame, held: dict[int, int]) -> DataFrame:
    """``cut`` with ``rank``, 0-based within ``size``, from counts of salted groups; ``held`` counts the rows of each size.

    The rows of a frequent size get as many salts as they need groups of ``RANKED_ROWS``.
    """
    most = max(held, default=0)
    salts = F.array(*[F.lit(-(-held.get(size, 1) // RANKED_ROWS)) for size in range(most + 1)])
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.get(salts, F.col("size").cast("int"))))
    before = Window.partitionBy("size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = salted.groupBy("size", "salt").agg(F.count("*").alias("held"))
    offsets = counts.select("size", "salt", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("size", "salt").orderBy("length", "doc_id", "start", "ids_crc32")
    numbered = salted.withColumn("inside", F.row_number().over(inside))
    return numbered.join(offsets, ["size", "salt"]).withColumn("rank", F.col("offset") + F.col("inside") - 1)


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    unit: int = UNIT,
    with_ids: bool = False,
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]) of every piece."""
    if capacity % unit:
        raise ValueError("the capacity must be a multiple of the unit")
    cut = durable(pieces(docs, tokenizer, id_col, text_col, capacity, end_id, with_ids))
    cut = cut.withColumn("size", F.ceil(F.col("length") / unit))
    counts = {row["size"]: row["n"] for row in cut.groupBy("size").agg(F.count("*").alias("n")).collect()}
    dealt = deals(counts, capacity // unit)
    plan = {size: tuple(np.array(x, np.int64) for x in (d.ranks, d.copies, d.first)) for size, d in dealt.items()}

    def deal(batches):
        for batch in batches:
            size, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            sequence, slot = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for each in np.unique(size):
                here = size == each
                ranks, copies, first = plan[int(each)]
                at = np.searchsorted(ranks, rank[here], "right") - 1
                inside = rank[here] - ranks[at]
                sequence[here] = first[at] + inside // copies[at]
                slot[here] = inside % copies[at]
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(sequence), pa.array(slot)], ["row", "sequence_id", "slot"])

    kept = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] * with_ids)]
    rows = ranked(cut, counts).select("size", "rank", F.struct(*kept, "size").alias("row"))
    schema = rows.select("row").schema.add("sequence_id", "long").add("slot", "long")
    placed = rows.mapInArrow(deal, schema).select("row.*", "sequence_id", "slot")
    order = Window.partitionBy("sequence_id").orderBy(F.desc("size"), "slot").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(order), F.lit(0))
    return placed.withColumn("offset", offset).select(*kept[:5], "sequence_id", "offset", *kept[5:])
