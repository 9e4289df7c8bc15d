"""Ranked lexical search over impact lists by the Best Position Algorithm.

An index row holds one block of documents: their terms, and per term the documents that hold it with
the number of times. Counts over all rows give each term its weight. A search then orders every
list of an item's terms by impact, within each block, and reads the lists in step. A document met in one
list is looked up in all others by direct access, so its score is whole at once, and its places there
count as seen. The best position of a list is the end of the stretch of places seen without a
gap. No unseen document can score above the sum of the impacts that follow the best positions; the
search of a block stops when that sum is strictly below the k-th score found so far, in this or
an earlier block of the task, so that ties with the k-th are all met.

Each task keeps k documents per item; windows merge them in two levels. Items go to the tasks in blocks of
``ITEM_BYTES`` of text: a larger set of items takes several passes over the index.

Defined results: a null or termless text is no document; every item row is an item of its own, also
if it repeats an id, and one without terms has no results; rows that repeat a document id are
documents of their own; documents without an id come after all others with the same score.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetgrid.llm.blocks import WordIndex, blocks
from fleetgrid.session import durable, work_folder

# A term is a stretch of these bytes: ASCII letters and digits, and all of UTF-8 beyond ASCII.
TERM_BYTES = bytes(b for b in range(256) if b >= 0x80 or chr(b).isalnum())
FOLDED = bytes(ord(chr(b).lower()) if b < 0x80 and b in TERM_BYTES else b if b in TERM_BYTES else 0x20 for b in range(256))

# Bytes of text that one index row covers.
BLOCK = 8_000_000

# Bytes of item text that tasks hold at once.
ITEM_BYTES = 8_000_000

# Places read from every list in the first round; each further round reads twice as many.
FIRST_PLACES = 64

# Partial results of one item are merged in so many groups first.
MERGE_GROUPS = 64

INDEX = (
    "n_docs long, n_terms long, ids binary, without_id binary, lengths binary, terms binary, starts binary, "
    "posted binary, times binary"
)


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(FOLDED).split()


def packed(values: np.ndarray) -> bytes:
    """Non-negative integers in as few bytes each as the largest needs."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0)))).tobytes()


def unpacked(blob: bytes, count: int) -> np.ndarray:
    """What ``packed`` got, as 64-bit integers."""
    kind = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}[len(blob) // max(count, 1) or 1]
    return np.frombuffer(blob, kind, count).astype(np.int64)


def index_rows(most: int):
    """Task: one index row per block of (doc_id, text) with at most ``most`` bytes of text."""

    def work(batches):
        for block, texts in blocks(batches, "text", most):
            each = [terms_of(text) for text in texts]
            lengths = np.fromiter(map(len, each), np.int64, len(each))
            numbers = WordIndex()
            terms = np.fromiter(map(numbers.__getitem__, chain.from_iterable(each)), np.int64, int(lengths.sum()))
            del each
            pairs = np.sort(terms * len(texts) + np.repeat(np.arange(len(texts)), lengths))
            first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])) if len(pairs) else np.zeros(0, np.int64)
            times = np.diff(np.append(first, len(pairs)))
            starts = np.searchsorted(pairs[first], np.arange(len(numbers) + 1) * len(texts))
            missing = block.column(0).is_null().to_numpy(zero_copy_only=False)
            ids = block.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            row = (
                int((lengths > 0).sum()),
                int(lengths.sum()),
                ids.tobytes(),
                missing.astype(np.uint8).tobytes(),
                packed(lengths),
                b" ".join(numbers.pending),
                packed(starts),
                packed(pairs[first] % len(texts)),
                packed(times),
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], pa.int64() if isinstance(v, int) else pa.binary()) for v in row],
                [part.split()[0] for part in INDEX.split(", ")],
            )

    return work


def build_index(
    docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK
) -> DataFrame:
    """The index of all terms of ``docs``, written below the shared folder or to ``path``."""
    path = path or work_folder(docs.sparkSession, "impacts")
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    read.mapInArrow(index_rows(block), INDEX).write.parquet(path)
    return docs.sparkSession.read.schema(INDEX).parquet(path)


@dataclass(frozen=True)
class Item:
    """A query: its id, and how often it holds each term, by the term's number."""

    row: int
    item_id: int | None
    counts: tuple[tuple[int, int], ...]


def numbered_items(rows: list) -> tuple[list[Item], dict[bytes, int]]:
    """Items from (row, item_id, text), and the number of every term."""
    numbers: dict[bytes, int] = {}
    items = []
    for row, item_id, text in rows:
        counts: dict[int, int] = {}
        for term in terms_of((text or "").encode()):
            number = numbers.setdefault(term, len(numbers))
            counts[number] = counts.get(number, 0) + 1
        items.append(Item(row, item_id, tuple(sorted(counts.items()))))
    return items, numbers


def held_terms(blob: bytes, numbers: dict[bytes, int]) -> list[tuple[int, int]]:
    """(number among the items' terms, number in the block) of the terms that both have."""
    return [(numbers[term], at) for at, term in enumerate(blob.split(b" ")) if term in numbers]


def document_counts(index: DataFrame, numbers: dict[bytes, int]) -> np.ndarray:
    """In how many documents each of the items' terms occurs."""

    def work(batches):
        found = np.zeros(len(numbers), np.int64)
        for batch in batches:
            for terms, starts in zip(*(batch.column(k).to_pylist() for k in (0, 1))):
                held = held_terms(terms, numbers)
                if held:
                    mine, there = np.array(held, np.int64).T
                    ends = unpacked(starts, terms.count(b" ") + 2)
                    found[mine] += ends[there + 1] - ends[there]
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(found[some])], ["term", "docs"])

    counted = index.select("terms", "starts").mapInArrow(work, "term long, docs long")
    total = np.zeros(len(numbers), np.int64)
    # One row per term of at most ITEM_BYTES of items.
    for row in counted.groupBy("term").agg(F.sum("docs").alias("docs")).collect():
        total[row["term"]] = row["docs"]
    return total


def weights(doc_counts: np.ndarray, n: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(df) + 1))) for df in doc_counts], np.int64)


def length_marks(lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    """Per document 25 plus 75 times its length over the mean length, rounded down."""
    if 75 * int(lengths.max(initial=0)) * n < 1 << 63:
        return 25 + 75 * lengths * n // total
    return np.array([25 + 75 * int(length) * n // total for length in lengths], np.int64)


class ImpactList:
    """One term's documents in a block, by document for direct access and by impact for reading in order."""

    def __init__(self, docs: np.ndarray, impacts: np.ndarray) -> None:
        self.docs, self.impacts = docs, impacts
        self.order = np.argsort(-impacts, kind="stable")
        self.place = np.empty(len(docs), np.int64)
        self.place[self.order] = np.arange(len(docs))


class Best:
    """The k best documents of one item so far: (-score, whether the id is missing, id)."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.held: list[tuple[int, int, int]] = []

    @property
    def least(self) -> int:
        """The k-th score, 0 while there are fewer."""
        return -self.held[-1][0] if len(self.held) == self.k else 0

    def offer(self, scores: np.ndarray, missing: np.ndarray, ids: np.ndarray) -> None:
        good = np.flatnonzero((scores > 0) & (scores >= self.least))
        if len(good):
            good = good[np.lexsort((ids[good], missing[good], -scores[good]))[: self.k]]
            rows = zip((-scores[good]).tolist(), missing[good].tolist(), ids[good].tolist())
            self.held = sorted([*self.held, *rows])[: self.k]


def best_positions(
    lists: list[tuple[int, ImpactList]], missing: np.ndarray, ids: np.ndarray, best: Best, first: int = FIRST_PLACES
) -> int:
    """Offer ``best`` all documents of a block that may belong there; returns how many were scored.

    ``lists`` holds (factor, list) per term; a document scores the sum of factor times impact.
    """
    seen = np.zeros(len(ids), bool)
    reached = [np.zeros(len(held.docs), bool) for _, held in lists]
    position = [0] * len(lists)
    depth, step, scored = 0, first, 0
    while True:
        bound = sum(
            factor * int(held.impacts[held.order[at]])
            for (factor, held), at in zip(lists, position)
            if at < len(held.order)
        )
        if bound == 0 or bound < best.least:
            return scored
        met = np.unique(np.concatenate([held.docs[held.order[depth : depth + step]] for _, held in lists]))
        met = met[~seen[met]]
        seen[met] = True
        scored += len(met)
        scores = np.zeros(len(met), np.int64)
        for j, (factor, held) in enumerate(lists):
            at = np.minimum(np.searchsorted(held.docs, met), len(held.docs) - 1)
            hit = held.docs[at] == met
            at = at[hit]
            scores[hit] += factor * held.impacts[at]
            reached[j][held.place[at]] = True
            rest = reached[j][position[j] :]
            if len(rest):
                gap = int(rest.argmin())
                position[j] += len(rest) if rest[gap] else gap
        best.offer(scores, missing[met], ids[met])
        depth += step
        step *= 2


def search_rows(items: list[Item], numbers: dict[bytes, int], weight: np.ndarray, n: int, total: int, k: int):
    """Task: the k best documents of its blocks for every item."""

    def work(batches):
        found = [Best(k) for _ in items]
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in range(7))):
                ids, missing = np.frombuffer(row[0], np.int64), np.frombuffer(row[1], np.uint8)
                marks = length_marks(unpacked(row[2], len(ids)), n, total)
                starts = unpacked(row[4], row[3].count(b" ") + 2)
                posted, times = unpacked(row[5], int(starts[-1])), unpacked(row[6], int(starts[-1]))
                lists: dict[int, ImpactList] = {}
                for term, at in held_terms(row[3], numbers):
                    docs, tf = (x[starts[at] : starts[at + 1]] for x in (posted, times))
                    lists[term] = ImpactList(docs, 1_000_000_000 * tf // (1000 * tf + 8 * marks[docs]))
                for item, best in zip(items, found):
                    mine = [(int(weight[t]) * c, lists[t]) for t, c in item.counts if t in lists and weight[t] > 0]
                    if mine:
                        best_positions(mine, missing, ids, best)
        rows = [(i.row, i.item_id, None if m else d, -s) for i, best in zip(items, found) for s, m, d in best.held]
        columns = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["row", "item_id", "doc_id", "score"])

    return work


def search(index: DataFrame, items: DataFrame, k: int = 10, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of the index for every item."""
    spark = index.sparkSession
    n, total = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).alias("text"))
    asked = durable(asked.withColumn("row", F.monotonically_increasing_id()))
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if not n or not size:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    passes = -(-size // ITEM_BYTES)
    read = index.select("ids", "without_id", "lengths", "terms", "starts", "posted", "times")
    parts = []
    for number in range(passes):
        mine = asked.filter(F.pmod(F.hash("row"), F.lit(passes)) == number).select("row", "item_id", "text")
        known, numbers = numbered_items([tuple(row) for row in mine.collect()])
        weight = weights(document_counts(index, numbers), n)
        work = search_rows(known, numbers, weight, n, total, k)
        parts.append(read.mapInArrow(work, "row long, item_id long, doc_id long, score long"))
    found = reduce(DataFrame.unionAll, parts).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(MERGE_GROUPS)))
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    within = F.row_number().over(Window.partitionBy("row", "part").orderBy(*order))
    merged = found.withColumn("rank", within).filter(F.col("rank") <= k).drop("rank")
    over = F.row_number().over(Window.partitionBy("row").orderBy(*order))
    return merged.withColumn("rank", over).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
