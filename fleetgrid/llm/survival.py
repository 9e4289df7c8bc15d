"""How quality filters interact, from truth-table survival words.

Five filters give each document five failure bits, and these a 32-bit word: bit s is set if the
document passes every filter of the subset s. Positional popcounts of the words, per part and
label, are therefore the survivors of all 32 subsets. Words are added by carry-save adders: three words
become a sum word and a carry word of twice the weight, bit by bit, until few words of each weight
are left to be counted. Every task adds up its own words, so 96 numbers per part and task are
shuffled; all orders, steps and Shapley sums are differences of survivors.

Whether a text repeats one with a smaller id is settled inside a block of documents first; only the
least document of each text in a block sends a SHA-256 digest, so a text that a third of all rows
share costs a row a block.

Defined results: a null text is empty; a null language is the part ``''``; a row without an id comes after
all others and has no label; rows that repeat an id are documents of their own, and don't repeat
each other's text; a document is good or toxic if any of its labels says so; no documents, no rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce
from itertools import permutations
from math import factorial
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgrid.llm.blocks import blocks
from fleetgrid.session import durable

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
LABELS = ("all", "good", "toxic")
UPPER = bytes(range(0x41, 0x5B))
WITHIN_CODE_POINT = bytes(range(0x80, 0xC0))

# Bit s of WORDS[f]: whether a document with the failure bits f passes all filters of the subset s.
WORDS = np.array([sum(1 << s for s in range(SUBSETS) if not f & s) for f in range(SUBSETS)], np.uint32)

# Parts that a task counts at once before it sends them on.
HELD_PARTS = 10_000


@dataclass(frozen=True)
class Rules:
    """When the filters A to D fail a text: too few words, too few distinct, too many capitals, a symbol."""

    least_words: int = 200
    least_distinct_percent: int = 50
    most_upper_percent: int = 3
    symbols: bytes = b"#$%&*|"

    def failures(self, text: bytes) -> int:
        words = text.split()
        points = len(text) if text.isascii() else len(text.translate(None, WITHIN_CODE_POINT))
        upper = len(text) - len(text.translate(None, UPPER))
        return (
            (len(words) < self.least_words)
            | (100 * len(set(words)) < self.least_distinct_percent * len(words)) << 1
            | (100 * upper > self.most_upper_percent * points) << 2
            | (len(text.translate(None, self.symbols)) < len(text)) << 3
        )


REPEATS = 1 << 4


def positional_popcounts(words: np.ndarray) -> np.ndarray:
    """How many of the 32-bit words have each bit, by carry-save adders."""
    counts = np.zeros(32, np.int64)
    level, weight = words.astype(np.uint32), 0
    while len(level):
        carries = []
        while len(level) > 2:
            third = len(level) // 3
            a, b, c, rest = level[:third], level[third : 2 * third], level[2 * third : 3 * third], level[3 * third :]
            differ = a ^ b
            carries.append((a & b) | (c & differ))
            level = np.concatenate([differ ^ c, rest])
        bits = np.unpackbits(level.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64) << weight
        level, weight = np.concatenate(carries) if carries else level[:0], weight + 1
    return counts


def judged_rows(rules: Rules):
    """Task: (doc_id, part, fails, print) per document; the print is null where repetition is settled."""

    def work(batches):
        for block, texts in blocks(batches, "text"):
            ids = block.column(0).to_pylist()
            keys = [(doc is None, doc or 0) for doc in ids]
            least: dict[bytes, tuple] = {}
            for key, text in zip(keys, texts):
                if text not in least or key < least[text]:
                    least[text] = key
            known = {text: (rules.failures(text), hashlib.sha256(text).digest()) for text in least}
            fails, prints = [], []
            for key, text in zip(keys, texts):
                failed, digest = known[text]
                # A row without an id repeats only texts of rows that have one.
                later = key > least[text] and not least[text][0]
                fails.append(failed | REPEATS if later else failed)
                prints.append(None if later else digest)
            yield pa.RecordBatch.from_arrays(
                [block.column(0), block.column(2), pa.array(fails, pa.int32()), pa.array(prints, pa.binary())],
                ["doc_id", "part", "fails", "print"],
            )

    return work


def failures(
    docs: DataFrame, rules: Rules | None = None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang"
) -> DataFrame:
    """(doc_id, part, fails): the five failure bits of every document, filter A lowest."""
    part = F.coalesce(F.col(part_col).cast("string"), F.lit(""))
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), part.alias("part"))
    judged = durable(read.mapInArrow(judged_rows(rules or Rules()), "doc_id long, part string, fails int, print binary"))
    unsettled = judged.filter("print IS NOT NULL")
    several = unsettled.groupBy("print").agg(F.min("doc_id").alias("least"), F.count("*").alias("held"))
    several = several.filter("held > 1 AND least IS NOT NULL").select("print", "least")
    later = F.col("least").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("least")))
    fails = F.when(later, F.col("fails").bitwiseOR(REPEATS)).otherwise(F.col("fails")).alias("fails")
    settled = judged.filter("print IS NULL").select("doc_id", "part", "fails")
    return settled.unionAll(unsettled.join(several, "print", "left").select("doc_id", "part", fails))


def counted_words(batches):
    """Task: per part the survivors of every subset among all, good and toxic documents, 96 numbers."""
    held: dict[str, np.ndarray] = {}

    def sent():
        counts = pa.array([c.ravel().tolist() for c in held.values()], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), counts], ["part", "counts"])

    for batch in batches:
        parts = batch.column(0).dictionary_encode()
        of, names = parts.indices.to_numpy(zero_copy_only=False), parts.dictionary.to_pylist()
        fails, label = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
        order = np.lexsort((label, of))
        group = of[order].astype(np.int64) * len(LABELS) + label[order]
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else []
        for start, end in zip(first, [*first[1:], len(group)]):
            name, kind = names[group[start] // len(LABELS)], group[start] % len(LABELS)
            counts = held.setdefault(name, np.zeros((len(LABELS), SUBSETS), np.int64))
            counts[kind] += positional_popcounts(WORDS[fails[order[start:end]]])
        if len(held) > HELD_PARTS:
            yield sent()
            held.clear()
    yield sent()


def survivors(judged: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(part, all, good, toxic): per part and label the survivors of each of the 32 subsets, as lists."""
    marks = labels.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    marks = marks.filter("good OR toxic")
    labelled = judged.join(marks, "doc_id").select(
        "part", "fails", F.explode(F.expr("filter(array(if(good, 1, 0), if(toxic, 2, 0)), k -> k > 0)")).alias("label")
    )
    words = judged.select("part", "fails", F.lit(0).alias("label")).unionAll(labelled)
    counts = words.mapInArrow(counted_words, "part string, counts array<bigint>")

    def total(k: int) -> Column:
        return F.array(*[F.sum(F.col("counts")[k * SUBSETS + s]) for s in range(SUBSETS)]).alias(LABELS[k])

    return counts.groupBy("part").agg(*[total(k) for k in range(len(LABELS))])


def interactions(counts: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, from the survivors of all subsets."""
    orders = F.array(*[F.lit("".join(order)) for order in permutations(FILTERS)])
    steps = counts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.expr("sequence(1, 5)")))
    earlier = "filter(sequence(0, 4), f -> instr(filter_order, chr(65 + f)) < step)"
    steps = steps.withColumn("number", F.expr("ascii(substring(filter_order, step, 1)) - 65"))
    steps = steps.withColumn("bit", F.expr("shiftleft(1, number)"))
    steps = steps.withColumn("before", F.expr(f"aggregate({earlier}, 0, (s, f) -> s + shiftleft(1, f))"))

    def left(label: str, subset: Column) -> Column:
        return F.get(F.col(label), subset)

    after = F.col("before").bitwiseOR(F.col("bit"))

    def lost(label: str) -> Column:
        return left(label, F.col("before")) - left(label, after)

    fails_at_all = left("all", F.lit(0)) - left("all", F.col("bit"))
    others = F.lit(SUBSETS - 1) - F.col("bit")
    return steps.select(
        "part",
        "filter_order",
        "step",
        left("all", after).alias("kept"),
        lost("all").alias("removed"),
        (fails_at_all - lost("all")).alias("redundant"),
        (left("all", others) - left("all", F.lit(SUBSETS - 1))).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        F.element_at(F.array(*[shapley(bit) for bit in range(len(FILTERS))]), F.col("number") + 1).alias("shapley"),
    )


def shapley(number: int) -> Column:
    """What a filter removes, summed over all orders: each subset precedes it in |s|! (4 - |s|)! of them."""
    bit, others = 1 << number, len(FILTERS) - 1
    terms = []
    for subset in range(SUBSETS):
        if not subset & bit:
            size = subset.bit_count()
            times = factorial(size) * factorial(others - size)
            terms.append((F.col("all")[subset] - F.col("all")[subset | bit]) * times)
    return reduce(add, terms)


def filter_audit(
    docs: DataFrame,
    labels: DataFrame,
    rules: Rules | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "lang",
) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)."""
    judged = durable(failures(docs, rules, id_col, text_col, part_col))
    return interactions(survivors(judged, labels, id_col))
