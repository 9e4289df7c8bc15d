"""Reading texts inside tasks: Arrow batches in blocks of a bounded size, and words of a block."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Bytes of text that one step of a task works on; a longer text is a block of its own.
BLOCK_BYTES = 4_000_000

# Distinct words that a task remembers before it starts anew; a worker keeps none from task to task.
CACHED_WORDS = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(array: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [value or b"" for value in array.cast(pa.large_binary()).to_pylist()]


def blocks(
    batches: Iterator[pa.RecordBatch], text: str, most: int = BLOCK_BYTES
) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with at most ``most`` bytes of text, or one row, and their texts."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = [0 if n is None else n for n in pc.binary_length(column).to_pylist()]
        start, held = 0, 0
        for row, size in enumerate(sizes):
            if row > start and held + size > most:
                part = batch.slice(start, row - start)
                yield part, text_bytes(part.column(batch.schema.get_field_index(text)))
                start, held = row, 0
            held += size
        if start < len(sizes):
            part = batch.slice(start)
            yield part, text_bytes(part.column(batch.schema.get_field_index(text)))


def split_words(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of all texts in order, and how many each text has.

    ``bytes.split`` cuts at exactly these six bytes, which occur in no longer UTF-8 sequence.
    """
    each = [text.split() for text in texts]
    counts = np.fromiter(map(len, each), np.int64, len(each))
    return list(chain.from_iterable(each)), counts


class WordIndex(dict):
    """Numbers for words in order of appearance; words not yet encoded wait in ``pending``."""

    def __init__(self) -> None:
        super().__init__()
        self.pending: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        self.pending.append(word)
        return number


class WordCodes:
    """Token ids per distinct word, encoded once and remembered by a task.

    ``encode`` gives the ids of all words one after the other, and how many each word has. Used as a
    context, it forgets all words at the end: workers are reused, by other stages too.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], cached: int = CACHED_WORDS) -> None:
        self.encode, self.cached = encode, cached
        self.clear()

    def __enter__(self) -> WordCodes:
        return self

    def __exit__(self, *_) -> None:
        self.clear()
        pa.default_memory_pool().release_unused()

    def clear(self) -> None:
        self.index = WordIndex()
        self.flat = np.zeros(0, np.int32)
        self.lengths = np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Index of every word; new words are encoded."""
        if len(self.index) > self.cached:
            self.clear()
        found = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        if self.index.pending:
            ids, sizes = self.encode(self.index.pending)
            self.flat = np.concatenate([self.flat, ids])
            self.lengths = np.concatenate([self.lengths, sizes])
            self.starts = np.cumsum(self.lengths) - self.lengths
            self.index.pending = []
        return found

    def tokens(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the words in order, and how many each word has."""
        sizes = self.lengths[numbers]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(self.starts[numbers] - (ends - sizes), sizes) + np.arange(total)
        return self.flat[at], sizes


def flattened(codes: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all lists one after the other, and how many each list has."""
    sizes = np.fromiter(map(len, codes), np.int64, len(codes))
    return np.fromiter(chain.from_iterable(codes), np.int32, int(sizes.sum())), sizes


def per_text(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each text, of which text i owns the next ``counts[i]`` values."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def total_bytes(docs: DataFrame, text: str) -> int:
    """Bytes of all texts; a scan of one column."""
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
