"""Language-model scores from the lattice of subword segmentations.

A word, with its start mark, may be segmented into pieces of an existing vocabulary in many ways.
The model weights every segmentation by the product of its piece probabilities, and a log-space
forward recursion adds them up; as no piece crosses a word start, the probability of a text is the
product over its words and one end. The vocabulary's own scores set the first weights: they are
merge ranks, read as Zipf's law. One expectation step over all training words, counted over the
whole corpus, sets the weights that score.

The expected counts are smoothed by the first weights, ``SMOOTHING`` a piece on average, so that pieces the corpus
never needs keep the order that the vocabulary gives them.

Words and their counts are tables keyed by word; documents are grouped by a hash into sources of
``SOURCE_BYTES`` of text, and each source meets the words that occur in it. Equal rows of a block go as one row
with their number. Only the weights, one number per piece of the vocabulary, reach the driver.

Defined results: a null or blank text is one end token; repeated rows each count and are each
scored; a row without an id trains and is not held out; without training rows all counts are zero.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import cache
from math import exp, log1p

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgrid.llm.blocks import blocks, per_text, total_bytes
from fleetgrid.session import durable

SOURCE_BYTES = 32_000_000
START = "▁"
END = b""
ZIPF_SHIFT = 2.7
SMOOTHING = 0.1
NEVER = -math.inf

# Bytes of text whose words one step of the count adds up.
COUNTED_BYTES = 16_000_000


@cache
def vocabulary_pieces(path: str) -> tuple[tuple[str, ...], tuple[float, ...], dict[int, int]]:
    """Pieces of a sentencepiece file, their scores, and the piece of each byte."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    count = model.get_piece_size()
    names = tuple(
        "" if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) else model.id_to_piece(i) for i in range(count)
    )
    bytes_ = {int(model.id_to_piece(i)[3:5], 16): i for i in range(count) if model.is_byte(i)}
    return names, tuple(model.get_score(i) for i in range(count)), bytes_


def first_weights(path: str) -> np.ndarray:
    """Log probabilities of the pieces, Zipf's law on the rank that the vocabulary's scores give."""
    _, scores, _ = vocabulary_pieces(path)
    rank = np.empty(len(scores))
    rank[np.argsort(-np.array(scores), kind="stable")] = np.arange(len(scores))
    weights = 1.0 / (rank + ZIPF_SHIFT)
    return np.log(weights / weights.sum())


class Lattice:
    """Arcs of a word: pieces that match at a place, bytes where no piece holds the character."""

    def __init__(self, path: str, weights: np.ndarray) -> None:
        names, _, self.bytes = vocabulary_pieces(path)
        self.weights = weights.tolist()
        # Pieces, and with -1 all that some piece begins with, so a search ends where no piece goes on.
        self.pieces: dict[str, int] = {}
        for number, name in enumerate(names):
            if name:
                for end in range(1, len(name)):
                    self.pieces.setdefault(name[:end], -1)
                self.pieces[name] = number
        self.ends = names.index("") if "" in names else 0

    def arcs(self, text: str) -> list[tuple[int, int, float, int | list[int]]]:
        """(place, next place, log weight, piece or bytes) of all arcs, by place."""
        found: list = []
        add, get, weights, n = found.append, self.pieces.get, self.weights, len(text)
        for at in range(n):
            single = False
            for end in range(at + 1, n + 1):
                number = get(text[at:end])
                if number is None:
                    break
                if number >= 0:
                    single = single or end == at + 1
                    add((at, end, weights[number], number))
            if not single:
                parts = [self.bytes[b] for b in text[at].encode()]
                add((at, at + 1, sum(weights[p] for p in parts), parts))
        return found

    def forward(self, word: bytes) -> float:
        """Natural log of the summed weight of all segmentations."""
        if word == END:
            return self.weights[self.ends]
        text = START + word.decode("utf-8", "replace")
        return ahead_of(self.arcs(text), len(text))[-1]

    def expect(self, word: bytes, times: float, counts: list[float]) -> None:
        """Add ``times`` the expected uses of each piece in a word."""
        if word == END:
            counts[self.ends] += times
            return
        text = START + word.decode("utf-8", "replace")
        n = len(text)
        arcs = self.arcs(text)
        ahead = ahead_of(arcs, n)
        behind = [NEVER] * n + [0.0]
        whole = ahead[n]
        for at, end, weight, used in reversed(arcs):
            rest = weight + behind[end]
            share = times * exp(ahead[at] + rest - whole)
            if used.__class__ is int:
                counts[used] += share
            else:
                for piece in used:
                    counts[piece] += share
            so_far = behind[at]
            if so_far == NEVER:
                behind[at] = rest
            elif rest > so_far:
                behind[at] = rest + log1p(exp(so_far - rest))
            else:
                behind[at] = so_far + log1p(exp(rest - so_far))


def ahead_of(arcs: list, n: int) -> list[float]:
    """Log-space forward recursion: summed weight of all ways to each place."""
    ahead = [0.0] + [NEVER] * n
    for at, end, weight, _ in arcs:
        way, so_far = ahead[at] + weight, ahead[end]
        if so_far == NEVER:
            ahead[end] = way
        elif way > so_far:
            ahead[end] = way + log1p(exp(so_far - way))
        else:
            ahead[end] = so_far + log1p(exp(way - so_far))
    return ahead


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether the id's checksum leaves the remainder; not so without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def count_words(batches):
    """Task: distinct words with their training counts, by blocks; ends count as the empty word."""
    for block, texts in blocks(batches, "text", COUNTED_BYTES):
        trained: Counter = Counter()
        seen: set[bytes] = {END}
        for text, out in zip(texts, block.column(block.schema.get_field_index("held_out")).to_pylist()):
            words = text.lower().split()
            if out:
                seen.update(words)
            else:
                trained.update(words)
                trained[END] += 1
        words = list(trained) + [word for word in seen if word not in trained]
        counts = list(trained.values()) + [0] * (len(words) - len(trained))
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(counts, pa.int64())], ["word", "count"])


def block_rows(batches):
    """Task: the distinct rows of a block, with how often each occurs."""
    for block, texts in blocks(batches, "text"):
        ids, out, source = (block.column(k).to_pylist() for k in (0, 1, 3))
        held = Counter(zip(ids, out, source, texts))
        columns = list(zip(*held)) or [()] * 4
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(columns[0], pa.int64()),
                pa.array(columns[1], pa.bool_()),
                pa.array(columns[3], pa.binary()).cast(pa.string()),
                pa.array(columns[2], pa.int64()),
                pa.array(list(held.values()), pa.int64()),
            ],
            ["doc_id", "held_out", "text", "source", "times"],
        )


def split_lower(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased words of all texts in order, by Arrow, and how many each text has."""
    listed = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = listed.values.slice(listed.offsets[0].as_py(), listed.offsets[-1].as_py() - listed.offsets[0].as_py())
    # White space at an end of a text leaves an empty string there.
    real = pc.not_equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    bounds = listed.offsets.to_numpy().astype(np.int64)
    each = np.diff(np.concatenate([[0], np.cumsum(real)])[bounds - bounds[0]])
    return words.filter(pa.array(real)).cast(pa.binary()), each


def words_of_source(table: pa.Table) -> pa.Table:
    """Distinct words of one source, the end among them."""
    words = [pa.array([END], pa.binary())]
    for block, _ in blocks(iter(table.to_batches()), "text"):
        words.append(split_lower(block.column("text"))[0].unique())
    found = pa.concat_arrays(words).unique()
    source = table.column("source")[0].as_py()
    return pa.table({"source": pa.array([source] * len(found), pa.int64()), "word": found})


def lattice_scores(
    docs: DataFrame,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    modulus: int = 7,
    remainder: int = 2,
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row; log10 scores."""
    id_ = F.col(id_col).cast("long")
    sources = max(1, -(-total_bytes(docs, text_col) // SOURCE_BYTES))
    texts = docs.select(
        id_.alias("doc_id"),
        held_out(id_, modulus, remainder).alias("held_out"),
        F.col(text_col).alias("text"),
        F.pmod(F.xxhash64(id_, F.col(text_col)), F.lit(sources)).alias("source"),
    )
    counted = texts.select("held_out", "text").mapInArrow(count_words, "word binary, count long")
    words = durable(counted.groupBy("word").agg(F.sum("count").alias("count")))
    total, distinct = words.agg(F.sum("count"), F.count_if(F.col("count") > 0)).first()
    total, base_below = total or 0, math.log10((total or 0) + distinct + 1)

    start = first_weights(vocabulary)

    def expectations(batches):
        lattice, counts = Lattice(vocabulary, start), [0.0] * len(start)
        for batch in batches:
            for word, times in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lattice.expect(word, times, counts)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(np.array(counts)[used])], ["piece", "uses"])

    uses = (
        words.filter("count > 0")
        .mapInArrow(expectations, "piece long, uses double")
        .groupBy("piece")
        .agg(F.sum("uses").alias("uses"))
        .collect()
    )
    counts = SMOOTHING * len(start) * np.exp(start)
    for row in uses:
        counts[row["piece"]] += row["uses"]
    weights = np.log(counts / counts.sum())

    def marginals(batches):
        lattice = Lattice(vocabulary, weights)
        for batch in batches:
            logs = [lattice.forward(word) / math.log(10) for word in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(logs, pa.float64())], ["word", "count", "log10"])

    scored = words.mapInArrow(marginals, "word binary, count long, log10 double")
    # Both sides of the last step read the same exchange of texts.
    grouped = texts.mapInArrow(block_rows, "doc_id long, held_out boolean, text string, source long, times long")
    in_source = grouped.groupBy("source").applyInArrow(words_of_source, "source long, word binary")
    of_source = in_source.join(scored, "word")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        words = right.column("word").combine_chunks()
        end = pc.index_in(pa.array([END], pa.binary()), words)[0].as_py()
        seen = right.column("count").to_numpy()
        base, logs = np.log10(seen + 1.0) - base_below, right.column("log10").to_numpy()
        known = (seen > 0).astype(np.int64)
        parts: list[tuple[np.ndarray, ...]] = []
        for block, _ in blocks(iter(left.to_batches()), "text", COUNTED_BYTES):
            listed, each = split_lower(block.column("text"))
            # Each distinct word of the block is looked up once.
            coded = listed.dictionary_encode()
            at = pc.index_in(coded.dictionary, words).to_numpy(zero_copy_only=False)[coded.indices.to_numpy()]
            parts.append(
                (each + 1, per_text(known[at], each) + known[end], *(per_sum(v[at], each) + v[end] for v in (base, logs)))
            )
        n, n_known, base_score, score_ = (np.concatenate(column) for column in zip(*parts))
        return pa.table(
            {
                "doc_id": left.column("doc_id"),
                "times": left.column("times"),
                "held_out": left.column("held_out"),
                "n_tokens": n,
                "n_known": n_known,
                "train_tokens": pa.array([total] * len(n), pa.int64()),
                "base_score": base_score,
                "score": score_,
            }
        )

    found = (
        grouped.groupBy("source")
        .cogroup(of_source.groupBy("source"))
        .applyInArrow(
            score,
            "doc_id long, times long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
            "base_score double, score double",
        )
    )
    once = found.filter("times = 1")
    again = found.filter("times > 1").withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return once.unionAll(again).drop("times")


def per_sum(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of each text's values, added up text by text so that long blocks lose no precision."""
    starts = np.cumsum(counts) - counts
    return np.array([values[a : a + n].sum() for a, n in zip(starts.tolist(), counts.tolist())])
