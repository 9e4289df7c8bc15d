"""Token counts of documents in flat token files without an index.

A token file is nothing but 16-bit little-endian ids; an end id follows each document. Spark splits the
files by byte ranges, each task reads its ranges in blocks, and each block is searched for the end id as
one vector comparison. What a block can't know, its place in the file and the documents that ended or opened before
it, comes from prefix scans over the blocks: first within splits, then over the splits of a file, so
no task holds more than the summaries of one split or the splits of one file.

Defined results: an empty file has no documents; neighbouring end ids enclose an empty document;
ids after the last end are a document with ``ended`` false; an odd last byte is an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from fleetgrid.llm.blocks import blocks, split_words
from fleetgrid.llm.fertility import piece_codes
from fleetgrid.session import durable

BLOCK_TOKENS = 65_536
END_ID = 2

# Documents of one file that ``write_token_files`` makes.
FILE_DOCUMENTS = 20_000


def write_token_files(docs: DataFrame, vocabulary: str, path: str, text_col: str = "text", end_id: int = END_ID) -> None:
    """Token files of all texts: pieces of a sentencepiece vocabulary, then the end id, per text.

    Spark's text writer puts the raw bytes of a row and then its separator, which here is the end id.
    """
    separator = end_id.to_bytes(2, "little").decode("ascii")

    def work(batches):
        codes, _ = piece_codes(vocabulary)
        with codes:
            for block, texts in blocks(batches, "text"):
                words, counts = split_words(texts)
                tokens, sizes = codes.tokens(codes.numbers(words))
                ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(counts)]
                flat = tokens.astype("<u2")
                rows = [flat[a:b].tobytes() for a, b in zip(np.concatenate([[0], ends[:-1]]), ends)]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["tokens"])

    coded = docs.select(F.col(text_col).alias("text")).mapInArrow(work, "tokens binary")
    coded.select(F.col("tokens").cast("string").alias("value")).write.option("lineSep", separator).option(
        "maxRecordsPerFile", FILE_DOCUMENTS
    ).text(path)


def separator_byte(end_id: int) -> int:
    """The byte at which Spark cuts token files into rows: one of the end id, so no row is longer than a document."""
    ascii_ = [byte for byte in reversed(end_id.to_bytes(2, "little")) if byte < 0x80]
    return ascii_[0] if ascii_ else 0


def scanned_blocks(spark: SparkSession, path: str, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, size, split, block, bytes, head, tail, even, odd) per block, found by the bytes of the end id.

    Spark's text source splits files by byte ranges and reads the rows of a range, here stretches between separator
    bytes, one after the other. Where a range really starts, and so whether ids stand at even or odd bytes
    of it, is known only when all before it are added up: places are noted for both cases. ``head`` and
    ``tail`` are the block's first and last byte.
    """
    separator = separator_byte(end_id)
    low, high = end_id.to_bytes(2, "little")

    def summary(data: bytes, file: str, size: int, split: int, number: int) -> tuple:
        found = np.frombuffer(data, np.uint8)
        at = np.flatnonzero((found[:-1] == low) & (found[1:] == high))
        return (file, size, split, number, len(data), data[0], data[-1], at[at % 2 == 0], at[at % 2 == 1])

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), *[pa.int64()] * 6, *[pa.list_(pa.int64())] * 2]
        columns = list(zip(*rows)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    def work(batches):
        width, glue = 2 * block_tokens, bytes([separator])
        here, number, held = None, 0, b""
        for batch in batches:
            splits = batch.column(2).to_numpy(zero_copy_only=False)
            files = batch.column(1).dictionary_encode().indices.to_numpy(zero_copy_only=False)
            other = np.flatnonzero((files[1:] != files[:-1]) | (splits[1:] != splits[:-1])) + 1
            rows = []
            for start, end in zip([0, *other], [*other, batch.num_rows]):
                file, split, size = (batch.column(k)[int(start)].as_py() for k in (1, 2, 3))
                if here != (file, size, split):
                    if held:
                        rows.append(summary(held, *here, number))
                    here, number, held = (file, size, split), 0, b""
                held += glue.join(batch.column(0).slice(start, end - start).to_pylist()) + glue
                whole = len(held) - len(held) % width
                for at in range(0, whole, width):
                    rows.append(summary(held[at : at + width], *here, number))
                    number += 1
                held = held[whole:]
            yield as_batch(rows)
        if held:
            yield as_batch([summary(held, *here, number)])

    place = F.col("_metadata")
    lines = spark.read.option("lineSep", chr(separator)).text(path).select(
        F.col("value").cast("binary"),
        place["file_path"].alias("file"),
        place["file_block_start"].alias("split"),
        place["file_size"].alias("size"),
    )
    schema = "file string, size long, split long, block long, bytes long, head long, tail long, even array<long>, odd array<long>"
    names = [part.split()[0] for part in schema.split(", ")]
    return lines.mapInArrow(work, schema)


EARLIER = (Window.unboundedPreceding, -1)


def inside() -> tuple[WindowSpec, WindowSpec]:
    """Windows over the earlier blocks of a split, and over the earlier splits of a file."""
    blocks_ = Window.partitionBy("file", "split").orderBy("block").rowsBetween(*EARLIER)
    return blocks_, Window.partitionBy("file").orderBy("split").rowsBetween(*EARLIER)


def aligned(found: DataFrame, end_id: int = END_ID) -> DataFrame:
    """(file, size, split, block, ends): the ids of the file that are the end id, from where each block starts.

    The prefix scan adds up bytes within splits, then over the splits. An end id that stands across
    two blocks belongs to the second.
    """
    low, high = end_id.to_bytes(2, "little")
    blocks_, splits = inside()
    of_split = found.groupBy("file", "split").agg(F.sum("bytes").alias("held"), F.max_by("tail", "block").alias("last"))
    before = of_split.select(
        "file", "split", F.sum("held").over(splits).alias("split_from"), F.last("last").over(splits).alias("split_tail")
    )
    scanned = found.withColumns({"block_from": F.sum("bytes").over(blocks_), "block_tail": F.last("tail").over(blocks_)})
    joined = scanned.join(before, ["file", "split"])
    start = (F.coalesce("split_from", F.lit(0)) + F.coalesce("block_from", F.lit(0))).alias("start")
    placed = joined.select("*", start, F.coalesce("block_tail", "split_tail").alias("previous"))
    odd = F.col("start") % 2 == 1
    across = F.when(
        odd & (F.col("previous") == low) & (F.col("head") == high), F.array(F.expr("start div 2"))
    ).otherwise(F.array().cast("array<bigint>"))
    own = F.transform(F.when(odd, F.col("odd")).otherwise(F.col("even")), lambda at: F.floor((F.col("start") + at) / 2))
    even_size = F.when(F.col("size") % 2 == 0, F.col("size")).otherwise(F.raise_error(F.concat(F.lit("half an id ends "), "file")).cast("long"))
    return placed.select("file", even_size.alias("size"), "split", "block", F.concat(across, own).alias("ends"))


def stitched(found: DataFrame) -> DataFrame:
    """Blocks with ``before`` (documents that ended earlier in the file) and ``open`` (start of the open one)."""
    blocks_, splits = inside()
    marked = found.withColumn("last", F.try_element_at("ends", F.lit(-1)) + 1)
    of_split = (
        marked.groupBy("file", "split")
        .agg(F.sum(F.size("ends")).alias("held"), F.max("last").alias("last"))
        .select("file", "split", F.sum("held").over(splits).alias("split_before"), F.max("last").over(splits).alias("split_open"))
    )
    scanned = marked.withColumns({"in_before": F.sum(F.size("ends")).over(blocks_), "in_open": F.max("last").over(blocks_)})
    return scanned.join(of_split, ["file", "split"]).select(
        "file",
        "size",
        "ends",
        (F.coalesce("split_before", F.lit(0)) + F.coalesce("in_before", F.lit(0))).alias("before"),
        F.coalesce("in_open", "split_open", F.lit(0)).alias("open"),
    )


def token_counts(spark: SparkSession, path: str, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, document, start, n_tokens, ended) of every document; the end id isn't counted."""
    found = stitched(aligned(durable(scanned_blocks(spark, path, end_id, block_tokens)), end_id))
    previous = F.concat(F.array("open"), F.transform("ends", lambda end: end + 1))
    closed = found.select("file", "before", F.posexplode(F.arrays_zip("ends", previous.alias("start")))).filter("col.ends IS NOT NULL")
    whole = closed.select(
        "file",
        (F.col("before") + F.col("pos")).alias("document"),
        F.col("col.start").alias("start"),
        (F.col("col.ends") - F.col("col.start")).alias("n_tokens"),
        F.lit(True).alias("ended"),
    )
    left = found.groupBy("file").agg(
        F.expr("max(size) div 2").alias("size"),
        F.max(F.col("before") + F.size("ends")).alias("document"),
        F.max(F.greatest("open", F.coalesce(F.array_max("ends") + 1, F.lit(0)))).alias("start"),
    )
    rest = left.filter("size > start").select(
        "file", "document", "start", (F.col("size") - F.col("start")).alias("n_tokens"), F.lit(False).alias("ended")
    )
    return whole.union(rest)
