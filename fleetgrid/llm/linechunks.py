"""Line dedup on content-defined chunks of lines.

A text is cut at every line feed into lines. A rolling hash over the last three line hashes sets a
boundary after about one line in four, wherever in a text those lines stand; a stretch without a
boundary is cut every 32 lines. Of the chunks with two or more lines that occur more than once
among all documents, byte for byte, the first occurrence (smallest id, then position) stays and the
others go. One-line chunks always stay.

Boundaries cut most passages that a text shares only in part with others. With ``passages`` the units
are these chunks and also, from every line that has words and up to every such line, the fewest lines
that hold more than 50 words, one line if it is long enough. Any passage of whole lines with more than
50 words consists of such units wherever it stands, so its later occurrences go whole, but for blank
lines at their ends. A unit that overlaps its own first occurrence stays.

Defined results: a null text has no lines and stays null; an empty text has one empty line; rows
that repeat one (id, text) are one document and treated alike; rows without an id come after all
others. A text whose every line went is an empty text with ``n_kept_lines`` 0.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgrid.llm.blocks import blocks
from fleetgrid.session import durable

DIVISOR = 4
MOST_LINES = 32
LAST_ID = (1 << 63) - 1

# Words that a passage must exceed. Words are what white space parts.
PASSAGE_WORDS = 50


def line_hash(line: bytes) -> int:
    return int.from_bytes(hashlib.md5(line).digest()[:4], "big")


def chunks(text: bytes) -> list[tuple[int, int]]:
    """(first line, line after the last) of every chunk of the text."""
    found, start, one, two = [], 0, 0, 0
    lines = text.split(b"\n")
    for at, line in enumerate(lines, 1):
        here = line_hash(line)
        rolled = here + 31 * one + 961 * two
        if rolled // 65536 % DIVISOR == 0 or at - start == MOST_LINES or at == len(lines):
            found.append((start, at))
            start = at
        one, two = here, one
    return found


def units(text: bytes) -> list[tuple[int, int]]:
    """Chunks of two or more lines, and from and up to every line with words the fewest with over 50."""
    found = {(start, end) for start, end in chunks(text) if end - start > 1}
    counts = [(at, len(line.split())) for at, line in enumerate(text.split(b"\n"))]
    counts = [(at, words) for at, words in counts if words]
    first, held = 0, 0
    for end, words in counts:
        held += words
        while held > PASSAGE_WORDS:
            found.add((counts[first][0], end + 1))
            held -= counts[first][1]
            first += 1
        if first:
            found.add((counts[first - 1][0], end + 1))
    return sorted(found)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Document keys that are never null, and the text."""
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("at"),
        F.xxhash64(text_col).alias("mark"),
        F.col(text_col).alias("text"),
    )


def chunk_hashes(passages: bool):
    """Task: (document, unit number, hash) of the units that may go; without ``passages`` they are chunks."""

    def work(batches):
        for block, texts in blocks(batches, "text"):
            ids, marks = block.column(0).to_pylist(), block.column(1).to_pylist()
            rows: list[tuple] = []
            for i, text in enumerate(texts):
                lines = text.split(b"\n")
                for number, (start, end) in enumerate(units(text) if passages else chunks(text)):
                    if passages or end - start > 1:
                        value = xxhash.xxh64_intdigest(b"\n".join(lines[start:end])) - (1 << 63)
                        rows.append((ids[i], marks[i], number, value))
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int64()))],
                ["at", "mark", "number", "hash"],
            )

    return work


def chunk_texts(passages: bool):
    """Task: (document, unit number, its lines, bytes) of the units a document is asked for.

    Units of passages overlap, so a SHA-256 digest stands for their bytes.
    """

    def work(batches):
        for block, texts in blocks(batches, "text"):
            ids, marks, asked = (block.column(k).to_pylist() for k in (0, 1, 3))
            rows: list[tuple] = []
            for i, text in enumerate(texts):
                lines, cut = text.split(b"\n"), units(text) if passages else chunks(text)
                for number in sorted(set(asked[i])):
                    start, end = cut[number]
                    chunk = b"\n".join(lines[start:end])
                    rows.append((ids[i], marks[i], number, start, end, hashlib.sha256(chunk).digest() if passages else chunk))
            columns = list(zip(*rows)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)], ["at", "mark", "number", "start", "end", "chunk"]
            )

    return work


def repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", passages: bool = False) -> DataFrame:
    """(at, mark, numbers): per document the chunks, or with ``passages`` the units, to remove.

    Hashes choose candidates; their bytes are then grouped, so two chunks that only share a hash
    stay. Both groupings combine before the shuffle.
    """
    texts = keyed(docs, id_col, text_col).filter(F.col("text").isNotNull())
    hashes = texts.mapInArrow(chunk_hashes(passages), "at long, mark long, number int, hash long").distinct()
    hashes = durable(hashes)
    often = hashes.groupBy("hash").agg(F.count("*").alias("times")).filter("times > 1").select("hash")
    asked = hashes.join(often, "hash").groupBy("at", "mark").agg(F.collect_list("number").alias("numbers"))
    held = texts.dropDuplicates(["at", "mark"]).join(asked, ["at", "mark"])
    found = durable(
        held.select("at", "mark", "text", "numbers").mapInArrow(
            chunk_texts(passages), "at long, mark long, number int, start int, end int, chunk binary"
        )
    )
    # Units are numbered by their first lines; equal ones have equally many lines.
    place = F.struct("at", "mark", "number", "end")
    first = found.groupBy("chunk").agg(F.min(place).alias("first"), F.count("*").alias("times"))
    elsewhere = (F.col("at") != F.col("first.at")) | (F.col("mark") != F.col("first.mark"))
    gone = found.join(first.filter("times > 1"), "chunk").filter(elsewhere | (F.col("start") >= F.col("first.end")))
    return gone.groupBy("at", "mark").agg(F.collect_list("number").alias("numbers"))


def remove_repeated_chunks(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", passages: bool = False
) -> DataFrame:
    """``docs`` with the kept text, and ``n_lines, n_kept_lines, n_chunks, n_removed_chunks``.

    With ``passages`` repeated passages of over 50 words go too, and a chunk counts as removed if all its lines went.
    Columns of ``docs`` with one of these four names are replaced.
    """
    counts = ["n_lines", "n_kept_lines", "n_chunks", "n_removed_chunks"]
    kept = [name for name in docs.columns if name not in counts]
    others = [name for name in kept if name != text_col]
    gone = repeated_chunks(docs, id_col, text_col, passages)
    marked = docs.select(
        F.struct(*[F.col(f"`{name}`") for name in others]).alias("row") if others else F.lit(0).alias("row"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("at"),
        F.xxhash64(text_col).alias("mark"),
        F.col(text_col).alias("text"),
    )
    joined = marked.join(gone, ["at", "mark"], "left").select("row", "text", "numbers")

    def work(batches):
        for block, texts in blocks(batches, "text"):
            missing, numbers = block.column(1).is_null().to_pylist(), block.column(2).to_pylist()
            out: list[tuple] = []
            for i, text in enumerate(texts):
                if missing[i]:
                    out.append((None, 0, 0, 0, 0))
                    continue
                lines, cut = text.split(b"\n"), chunks(text)
                listed = units(text) if passages else cut
                stays = bytearray(b"\1") * len(lines)
                for number in numbers[i] or ():
                    start, end = listed[number]
                    stays[start:end] = bytes(end - start)
                left = [line for line, stay in zip(lines, stays) if stay]
                removed = sum(not any(stays[a:b]) for a, b in cut)
                out.append((b"\n".join(left), len(lines), len(left), len(cut), removed))
            new, *measures = zip(*out)
            arrays = [pa.array(new, pa.binary()).cast(pa.string()), *(pa.array(m, pa.int64()) for m in measures)]
            yield pa.RecordBatch.from_arrays([block.column(0), *arrays], ["row", "text", *counts])

    schema = joined.select("row", "text").schema
    for name in counts:
        schema = schema.add(name, "long")
    done = joined.mapInArrow(work, schema)
    columns = [
        F.col("text").alias(name) if name == text_col else F.col("row")[name].alias(name) for name in kept
    ]
    return done.select(*columns, *counts)
