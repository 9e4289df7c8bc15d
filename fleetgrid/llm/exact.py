"""Exact dedup by an exchange of Golomb-coded fingerprints.

Every task cuts the SHA-256 of its normalised texts to fingerprints just long enough that few meet
by chance, sorts them and sends each owner, which holds a range of values, its part as a Golomb code
of the gaps: about ten bits a text. Owners answer with a bitmap per list: set where another task
sent the same value. Applied to the lists, the bitmaps and those of the values that a task met twice itself
give the fingerprints of the suspects. Only the texts of suspects are shuffled, and there grouped and joined
by their bytes, so a chance meeting ends as two groups.

A task sends each fingerprint once, and a block of documents each of its suspects once, whatever the
number of copies; a text that a third of all rows share costs a row a block. The suspects' fingerprints
are broadcast if they are at most ``BROADCAST_ROWS``. Beyond that only those that many lists hold are, which are
fewer than that many by their number of holders, and the rest meet the texts in a shuffled join.

Defined results: a null text is empty; rows without an id come after all others, and a group
without any id has a null ``keep_id``; exactly one row of a group stays, also where rows repeat an id;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgrid import session
from fleetgrid.llm.blocks import blocks
from fleetgrid.session import durable

BLANK = b" \t\n\r\x0b\x0c"

# Fingerprints are so much wider than the number of texts that one in 2 ** SPARE meets another by chance.
SPARE = 8

# Fingerprints that an owner holds on average at most, and that a task collects before it sends them.
OWNER_PRINTS = 2_000_000
LIST_PRINTS = 1_000_000
LEAST_OWNERS = 64


def normalised(text: bytes) -> bytes:
    """The text with every stretch of white space as one space."""
    joined = b" ".join(text.split())
    if not joined:
        return b" " if text else b""
    return b" " * (text[0] in BLANK) + joined + b" " * (text[-1] in BLANK)


def golomb_encoded(values: np.ndarray, base: int) -> bytes:
    """Sorted distinct integers from ``base`` on, as a Golomb code of their gaps.

    The divisor is the power of two next to ln 2 times the mean gap. The unary quotients of all gaps come
    first, then the remainders, so that both can be read at once.
    """
    gaps = np.diff(np.concatenate([[np.uint64(base)], values.astype(np.uint64)]))
    gaps[1:] -= np.uint64(1)
    mean = (int(values[-1]) - base) / len(values)
    low = max(int(np.log2(max(mean * np.log(2), 1))), 0)
    quotient = (gaps >> np.uint64(low)).astype(np.int64)
    unary = np.zeros(int(quotient.sum()) + len(gaps), np.uint8)
    unary[np.cumsum(quotient + 1) - 1] = 1
    rest = ((gaps[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    head = np.array([len(values), len(unary)], "<u4").tobytes() + bytes([low])
    return head + np.packbits(unary).tobytes() + np.packbits(rest).tobytes()


def golomb_decoded(code: bytes, base: int) -> np.ndarray:
    """The integers that ``golomb_encoded`` got."""
    count, length = np.frombuffer(code, "<u4", 2).tolist()
    low, bits = code[8], np.frombuffer(code, np.uint8, offset=9)
    ends = np.flatnonzero(np.unpackbits(bits[: -(-length // 8)], count=length))
    quotient = np.diff(np.concatenate([[-1], ends])) - 1
    rest = np.unpackbits(bits[-(-length // 8) :], count=count * low).reshape(count, low).astype(np.uint64)
    gaps = quotient.astype(np.uint64) << np.uint64(low)
    gaps += (rest << np.arange(low, dtype=np.uint64)).sum(1, dtype=np.uint64)
    gaps[1:] += np.uint64(1)
    return np.cumsum(gaps, dtype=np.uint64) + np.uint64(base)


def prints_of(digests: list[bytes], bits: int) -> np.ndarray:
    """The first ``bits`` bits of each digest."""
    heads = np.frombuffer(b"".join(d[:8] for d in digests), ">u8").astype(np.uint64)
    return heads >> np.uint64(64 - bits)


def bounds(owners: int, bits: int) -> list[int]:
    """First value of every owner."""
    return [-(-(number << bits) // owners) for number in range(owners)]


def send_prints(owners: int, bits: int):
    """Task: per owner the coded fingerprints of its texts."""

    def work(batches):
        context = TaskContext.get()
        lists, held, base = 0, [], bounds(owners, bits)

        def sent():
            values, times = np.unique(np.concatenate(held), return_counts=True)
            twice = times > 1
            cuts = np.searchsorted(values, np.array([*base, 1 << bits], np.uint64)).tolist()
            rows = [
                (o, golomb_encoded(values[a:b], base[o]), np.packbits(twice[a:b]).tobytes() if twice[a:b].any() else None)
                for o, (a, b) in enumerate(zip(cuts, cuts[1:]))
                if a < b
            ]
            sender = (context.partitionId() if context else 0) << 32 | lists
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([sender] * len(rows), pa.int64()),
                    pa.array([r[0] for r in rows], pa.int32()),
                    pa.array([r[1] for r in rows], pa.binary()),
                    pa.array([r[2] for r in rows], pa.binary()),
                ],
                ["sender", "owner", "code", "twice"],
            )

        for _, texts in blocks(batches, "text"):
            held.append(prints_of([hashlib.sha256(normalised(text)).digest() for text in texts], bits))
            if sum(map(len, held)) >= LIST_PRINTS:
                yield sent()
                lists, held = lists + 1, []
        if held:
            yield sent()

    return work


def answer_bitmaps(owners: int, bits: int):
    """Group: for the lists of one owner, bitmaps of the values that another list holds too."""

    def run(table: pa.Table) -> pa.Table:
        base = bounds(owners, bits)
        owner = table.column("owner")[0].as_py()
        lists = [golomb_decoded(code.as_py(), base[owner]) for code in table.column("code")]
        values, found, times = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        several = times[found] > 1
        ends = np.cumsum([len(x) for x in lists])
        maps = [np.packbits(part).tobytes() for part in np.split(several, ends[:-1])]
        some = [bool(m.strip(b"\0")) for m in maps]
        return pa.table(
            {
                "sender": table.column("sender").filter(pa.array(some)),
                "owner": table.column("owner").filter(pa.array(some)),
                "bitmap": pa.array([m for m, s in zip(maps, some) if s], pa.binary()),
            }
        )

    return run


def suspect_prints(owners: int, bits: int):
    """Task: the fingerprints of a list that one of its bitmaps marks."""

    def work(batches):
        base = bounds(owners, bits)
        for batch in batches:
            for owner, code, *bitmaps in zip(*(batch.column(k).to_pylist() for k in range(4))):
                values = golomb_decoded(code, base[owner])
                marked = np.zeros(len(values), bool)
                for bitmap in bitmaps:
                    if bitmap:
                        marked |= np.unpackbits(np.frombuffer(bitmap, np.uint8), count=len(values)).astype(bool)
                yield pa.RecordBatch.from_arrays([pa.array(values[marked].view(np.int64))], ["print"])

    return work


def block_texts(bits: int):
    """Task: each distinct text of a block with its fingerprint, digest and sorted document ids."""

    def work(batches):
        context = TaskContext.get()
        tag = (context.partitionId() if context else 0) << 32
        for block, texts in blocks(batches, "text"):
            held: dict[bytes, list] = {}
            for doc, text in zip(block.column(0).to_pylist(), texts):
                held.setdefault(normalised(text), []).append(doc)
            digests = [hashlib.sha256(text).digest() for text in held]
            docs = [sorted(ids, key=lambda doc: (doc is None, doc)) for ids in held.values()]
            columns = [
                pa.array(prints_of(digests, bits).view(np.int64)),
                pa.array(digests, pa.binary()),
                pa.array(list(held), pa.binary()),
                pa.array(docs, pa.list_(pa.int64())),
                pa.array(np.arange(tag, tag + len(held))),
            ]
            tag += len(held)
            yield pa.RecordBatch.from_arrays(columns, ["print", "digest", "text", "ids", "tag"])

    return work


def suspects(docs: DataFrame, bits: int, owners: int) -> DataFrame:
    """(print, lists): fingerprints that more than one row has, and by how many lists."""
    sent = durable(docs.select("text").mapInArrow(send_prints(owners, bits), "sender long, owner int, code binary, twice binary"))
    answers = sent.select("sender", "owner", "code").groupBy("owner").applyInArrow(answer_bitmaps(owners, bits), "sender long, owner int, bitmap binary")
    marked = sent.join(answers, ["sender", "owner"], "left").filter("bitmap IS NOT NULL OR twice IS NOT NULL")
    marked = marked.select("owner", "code", "bitmap", "twice")
    prints = marked.mapInArrow(suspect_prints(owners, bits), "print long")
    return durable(prints.groupBy("print").agg(F.count("*").alias("lists")))


def with_suspects(texts: DataFrame, found: DataFrame) -> DataFrame:
    """``texts`` with ``suspect``; the fingerprints are broadcast as far as their number allows."""
    count, lists = found.agg(F.count("*"), F.sum("lists")).first()
    most = session.BROADCAST_ROWS
    found = found.withColumn("suspect", F.lit(True))
    if count <= most:
        return texts.join(F.broadcast(found.drop("lists")), "print", "left")
    # Fewer than ``most`` fingerprints are in more than lists / most lists.
    frequent = F.col("lists") > -(-lists // most)
    held = texts.join(F.broadcast(found.filter(frequent).drop("lists")), "print", "left")
    others = found.filter(~frequent).select("print", F.col("suspect").alias("rare"))
    held = held.join(others, "print", "left")
    return held.withColumn("suspect", F.coalesce("suspect", "rare")).drop("rare")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spare: int = SPARE) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) per row of ``docs``.

    With a smaller ``spare`` shorter fingerprints are exchanged, and more texts meet by chance.
    """
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    total = read.count()
    bits = min(max(total.bit_length() + spare, 1), 63)
    owners = max(LEAST_OWNERS, -(-total // OWNER_PRINTS))
    found = suspects(read, bits, owners)
    texts = read.mapInArrow(block_texts(bits), "print long, digest binary, text binary, ids array<bigint>, tag long")
    texts = with_suspects(texts, found)
    held = durable(texts.select("digest", F.when(F.col("suspect"), F.col("text")).alias("text"), "ids", "tag"))

    alone = held.filter("text IS NULL").select(
        "digest", "ids", F.col("ids")[0].alias("keep_id"), F.size("ids").cast("long").alias("group_size"), F.lit(True).alias("first")
    )
    shared = held.filter("text IS NOT NULL")
    least = F.struct(F.col("ids")[0].isNull().alias("missing"), F.col("ids")[0].alias("doc_id"), F.col("tag").alias("tag"))
    groups = shared.groupBy("digest", "text").agg(F.min(least).alias("least"), F.sum(F.size("ids")).alias("group_size"))
    # The digest only spreads and orders the rows; equality is that of the texts.
    shared = shared.join(groups, ["digest", "text"]).select(
        "digest", "ids", F.col("least.doc_id").alias("keep_id"), "group_size", (F.col("tag") == F.col("least.tag")).alias("first")
    )
    rows = alone.unionAll(shared).select("*", F.posexplode("ids").alias("place", "doc_id"))
    kept = (F.col("first") & (F.col("place") == 0)).alias("kept")
    return rows.select("doc_id", "keep_id", "group_size", kept, F.lower(F.hex("digest")).alias("text_sha256"))


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; rows that repeat one (id, text) stay once."""
    stays = exact_groups(docs, id_col, text_col).filter("kept").select(
        F.struct("doc_id", "text_sha256").alias("_stays")
    )
    digest = F.sha2(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), "[\\x20\\x09-\\x0D]+", " "), 256)
    marked = docs.withColumn("_row", F.struct(F.col(id_col).cast("long").alias("doc_id"), digest.alias("text_sha256")))
    once = marked.dropDuplicates(["_row"])
    same = F.col("_row.doc_id").eqNullSafe(F.col("_stays.doc_id")) & (F.col("_row.text_sha256") == F.col("_stays.text_sha256"))
    return once.join(stays, same, "left_semi").drop("_row")
