"""WARC archives: revisit resolution and deduplicated archives.

Archives are written and read by Spark's text source, so they may lie in any store that Spark
reaches: a record is a row, and the two empty lines that end it are the separator. Reading cuts at
the lines that start with the version; a payload that holds such a line itself leaves a record
shorter than its length field says, and the pieces of files where that happens are put together by a
prefix sum over their lengths.

Headers are grouped by payload digest and length: the record with the largest page id is the
response, the others become revisits of it. Fresh archives are written from the joined records.

Defined results: a null payload is empty; a null url is written as ``urn:page:<id>``; line ends in
a url are percent-encoded; equal payloads of rows with the same page id are all responses; a row
without a page id is a response only where no row with an id has its payload; an empty table gives
an empty archive.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetgrid.session import broadcast_if_small, durable

VERSION = "WARC/1.1"
CRLF = "\r\n"
BETWEEN = CRLF * 2

# No end of the mark is also its start, so marks never overlap; and it starts with a sign that the empty lines
# before it do not repeat side by side, since Spark's line reader can lose a record where a split ends among those.
MARK = "\n" + VERSION

# Fixed values of RFC 4648 and of the WARC revisit profile.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

FILE_RECORDS = 50_000

FIELDS = {
    "page_id": "X-Page-Id",
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "url": "WARC-Target-URI",
    "payload_digest": "WARC-Payload-Digest",
    "payload_bytes": "X-Payload-Length",
    "refers_to_record": "WARC-Refers-To",
    "content_length": "Content-Length",
}


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: twenty bits are five hex digits and four letters."""
    digest = F.sha1(payload)
    letters = []
    for group in range(8):
        bits = F.conv(F.substring(digest, 1 + 5 * group, 5), 16, 10).cast("int")
        for letter in range(4):
            place = F.shiftright(bits, 15 - 5 * letter).bitwiseAND(31) + 1
            letters.append(F.substring(F.lit(BASE32), place, F.lit(1)))
    return F.concat(*letters)


def record_id(page_id: Column, digest: Column) -> Column:
    """A name for a record, the same in every run."""
    h = F.md5(F.concat_ws(":", F.coalesce(page_id.cast("string"), F.lit("none")), digest))
    parts = [F.substring(h, start, size) for start, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One response record per page."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    url = F.coalesce(F.col(url_col), F.concat(F.lit("urn:page:"), F.coalesce(F.col(id_col).cast("string"), F.lit("none"))))
    url = F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), payload.alias("payload"))
    base = base.withColumn("payload_digest", base32_sha1(F.col("payload")))
    return base.select(
        "page_id",
        F.lit("response").alias("record_type"),
        record_id(F.col("page_id"), F.col("payload_digest")).alias("record_id"),
        "url",
        "payload_digest",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.lit(None).cast("string").alias("refers_to_record"),
        F.lit(None).cast("string").alias("refers_to_url"),
        "payload",
    )


def write_archive(records: DataFrame, path: str, date: str, compression: str = "gzip") -> None:
    """Records with fresh headers; a revisit holds the HTTP head alone. ``date`` is an ISO time in UTC.

    A file holds ``FILE_RECORDS`` records at most, so that no task reads a large file alone. Compression is the fastest
    level of gzip: an eighth more bytes for a quarter of the time.
    """
    revisit = F.col("record_type") == "revisit"
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload").cast("string"))
    block = F.concat(F.lit(HTTP_HEAD), body)

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF))

    lines = [
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        line("X-Payload-Length", F.col("payload_bytes")),
        line("X-Page-Id", F.col("page_id")),
        F.when(revisit, line("WARC-Profile", F.lit(PROFILE))),
        F.when(revisit, line("WARC-Refers-To", F.col("refers_to_record"))),
        F.when(revisit, line("WARC-Refers-To-Target-URI", F.col("refers_to_url"))),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length(block)),
    ]
    text = F.concat(F.lit(VERSION + CRLF), *(F.coalesce(part, F.lit("")) for part in lines), F.lit(CRLF), block)
    writer = records.select(text.alias("value")).write.option("lineSep", BETWEEN)
    writer = writer.option("maxRecordsPerFile", FILE_RECORDS).option("zlib.compress.level", "BEST_SPEED")
    writer.option("compression", compression).text(path)


def field(head: Column, name: str) -> Column:
    """Value of a header field; null without it."""
    value = F.split_part(F.concat(F.lit(CRLF), head), F.lit(f"{CRLF}{name}: "), F.lit(2))
    for end in CRLF:
        value = F.substring_index(value, end, 1)
    return F.nullif(value, F.lit(""))


def block_end(piece: Column) -> Column:
    """Bytes from the start of a piece to the end of its block, by the length field; null without one."""
    head = F.substring_index(piece, BETWEEN, 1)
    length = field(head, FIELDS["content_length"]).try_cast("int").cast("long")
    return F.octet_length(head) + len(BETWEEN) + length


def parsed(pieces: DataFrame) -> DataFrame:
    """Records of pieces (file, piece): fields, payload, and whether the piece holds the whole block.

    A piece starts behind the version; the first of a file starts with it.
    """
    cut = pieces.withColumn("head_text", F.substring_index(F.col("piece"), BETWEEN, 1)).withColumn("raw", F.col("piece").cast("binary"))
    cut = cut.withColumn("block_from", F.octet_length("head_text") + len(BETWEEN))
    fields = {name: field(F.col("head_text"), title) for name, title in FIELDS.items()}
    records = cut.select("file", "raw", "block_from", *(value.alias(name) for name, value in fields.items()))
    length = F.col("content_length").try_cast("int")
    head = len(HTTP_HEAD)
    return records.select(
        "file",
        F.col("page_id").cast("long").alias("page_id"),
        "record_type",
        "record_id",
        "url",
        F.replace("payload_digest", F.lit("sha1:"), F.lit("")).alias("payload_digest"),
        F.col("payload_bytes").cast("long").alias("payload_bytes"),
        "refers_to_record",
        F.substring("raw", F.col("block_from") + head + 1, length - head).alias("payload"),
        F.coalesce(F.octet_length("raw") >= F.col("block_from") + length.cast("long"), F.lit(False)).alias("complete"),
    )


def pieces_of(spark: SparkSession, path: str, *more: Column) -> DataFrame:
    """(file, ``more``, piece): the text of all archives in a folder, cut at every mark."""
    lines = spark.read.option("lineSep", MARK).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), *more, F.col("value").alias("piece"))


def record_starts(run: pd.DataFrame) -> pd.DataFrame:
    """Where the record of each piece starts; the pieces of a run may lie in one another's blocks."""
    run = run.sort_values("at")
    starts, end = [], -1
    for at, own_end in zip(run["at"], run["end"]):
        if at > end:
            start, end = at, own_end
        starts.append(start)
    return run.drop(columns=["run", "end"]).assign(start=starts)


def mended(pieces: DataFrame) -> DataFrame:
    """(file, piece) of pieces (file, block, place, piece) of which some are cut inside a block.

    A prefix sum over lengths places every piece in its file. A piece that starts beyond the ends that all
    earlier ones name starts a record; the pieces between two such places are a run, and only runs of several
    pieces are walked, by lengths alone. Payloads move where they are joined to one record, no others.
    """
    order = Window.partitionBy("file").orderBy("block", "place")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    size = F.octet_length("piece").cast("long")
    sized = pieces.select("file", "block", "place", size.alias("size"), F.greatest(size, block_end(F.col("piece"))).alias("reach"))
    placed = sized.withColumn("at", F.coalesce(F.sum(F.col("size") + len(MARK)).over(earlier), F.lit(0)))
    placed = placed.withColumn("end", F.col("at") + F.col("reach"))
    fresh = F.coalesce(F.col("at") > F.max("end").over(earlier), F.lit(True))
    runs = placed.withColumn("fresh", fresh.cast("long")).withColumn("run", F.sum("fresh").over(order))
    runs = runs.withColumn("pieces", F.count("*").over(Window.partitionBy("file", "run")))
    part = runs.filter("pieces > 1").select("file", "block", "place", "run", "at", "end")
    starts = "file string, block long, place long, at long, start long"
    known = durable(part.groupBy("file", "run").applyInPandas(record_starts, starts))
    known = broadcast_if_small(known)
    keys = ["file", "block", "place"]
    listed = F.array_sort(F.collect_list(F.struct("at", "piece")))
    text = F.array_join(F.transform(listed, lambda one: one["piece"]), MARK)
    joined = pieces.join(known, keys).groupBy("file", "start").agg(text.alias("piece"))
    return pieces.join(known, keys, "left_anti").select("file", "piece").union(joined.select("file", "piece"))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Records of all archives in a folder."""
    records = parsed(pieces_of(spark, path))
    torn = durable(records.filter("NOT complete").select("file").distinct())
    files = torn.count()
    if not files:
        return records.drop("complete", "file")
    torn = broadcast_if_small(torn, files)
    block = F.col("_metadata.file_block_start").alias("block")
    placed = pieces_of(spark, path, block, F.monotonically_increasing_id().alias("place"))
    # A checkpoint fixes the places, which the parts below must agree on.
    again = parsed(mended(durable(placed.join(torn, "file", "left_semi"))))
    return records.join(torn, "file", "left_anti").select(again.columns).union(again).drop("complete", "file")


def resolved(records: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Records with the verdict on each: headers meet by payload digest and length."""
    heads = records.select("payload_digest", "payload_bytes", "page_id", "record_id", "url")
    originals = (
        heads.filter(F.col("payload_bytes") >= least_bytes)
        .groupBy("payload_digest", "payload_bytes")
        .agg(
            F.count("*").alias("times"),
            F.max(F.struct("page_id", "record_id", "url")).alias("original"),
        )
        .filter("times > 1")
        .drop("times")
    )
    joined = records.drop("record_type", "refers_to_record").join(originals, ["payload_digest", "payload_bytes"], "left")
    is_revisit = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original.page_id"))
    return joined.select(
        "page_id",
        F.when(is_revisit, "revisit").otherwise("response").alias("record_type"),
        "record_id",
        "url",
        "payload_digest",
        "payload_bytes",
        F.when(is_revisit, F.col("original.record_id")).alias("refers_to_record"),
        F.when(is_revisit, F.col("original.url")).alias("refers_to_url"),
        "payload",
    )


def revisits(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): revisits joined to their responses.

    Length and digest are those of the response's payload as read, also for its revisits.
    """
    measured = records.filter("record_type = 'response'").select(
        "page_id",
        "record_id",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("payload_digest"),
    )
    originals = measured.groupBy(F.col("record_id").alias("refers_to_record")).agg(
        F.first("payload_bytes").alias("payload_bytes"), F.first("payload_digest").alias("payload_digest"), F.max("page_id").alias("refers_to")
    )
    again = records.filter("record_type = 'revisit'").select("page_id", "refers_to_record").join(originals, "refers_to_record", "left")
    response = measured.select(
        "page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to")
    )
    return response.union(
        again.select("page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), "refers_to")
    )


def deduplicate_archive(spark: SparkSession, source: str, target: str, date: str, least_bytes: int = 0) -> None:
    """Write the archives of one folder anew, repeated payloads as revisits."""
    write_archive(resolved(read_archive(spark, source), least_bytes), target, date)
