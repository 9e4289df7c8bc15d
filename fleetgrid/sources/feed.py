"""Vehicle feed payloads: landing as received, reading, parsing, and the feed cursor.

A payload is one JSON document with ``vehicle`` and ``lastTime.time``. What cannot be read as one, be it
cut off or without a time, is kept as it is and marked ``malformed``; no reader drops it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetgrid.operators.typing import epoch_millis
from fleetgrid.schema import LANDED, PAYLOAD, POSITIONS

# File a payload came from, and its place there; they tell payloads with equal times apart.
SOURCE = "source_file"
PLACE = "source_place"

PAYLOAD_COLUMNS = ["value", "fetched_at", SOURCE, PLACE, "vehicle", "lastTime", "malformed"]

# Bytes of text up to which lines are put together to one document.
DOCUMENT_BYTES = 256_000_000

# Byte range of a file, and order of a line among those that one task reads.
_SPLIT, _AT = "_split", "_at"

# A string of JSON, or one that its line cuts off.
_STRING = r'"(?:[^"\\]|\\.)*(?:"|\\?$)'

_CORRUPT = "_corrupt"
_READ = T.StructType([*PAYLOAD.fields, T.StructField(_CORRUPT, T.StringType())])


def land_payloads(payloads: DataFrame, path: str) -> None:
    """Keep payload text as received, with its fetch time and place, one folder per fetch date.

    Payloads have ``value, fetched_at`` and may have ``sequence``, their order of arrival.
    """
    sequence = F.col("sequence") if "sequence" in payloads.columns else F.monotonically_increasing_id()
    landed = payloads.select(
        "value", "fetched_at", sequence.cast("long").alias("sequence"), F.to_date("fetched_at").alias("fetch_date")
    )
    landed.write.mode("append").partitionBy("fetch_date").parquet(path)


def read_payloads(spark: SparkSession, path: str, landed: bool = False) -> DataFrame:
    """One row per payload of a folder of feed files, or of a ``landed`` table.

    A feed file holds documents, indented or not, or one per line; its fetch time is the file's own. The lines
    are looked through once to see whether there are files with documents over several lines.
    """
    if landed:
        return payloads_from_text(_landed_rows(spark.read.schema(LANDED).parquet(path)))
    parsed = parsed_lines(_line_rows(spark.read.text(path, recursiveFileLookup=True)))
    return payloads_of_lines(parsed, has_whole_documents(parsed))


def stream_rows(spark: SparkSession, path: str, landed: bool = False, max_files: int | None = None) -> DataFrame:
    """The lines of feed files, or the landed rows, as a stream; the read position lives in the query's checkpoint.

    A micro-batch holds whole files, so ``parsed_lines`` and ``payloads_of_lines`` apply to it.
    """
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if landed:
        return _landed_rows(reader.schema(LANDED).parquet(path))
    return _line_rows(reader.text(path, recursiveFileLookup=True))


def _landed_rows(rows: DataFrame) -> DataFrame:
    return rows.select("value", "fetched_at", F.col("_metadata.file_path").alias(SOURCE), F.col("sequence").alias(PLACE))


def _line_rows(lines: DataFrame) -> DataFrame:
    """Lines with the byte range of the file that they were read from: Spark splits large files."""
    return lines.select(
        "value",
        F.col("_metadata.file_modification_time").alias("fetched_at"),
        F.col("_metadata.file_path").alias(SOURCE),
        F.col("_metadata.file_block_start").alias(_SPLIT),
    )


def parsed_lines(lines: DataFrame) -> DataFrame:
    """Every line that isn't blank as a payload of its own, with its order in its split."""
    numbered = lines.withColumn(_AT, F.monotonically_increasing_id()).filter(F.trim("value") != "")
    return payloads_from_text(numbered)


def splits_of(parsed: DataFrame) -> DataFrame:
    """(file, split, its first line, whether the file is one of lines), one row per split.

    It is if any line of it is a payload by itself, wherever that stands.
    """
    splits = parsed.groupBy(SOURCE, _SPLIT).agg(F.min(_AT).alias("_first"), F.bool_or(~F.col("malformed")).alias("_good"))
    return splits.select(SOURCE, _SPLIT, "_first", F.bool_or("_good").over(Window.partitionBy(SOURCE)).alias("_by_line"))


def has_whole_documents(parsed: DataFrame) -> bool:
    """Whether a file has no line that is a payload by itself."""
    files = parsed.groupBy(SOURCE).agg(F.bool_or(~F.col("malformed")).alias("_by_line"))
    return not files.filter("NOT _by_line").isEmpty()


def payloads_of_lines(parsed: DataFrame, whole: bool = True) -> DataFrame:
    """The payloads of files of lines, and with ``whole`` those of files whose documents go over several lines.

    In a file with any line that is a payload each line is judged by itself. In the others a document goes
    from a line outside all braces and brackets to the next one that ends so: the depth before a line comes from a
    prefix scan, first within splits, then over the splits of a file, so a file of any size is read
    by many tasks. Characters inside strings don't count; a string ends with its line at the latest. What is no payload
    then, but has several lines that begin an object without indent, falls into lines, as does all that is larger than
    ``DOCUMENT_BYTES``. Lines of one document are joined by a line feed.
    """
    placed = parsed.join(splits_of(parsed), [SOURCE, _SPLIT])
    # A line takes a byte at least, so places of different splits stay apart.
    placed = placed.withColumn(PLACE, (F.col(_SPLIT) + F.col(_AT) - F.col("_first")).cast("long"))
    by_line = placed.filter("_by_line").select(*PAYLOAD_COLUMNS)
    if not whole:
        return by_line
    lines = _document_numbers(placed.filter("NOT _by_line").select("value", "fetched_at", SOURCE, _SPLIT, PLACE))
    sizes = lines.groupBy(SOURCE, "_document").agg(
        F.sum(F.octet_length("value") + 1).alias("_bytes"), F.count_if(F.col("value").startswith("{")).alias("_starts")
    )
    lines = lines.join(sizes, [SOURCE, "_document"])
    small = F.col("_bytes") <= DOCUMENT_BYTES
    texts = F.transform(F.array_sort(F.collect_list(F.struct(PLACE, "value"))), lambda line: line["value"])
    documents = lines.filter(small).groupBy(SOURCE, "_document").agg(
        F.max("fetched_at").alias("fetched_at"),
        F.min(PLACE).alias(PLACE),
        F.any_value("_starts").alias("_starts"),
        texts.alias("_lines"),
    )
    judged = payloads_from_text(documents.withColumn("value", F.array_join("_lines", "\n")))
    falls = F.col("malformed") & (F.col("_starts") > 1)
    apart = judged.filter(falls).select("fetched_at", SOURCE, F.col(PLACE).alias("_from"), F.posexplode("_lines").alias("_no", "value"))
    apart = apart.select("value", "fetched_at", SOURCE, (F.col("_from") + F.col("_no")).alias(PLACE))
    apart = apart.unionByName(lines.filter(~small).select("value", "fetched_at", SOURCE, PLACE))
    found = by_line.unionByName(judged.filter(~falls).select(*PAYLOAD_COLUMNS))
    return found.unionByName(payloads_from_text(apart).select(*PAYLOAD_COLUMNS))


def _document_numbers(lines: DataFrame) -> DataFrame:
    """Lines with the number of their document in the file, from the depth of braces and brackets."""
    bare = F.regexp_replace("value", _STRING, "")
    opened = F.length(bare) - F.length(F.translate(bare, "{[", ""))
    closed = F.length(bare) - F.length(F.translate(bare, "}]", ""))
    within = Window.partitionBy(SOURCE, _SPLIT).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(SOURCE).orderBy(_SPLIT).rowsBetween(Window.unboundedPreceding, -1)

    def scanned(rows: DataFrame, value: str, name: str) -> DataFrame:
        """``name``: the sum of ``value`` up to and with each line of the file."""
        totals = rows.groupBy(SOURCE, _SPLIT).agg(F.sum(value).alias("_held"))
        before = totals.select(SOURCE, _SPLIT, F.coalesce(F.sum("_held").over(earlier), F.lit(0)).alias("_before"))
        summed = rows.withColumn("_sum", F.sum(value).over(within))
        return summed.join(before, [SOURCE, _SPLIT]).withColumn(name, F.col("_sum") + F.col("_before")).drop("_sum", "_before")

    deep = scanned(lines.withColumn("_change", opened - closed), "_change", "_depth")
    starts = ((F.col("_depth") - F.col("_change")) <= 0).cast("int")
    return scanned(deep.withColumn("_starts_one", starts), "_starts_one", "_document")


def payloads_from_text(df: DataFrame, text: str = "value") -> DataFrame:
    """Payload JSON held in a column, parsed beside it, with ``malformed``; other columns stay."""
    parsed = F.from_json(text, _READ, {"columnNameOfCorruptRecord": _CORRUPT})
    rows = df.withColumn("_parsed", parsed)
    time = F.col("_parsed.lastTime.time").try_cast("bigint")
    bad = F.col("_parsed").isNull() | F.col(f"_parsed.{_CORRUPT}").isNotNull() | time.isNull()
    return rows.select(
        *df.columns,
        F.when(~bad, F.col("_parsed.vehicle")).alias("vehicle"),
        F.when(~bad, F.col("_parsed.lastTime")).alias("lastTime"),
        bad.alias("malformed"),
    )


def parse_payloads(payloads: DataFrame) -> DataFrame:
    """One row per reported vehicle, with the payload's time as ``api_timestamp``.

    A payload without vehicles gives no row, nor does a malformed one, for which see ``rejected``; a
    vehicle without some field gets null there.
    """
    left_out = ("value", "vehicle", "lastTime", "malformed")
    kept = [c for c in payloads.columns if c not in left_out]
    rows = payloads.select(
        F.inline("vehicle"), epoch_millis(F.col("lastTime.time")).alias("api_timestamp"), *kept
    )
    first = [c for c in POSITIONS.names if c in rows.columns]
    return rows.select(*first, *[c for c in kept if c not in first])


def rejected(payloads: DataFrame) -> DataFrame:
    """Malformed payloads with their text and origin."""
    return payloads.filter("malformed").drop("vehicle", "lastTime", "malformed")


def next_cursor(texts: DataFrame, text: str = "value") -> DataFrame:
    """Cursor for the next request: the newest payload time as text, ``"0"`` before any payload.

    Only the time is parsed; the vehicles of a payload are passed over.
    """
    time = F.get_json_object(text, "$.lastTime.time").try_cast("bigint")
    return texts.agg(F.coalesce(F.max(time).cast("string"), F.lit("0")).alias("cursor"))


def payload_order() -> Column:
    """Sort key of payloads: the feed's own time, then the fetch time, file and place in it."""
    return F.struct("api_timestamp", "fetched_at", SOURCE, PLACE)
