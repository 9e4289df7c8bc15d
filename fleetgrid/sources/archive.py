"""Schedule archives: zip files of CSV members to tables.

An archive is unpacked once, to text files on the shared store, one folder per table, header and member. A
commit by Spark's writer makes the members of a task appear together, so a task that runs again
leaves no half member. The records in these files are parted by ``RECORD`` instead of line feeds, which may
stand inside quotes, so Spark's CSV reader splits large members and reads them in parallel.
"""

from __future__ import annotations

import csv
import hashlib
import io
import json
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetgrid.operators.typing import infer_types
from fleetgrid.schema import SCHEDULE_FILES
from fleetgrid.session import work_folder
from fleetgrid.sources.files import exists, replace_files

# Fixed value: prefix of the tables loaded from an archive.
TABLE_PREFIX = "ttc_"

# Ends a record in unpacked members: ASCII's record separator.
RECORD = b"\x1e"

# Bytes unpacked at a time, so that a member is never held whole, and bytes that one record may have.
BLOCK_BYTES = 1 << 20
RECORD_BYTES = 1 << 26

MEMBERS = "path string, member string, table_name string, columns array<string>, layout string, source string"
_ABOUT = "_members"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Archive files as ``path, content``.

    A zip archive cannot be split, so one task unpacks it; Spark limits a file to 2 GiB here. Many archives
    are many tasks.
    """
    return spark.read.format("binaryFile").load(path).select("path", "content")


def table_name(member: str, prefix: str = TABLE_PREFIX) -> str:
    """Table of a member: its file name without folders and endings."""
    return prefix + member.rsplit("/", 1)[-1].split(".")[0]


def record_pieces(member: io.BufferedIOBase) -> Iterator[bytes]:
    """The text of a CSV member in pieces of whole records, which ``RECORD`` parts; no byte order mark.

    A line feed ends a record unless it stands inside quotes, that is after an odd number of them.
    """
    held, quoted, start = b"", 0, True
    while block := member.read(BLOCK_BYTES):
        if RECORD in block:
            raise ValueError("a member holds the sign that parts records")
        block = block.removeprefix(b"\xef\xbb\xbf") if start else block
        start = False
        data = np.frombuffer(block, np.uint8).copy()
        quotes = np.cumsum(data == ord('"')) + quoted
        data[(data == ord("\n")) & (quotes % 2 == 0)] = RECORD[0]
        quoted = int(quotes[-1]) % 2 if len(quotes) else quoted
        held += data.tobytes()
        end = held.rfind(RECORD)
        if end >= 0:
            yield held[:end].replace(b"\r" + RECORD, RECORD).removesuffix(b"\r")
            held = held[end + 1 :]
        if len(held) > RECORD_BYTES:
            raise ValueError(f"a record of a member has more than {RECORD_BYTES} bytes")
    if held.strip():
        yield held.removesuffix(b"\r")


def column_names(piece: bytes) -> list[str]:
    """Names in the first record; a name that comes again gets its place, so that names are unique."""
    first = piece.split(RECORD, 1)[0].decode("utf-8", "replace")
    names: list[str] = []
    for place, name in enumerate(next(csv.reader([first]), [])):
        names.append(name if name and name.lower() not in {n.lower() for n in names} else f"{name or 'column'}_{place}")
    return names


def _unpacked(prefix: str):
    """Task: the pieces of every member of an archive, and one row about each member."""

    def rows(path: str, content: pa.Buffer) -> Iterator[tuple]:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            files = [info for info in archive.infolist() if not info.is_dir()]
            for number, info in enumerate(files):
                source = "s" + hashlib.md5(f"{path}\n{number}".encode()).hexdigest()
                table, names, layout = table_name(info.filename, prefix), [], "h0"
                with archive.open(info) as member:
                    for place, piece in enumerate(record_pieces(member)):
                        if not place:
                            names = column_names(piece)
                            layout = "h" + hashlib.md5("\n".join(names).encode()).hexdigest()
                        yield table, layout, source, place, piece
                about = dict(path=path, member=info.filename, table_name=table, columns=names, layout=layout, source=source)
                yield _ABOUT, "h", source, 0, json.dumps(about).encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                for row in rows(path.as_py(), content.as_buffer()):
                    yield pa.RecordBatch.from_pydict({n: [v] for n, v in zip(("table_name", "layout", "source", "place", "piece"), row)})

    return run


class Unpacked:
    """Archives unpacked to ``folder``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def members(self) -> DataFrame:
        """One row per member with its table and header; an empty member has no columns."""
        path = f"{self.folder}/table_name={_ABOUT}"
        if not exists(self.spark, path):
            return self.spark.createDataFrame([], MEMBERS)
        text = self.spark.read.option("lineSep", RECORD.decode()).text(path)
        return text.select(F.from_json("value", MEMBERS).alias("about")).select("about.*")

    def layouts(self, table: str | None = None) -> list[tuple[str, str, list[str]]]:
        """(table, layout, columns) of each distinct header of members that have one: a few, however many the archives are."""
        listed = self.members().filter(F.size("columns") > 0)
        if table:
            listed = listed.filter(F.col("table_name") == table)
        found = listed.groupBy("table_name", "layout").agg(F.any_value("columns").alias("columns")).collect()
        return sorted((row["table_name"], row["layout"], list(row["columns"])) for row in found)

    def rows(self, layouts: list[tuple[str, str, list[str]]], columns: list[str]) -> DataFrame:
        """Rows of the members with one of these headers: the columns as text, then ``source``; absent columns are null."""
        schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, "source"]])
        found = self.spark.createDataFrame([], schema)
        for number, (table, layout, names) in enumerate(layouts):
            # Names differ in case from header to header; columns go by place.
            by_name = {name.lower(): f"c{place}" for place, name in enumerate(names)}
            read = T.StructType([T.StructField(f"c{place}", T.StringType()) for place in range(len(names))])
            text = (
                self.spark.read.schema(read)
                .options(header=True, lineSep=RECORD.decode(), escape='"', mode="PERMISSIVE")
                .csv(f"{self.folder}/table_name={table}/layout={layout}")
            )
            picked = [F.col(by_name[c.lower()]) if c.lower() in by_name else F.lit(None).cast("string") for c in columns]
            rows = text.select(*[col.alias(c) for col, c in zip(picked, columns)], "source")
            found = rows if not number else found.unionByName(rows)
        return found

    def text_table(self, table: str, columns: list[str]) -> DataFrame:
        """Rows of all members of one table, in whatever folder and archive, all columns as text."""
        return self.rows(self.layouts(table), columns).drop("source")

    def text_member(self, member: str, columns: list[str]) -> DataFrame:
        """Rows of one member of every archive, all columns as text."""
        wanted = self.members().filter(F.col("member") == member).select(F.col("source").alias("_wanted"))
        rows = self.rows(self.layouts(table_name(member)), columns)
        return rows.join(wanted, F.col("source") == F.col("_wanted"), "left_semi").drop("source")


def unpack(archives: DataFrame, folder: str | None = None, prefix: str = TABLE_PREFIX) -> Unpacked:
    """Unpack all members of all archives, each archive once, below ``folder`` or the shared work folder."""
    spark = archives.sparkSession
    folder = folder or work_folder(spark, "members")
    names = ["table_name", "layout", "source"]
    pieces = archives.select("path", "content").mapInArrow(
        _unpacked(prefix), "table_name string, layout string, source string, place long, piece binary"
    )
    # The writer takes this order as its own, so the pieces of a member stay in their order.
    ordered = pieces.sortWithinPartitions(*names, "place").select(F.col("piece").cast("string").alias("value"), *names)
    ordered.write.mode("overwrite").partitionBy(*names).option("lineSep", RECORD.decode()).text(folder)
    return Unpacked(spark, folder)


def list_members(unpacked: Unpacked) -> DataFrame:
    """One row per archive member with its table name and header; an empty member has no columns."""
    return unpacked.members().select("path", "member", "table_name", "columns")


def _declared(text: DataFrame, schema: T.StructType) -> DataFrame:
    return text.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields])


def read_member(unpacked: Unpacked, member: str, schema: T.StructType) -> DataFrame:
    """One member with declared column types; text that does not fit its type becomes null."""
    return _declared(unpacked.text_member(member, schema.names), schema)


def read_member_inferred(unpacked: Unpacked, member: str) -> DataFrame:
    """One member typed by looking at every row of every column; text when no type fits all."""
    headers = unpacked.members().filter(F.col("member") == member)
    found = headers.agg(F.array_distinct(F.flatten(F.collect_set("columns")))).first()[0]
    if not found:
        raise ValueError(f"no archive holds {member}")
    return infer_types(unpacked.text_member(member, list(found)))


def load_archives(
    archives: DataFrame, folder: str, schemas: dict[str, T.StructType] = SCHEDULE_FILES, unpacked: Unpacked | None = None
) -> list[str]:
    """Replace one parquet table per table name of the members below ``folder``; returns their names.

    A table has the rows of all its members, in whatever folder and archive they are. Tables with a member
    whose file name is in ``schemas`` have its declared types, the others are typed by their values. The
    list of tables, a few names however large the archives are, is all that reaches the driver.
    """
    unpacked = unpacked or unpack(archives)
    base = F.element_at(F.split("member", "/"), -1)
    listed = unpacked.members().filter(F.size("columns") > 0).groupBy("table_name")
    bases = {row["table_name"]: row["bases"] for row in listed.agg(F.array_sort(F.collect_set(base)).alias("bases")).collect()}
    layouts = unpacked.layouts()
    for name in sorted(bases):
        mine = [layout for layout in layouts if layout[0] == name]
        schema = next((schemas[b] for b in bases[name] if b in schemas), None)
        if schema:
            rows = _declared(unpacked.rows(mine, schema.names), schema)
        else:
            columns = list({c.lower(): c for _, _, names in reversed(mine) for c in reversed(names)}.values())
            rows = infer_types(unpacked.rows(mine, columns).drop("source"))
        replace_files(rows, f"{folder}/{name}")
    return sorted(bases)
