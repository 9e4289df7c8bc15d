"""Continuous ingest: landed payloads to the position log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetgrid.sources.feed import (
    PLACE,
    SOURCE,
    has_whole_documents,
    parse_payloads,
    parsed_lines,
    payload_order,
    payloads_from_text,
    payloads_of_lines,
    rejected,
    stream_rows,
)
from fleetgrid.sources.keystore import bucket_of
from fleetgrid.sources.positions import FIRST_RUN, Inserted, PositionLog

# Fixed value: poll period of the feed.
POLL_PERIOD = "60 seconds"

# Files of one micro-batch at most: a backlog is taken in several, none is left out.
BATCH_FILES = 1_000

# Batches between two merges of rows and keys.
COMPACT_EVERY = 60


class MalformedPayloads(ValueError):
    """A batch holds payloads that cannot be read."""


def store_batch(
    log: PositionLog, payloads: DataFrame, batch_id: int, run: str = FIRST_RUN, on_malformed: str = "keep"
) -> Inserted:
    """Insert the payloads of one micro-batch.

    A micro-batch may hold several payloads: they count as inserted one after the other, so results do
    not depend on how files fall into micro-batches. Malformed payloads are kept beside the log and
    counted; with ``on_malformed="fail"`` they fail the batch before anything is stored. Payloads are parsed once: one
    job over them counts, the others write.
    """
    if on_malformed not in ("keep", "fail"):
        raise ValueError(f"on_malformed is keep or fail, not {on_malformed}")
    payloads = payloads.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        count = log.keys.bucket_count()
        buckets = F.array_distinct(F.transform("vehicle", lambda vehicle: bucket_of(vehicle["id"], count)))
        malformed, received, touched = payloads.agg(
            F.count_if("malformed"),
            F.coalesce(F.sum(F.size("vehicle")).cast("long"), F.lit(0)),
            F.array_distinct(F.flatten(F.collect_set(buckets))),
        ).first()
        if malformed and on_malformed == "fail":
            raise MalformedPayloads(f"batch {batch_id} holds payloads that cannot be read")
        if malformed:
            log.reject(rejected(payloads), batch_id, run)
        rows = parse_payloads(payloads).withColumn("_payload", payload_order()).drop(SOURCE, PLACE)
        counts = log.insert(rows, received, touched, batch_id, "_payload", run)
        return Inserted(counts.received, counts.inserted, malformed)
    finally:
        payloads.unpersist()


def run_of(spark: SparkSession, checkpoint: str) -> str:
    """The id that a stream keeps in its checkpoint: another checkpoint is another run."""
    text = spark.read.text(f"{checkpoint.rstrip('/')}/metadata")
    return text.select(F.get_json_object("value", "$.id")).first()[0]


def start_ingest(
    spark: SparkSession,
    landing: str,
    store: str,
    checkpoint: str,
    period: str | None = POLL_PERIOD,
    landed: bool = False,
    max_files: int | None = BATCH_FILES,
    report: Callable[[int, Inserted], None] | None = None,
    on_malformed: str = "keep",
    compact_every: int = COMPACT_EVERY,
) -> StreamingQuery:
    """Start the ingest stream; ``period=None`` takes what has landed and stops.

    ``landing`` holds feed files, or with ``landed`` a table of ``land_payloads``. A failed batch runs
    again from the checkpoint and overwrites its own rows. Every ``compact_every`` batches the rows and keys of
    the batches before are merged.
    """
    found: list[str] = []

    def run(rows: DataFrame, batch_id: int) -> None:
        session = rows.sparkSession
        log = PositionLog(session, store)
        if not found:
            found.append(run_of(session, checkpoint))
            log.repair_keys(found[0])
        if landed:
            counts = store_batch(log, payloads_from_text(rows), batch_id, found[0], on_malformed)
        else:
            lines = parsed_lines(rows).persist(StorageLevel.MEMORY_AND_DISK)
            try:
                payloads = payloads_of_lines(lines, has_whole_documents(lines))
                counts = store_batch(log, payloads, batch_id, found[0], on_malformed)
            finally:
                lines.unpersist()
        if batch_id and batch_id % compact_every == 0:
            log.compact_keys(batch_id - 1, found[0])
            log.merge_dates(batch_id - 1, found[0])
        if report:
            report(batch_id, counts)

    writer = (
        stream_rows(spark, landing, landed, max_files)
        .writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
    )
    trigger = {"processingTime": period} if period else {"availableNow": True}
    return writer.trigger(**trigger).start()
