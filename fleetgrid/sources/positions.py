"""The position log: append-only parquet, one folder per event date, run and batch until these are merged, and its keys.

A run is a stream with its checkpoint. Batch numbers start anew with a new checkpoint, so they name a
batch only together with the run: an old batch is never overwritten by another run's.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from fleetgrid.operators.dedup import keep_first_batch, unknown_positions
from fleetgrid.operators.lookback import look_back, moment
from fleetgrid.schema import POSITIONS, STORED_POSITIONS
from fleetgrid.sources.files import exists, folders, remove
from fleetgrid.sources.keystore import BUCKETS, KeyStore, bucket_of
from fleetgrid.sources.manifest import Manifest

# Run of batches that no stream writes.
FIRST_RUN = "0"

# Days before the newest one that still get rows as a rule.
OPEN_DAYS = 1


@dataclass(frozen=True)
class Inserted:
    """Rows of one batch: received and stored; the rest was known already. Malformed payloads count apart."""

    received: int
    inserted: int
    malformed: int = 0

    @property
    def skipped(self) -> int:
        return self.received - self.inserted


class PositionLog:
    """Stored positions below ``path``, and their keys beside them.

    A batch is a folder, ``event_date=/run_id=/batch_id=``. Merging turns the finished batches into one part a date, and
    the parts of a closed date into one, so a date stays a few folders however many batches it had. A
    manifest names the live parts and the batches they hold. It changes in one step, and what a merge replaces is
    deleted by the merge after it, so a reader that has planned goes on meanwhile.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark = spark
        self.path = path.rstrip("/")
        self.keys = KeyStore(spark, f"{self.path}_keys", buckets)
        self.merged_path = f"{self.path}_merged"
        self.manifest = Manifest(spark, f"{self.path}_manifest")
        self.rejected_path = f"{self.path}_rejected"

    def _state(self) -> tuple[int, dict]:
        version, state = self.manifest.newest()
        return version, {"dates": {}, "through": {}, "retired": {}, **state}

    def stored(self, since: date | None = None) -> DataFrame:
        """Rows with the partition columns ``event_date, run_id, batch_id``; empty before any batch.

        With ``since`` only the folders of that date and later ones are listed.
        """
        state = self._state()[1]
        first = "" if since is None else since.isoformat()
        merged = [f"{self.merged_path}/part={part}/event_date={day}" for day, parts in state["dates"].items() if day >= first for part in parts]
        batches = self._batch_rows(first, state["through"])
        if not merged:
            return batches if batches is not None else self.spark.createDataFrame([], STORED_POSITIONS)
        parts = self.spark.read.schema(STORED_POSITIONS).option("basePath", self.merged_path).parquet(*sorted(merged))
        parts = parts.select(*STORED_POSITIONS.names)
        return parts if batches is None else batches.unionByName(parts)

    def _batch_rows(self, first: str, through: dict[str, int]) -> DataFrame | None:
        """Rows of the batches that no part holds, from a date on."""
        if not exists(self.spark, self.path):
            return None
        read = self.spark.read.schema(STORED_POSITIONS).option("basePath", self.path)
        if first:
            dates = sorted(
                name
                for name in folders(self.spark, self.path)
                if name.startswith("event_date=") and name >= f"event_date={first}"
            )
            if not dates:
                return None
            rows = read.parquet(*[f"{self.path}/{name}" for name in dates])
        else:
            rows = read.parquet(self.path)
        for run, number in through.items():
            rows = rows.filter((F.col("run_id") != run) | (F.col("batch_id") > number))
        return rows

    def positions(self) -> DataFrame:
        return self.stored().select(*POSITIONS.names)

    def recent(self, span: timedelta, as_of: datetime | None = None) -> DataFrame:
        """Rows no older than ``span``; only the folders of the dates in question are listed."""
        since = (moment(self.spark, as_of) - span).date()
        return look_back(self.stored(since), span, as_of)

    def known_keys(self, batch_id: int, run: str = FIRST_RUN) -> DataFrame:
        """Position keys stored by batches other than ``batch_id`` of ``run``."""
        return self.keys.known(batch_id, run)

    def append(
        self, batch: DataFrame, batch_id: int, order: str | None = None, run: str = FIRST_RUN
    ) -> Inserted:
        """Store the new positions of one batch; running a batch again replaces its own rows.

        With ``order`` the batch holds several payloads, inserted in the order of that column. One job counts the
        rows and finds their buckets, one writes the rows and counts them, one writes their keys.
        """
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            bucket = bucket_of(F.col("id"), self.keys.bucket_count())
            received, buckets = batch.agg(F.count(F.lit(1)), F.collect_set(bucket)).first()
            return self.insert(batch, received, buckets, batch_id, order, run)
        finally:
            batch.unpersist()

    def insert(
        self, batch: DataFrame, received: int, buckets: Iterable[int], batch_id: int, order: str | None = None, run: str = FIRST_RUN
    ) -> Inserted:
        """``append`` for a batch whose number of rows and buckets of keys are known."""
        rows = batch.distinct()
        if order:
            rows = keep_first_batch(rows, batch, order)
        stored = self.keys.known(batch_id, run, buckets)
        fresh = unknown_positions(rows.select(*POSITIONS.names), stored, batch, received)
        return Inserted(received, self._write(fresh, batch_id, run))

    def reject(self, payloads: DataFrame, batch_id: int, run: str = FIRST_RUN) -> None:
        """Keep the malformed payloads of a batch; running it again replaces its own."""
        self._overwrite(_of_batch(payloads, batch_id, run), self.rejected_path, "run_id", "batch_id")

    def _write(self, fresh: DataFrame, batch_id: int, run: str) -> int:
        # Rebalancing gives files of even size, also when one date holds most rows.
        numbered = _of_batch(fresh, batch_id, run).hint("rebalance")
        numbered = numbered.persist(StorageLevel.MEMORY_AND_DISK)
        written = Observation()
        try:
            dated = numbered.observe(written, F.count(F.lit(1)).alias("n"))
            dated = dated.withColumn("event_date", F.to_date("api_timestamp"))
            self._overwrite(dated, self.path, "event_date", "run_id", "batch_id")
            self.keys.add(numbered, batch_id, run)
            return written.get.get("n", 0)
        finally:
            numbered.unpersist()

    def _overwrite(self, rows: DataFrame, path: str, *partitions: str) -> None:
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(*partitions).parquet(path)

    def compact_keys(self, through: int, run: str = FIRST_RUN) -> None:
        """Merge the keys of a run's batches up to ``through``; see ``KeyStore.merge``."""
        self.keys.merge(through, run)

    def _batches(self, run: str) -> dict[str, list[int]]:
        """Folders of a run's batches by date."""
        found = {}
        for day in folders(self.spark, self.path):
            if day.startswith("event_date="):
                names = folders(self.spark, f"{self.path}/{day}/run_id={run}")
                numbers = sorted(int(name.removeprefix("batch_id=")) for name in names if name.startswith("batch_id="))
                if numbers:
                    found[day.removeprefix("event_date=")] = numbers
        return found

    def merge_dates(self, through: int, run: str = FIRST_RUN, open_days: int = OPEN_DAYS) -> None:
        """Merge a run's batches up to ``through`` into one part a date, and all parts of closed dates into one.

        ``through`` must be finished; run this between batches. A date is closed when it is more than ``open_days``
        before the newest one; late rows of a closed date are merged into it again.
        """
        version, state = self._state()
        done = state["through"].get(run, -1)
        batches = {day: [n for n in numbers if done < n <= through] for day, numbers in self._batches(run).items()}
        batches = {day: numbers for day, numbers in batches.items() if numbers}
        if not batches:
            return
        dates = {day: list(parts) for day, parts in state["dates"].items()}
        newest = max((day for day in {*dates, *batches} if day[:1].isdigit()), default="")
        part = uuid.uuid4().hex[:12]
        sources, retired = [], []
        for day in sorted({*dates, *batches}):
            paths = [f"{self.path}/event_date={day}/run_id={run}/batch_id={n}" for n in batches.get(day, ())]
            held = dates.get(day, [])
            closed = day[:1].isdigit() and date.fromisoformat(newest) - date.fromisoformat(day) > timedelta(open_days)
            if closed and len(held) + bool(paths) > 1:
                retired += [f"{self.merged_path}/part={old}/event_date={day}" for old in held]
                sources += retired[-len(held) :]
                held = []
            elif not paths:
                continue
            dates[day] = [*held, part]
            sources += paths
            retired += paths
        self._write_part(part, sources)
        expired = [path for number, paths in state["retired"].items() if int(number) <= version for path in paths]
        left = {number: paths for number, paths in state["retired"].items() if int(number) > version}
        self.manifest.replace(
            version,
            {"dates": dates, "through": {**state["through"], run: through}, "retired": {**left, str(version + 1): retired}},
        )
        for path in expired:
            remove(self.spark, path)

    def _write_part(self, part: str, sources: list[str]) -> None:
        """One part from folders of batches and of older parts, the partition columns of batches as data."""
        frames = []
        for base in (self.path, self.merged_path):
            mine = [path for path in sources if path.startswith(f"{base}/")]
            if mine:
                read = self.spark.read.schema(STORED_POSITIONS).option("basePath", base).parquet(*mine)
                frames.append(read.select(*STORED_POSITIONS.names))
        rows = frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])
        rows.hint("rebalance", "event_date").write.partitionBy("event_date").parquet(f"{self.merged_path}/part={part}")

    def repair_keys(self, run: str) -> int:
        """Store the keys of batches of other runs that were cut off between their rows and their keys."""
        state, mended = self._state()[1], 0
        runs = {name for day in folders(self.spark, self.path) for name in folders(self.spark, f"{self.path}/{day}")}
        for other in sorted(name.removeprefix("run_id=") for name in runs if name.startswith("run_id=")):
            numbers = {n for numbers in self._batches(other).values() for n in numbers if n > state["through"].get(other, -1)}
            for number in sorted(numbers if other != run else ()):
                if not self.keys.holds(other, number):
                    rows = self.stored().filter((F.col("run_id") == other) & (F.col("batch_id") == number))
                    self.keys.add(rows, number, other)
                    mended += 1
        return mended


def _of_batch(rows: DataFrame, batch_id: int, run: str) -> DataFrame:
    return rows.withColumns({"run_id": F.lit(run), "batch_id": F.lit(batch_id).cast("long")})
