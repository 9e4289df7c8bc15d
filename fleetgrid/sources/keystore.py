"""Keys of stored positions, laid out by hash of the vehicle, so that a batch reads only its buckets.

A batch adds one small folder, ``recent/run_id=/batch_id=``. Merging turns the finished batches of a run
into one part, ``merged/part=/bucket=``. When a bucket lies in ``MOST_PARTS`` parts, these
are merged for that bucket alone, so every key is rewritten a logarithmic number of times, and a
batch reads a bounded number of files a bucket whatever the length of the history. A manifest says
which buckets of which parts are live and which batches they hold; it changes in one step.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetgrid.operators.dedup import POSITION_KEY
from fleetgrid.schema import POSITION_KEYS
from fleetgrid.sources.files import folders, remove
from fleetgrid.sources.manifest import Manifest

# Spark lists up to 32 folders without a job.
BUCKETS = 32
MOST_PARTS = 6

_KEY = T.StructType([f for f in POSITION_KEYS.fields if f.name in POSITION_KEY])


class KeyStore:
    """Distinct ``(id, lat, lon)`` of all batches of all runs; keys with a null are never known and not kept."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, most_parts: int = MOST_PARTS):
        self.spark = spark
        self.recent = f"{path}/recent"
        self.merged = f"{path}/merged"
        self.manifest = Manifest(spark, f"{path}/manifest")
        self.buckets = buckets
        self.most_parts = most_parts

    def _state(self) -> tuple[int, dict]:
        version, state = self.manifest.newest()
        return version, {"buckets": self.buckets, "parts": {}, "through": {}, **state}

    def bucket_count(self) -> int:
        """Buckets of the layout; fixed by the first merge."""
        return self._state()[1]["buckets"]

    def runs(self) -> list[str]:
        """Runs that have stored keys."""
        found = {name.removeprefix("run_id=") for name in folders(self.spark, self.recent) if name.startswith("run_id=")}
        return sorted(found | set(self._state()[1]["through"]))

    def holds(self, run: str, batch_id: int) -> bool:
        """Whether the keys of a batch were stored."""
        return batch_id <= self._state()[1]["through"].get(run, -1) or batch_id in self._batches(run)

    def _batches(self, run: str) -> list[int]:
        names = folders(self.spark, f"{self.recent}/run_id={run}")
        return sorted(int(name.removeprefix("batch_id=")) for name in names if name.startswith("batch_id="))

    def add(self, keys: DataFrame, batch_id: int, run: str) -> None:
        """Store the keys of a batch; running the batch again replaces its own. A batch without keys leaves an empty folder."""
        path = f"{self.recent}/run_id={run}/batch_id={batch_id}"
        keys.select(*POSITION_KEY).dropna().write.mode("overwrite").parquet(path)

    def known(self, batch_id: int, run: str, buckets: Iterable[int] | None = None) -> DataFrame:
        """Keys stored by batches other than ``batch_id`` of ``run``; of merged ones only those in ``buckets``.

        Leaving out the batch itself lets it run again after a partial write.
        """
        state = self._state()[1]
        wanted = None if buckets is None else set(buckets)
        known = [self._read_parts(state["parts"], wanted)]
        paths = [
            f"{self.recent}/run_id={each}/batch_id={number}"
            for each in self.runs()
            for number in self._batches(each)
            if number > state["through"].get(each, -1) and (each, number) != (run, batch_id)
        ]
        if paths:
            known.append(self.spark.read.schema(_KEY).parquet(*paths))
        found = [df for df in known if df is not None]
        if not found:
            return self.spark.createDataFrame([], _KEY)
        return found[0] if len(found) == 1 else found[0].unionByName(found[1])

    def _read_parts(self, parts: dict[str, list[int]], wanted: set[int] | None) -> DataFrame | None:
        """Keys of the wanted buckets. Whole parts are read by their folder, others by the folders of buckets."""
        paths = []
        for part, held in sorted(parts.items()):
            mine = held if wanted is None else sorted(wanted & set(held))
            paths += [f"{self.merged}/part={part}/bucket={bucket}" for bucket in mine]
        if not paths:
            return None
        return self.spark.read.schema(_KEY).parquet(*paths)

    def merge(self, through: int, run: str) -> None:
        """Merge the keys of a run's batches up to ``through``, which must be finished; run this between batches.

        The merged folders go once the new version is committed.
        """
        version, state = self._state()
        since = state["through"].get(run, -1)
        batches = [n for n in self._batches(run) if since < n <= through]
        old: list[str] = []
        if batches:
            parts = {part: list(held) for part, held in state["parts"].items()}
            fresh = self.spark.read.schema(_KEY).parquet(*[f"{self.recent}/run_id={run}/batch_id={n}" for n in batches])
            self._write_part(fresh, parts, state["buckets"])
            old = self._merge_full_buckets(parts, state["buckets"])
            parts = {part: held for part, held in parts.items() if held}
            self.manifest.replace(version, {**state, "parts": parts, "through": {**state["through"], run: through}})
        for number in self._batches(run):
            if number <= max(since, through if batches else since):
                old.append(f"{self.recent}/run_id={run}/batch_id={number}")
        for path in old:
            remove(self.spark, path)

    def _write_part(self, keys: DataFrame, parts: dict[str, list[int]], count: int) -> None:
        part = uuid.uuid4().hex[:12]
        # Rebalancing splits a bucket of a hot vehicle over several files and leaves small ones in one.
        rows = keys.distinct().withColumn("bucket", bucket_of(F.col("id"), count)).hint("rebalance", "bucket")
        rows.write.partitionBy("bucket").parquet(f"{self.merged}/part={part}")
        names = folders(self.spark, f"{self.merged}/part={part}")
        parts[part] = sorted(int(name.removeprefix("bucket=")) for name in names if name.startswith("bucket="))

    def _merge_full_buckets(self, parts: dict[str, list[int]], count: int) -> list[str]:
        """Merge the buckets that lie in too many parts; returns the folders that this replaces."""
        held = [bucket for buckets in parts.values() for bucket in buckets]
        full = {bucket for bucket in held if held.count(bucket) > self.most_parts}
        if not full:
            return []
        mine = {part: sorted(full & set(buckets)) for part, buckets in parts.items()}
        old = [f"{self.merged}/part={part}/bucket={bucket}" for part, buckets in mine.items() for bucket in buckets]
        keys = self.spark.read.schema(_KEY).parquet(*old)
        for part, buckets in mine.items():
            parts[part] = [bucket for bucket in parts[part] if bucket not in full]
        self._write_part(keys, parts, count)
        return old


def bucket_of(id_: Column, count: int) -> Column:
    """Bucket of a vehicle."""
    return F.pmod(F.xxhash64(id_), F.lit(count)).cast("int")
