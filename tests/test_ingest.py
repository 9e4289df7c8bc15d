from __future__ import annotations

import contextlib
import json
import os
import re
import signal
import subprocess
import sys
from collections import Counter
from datetime import timedelta
from pathlib import Path
from random import Random
from subprocess import DEVNULL

import pytest
from pyspark.sql import functions as F

from fleetgrid.operators import dedup
from fleetgrid.schema import FEED_FIELDS, POSITIONS, STORED_POSITIONS
from fleetgrid.sources import feed
from fleetgrid.sources.keystore import KeyStore, bucket_of
from fleetgrid.sources.manifest import Manifest
from fleetgrid.sources.positions import Inserted, PositionLog
from fleetgrid.streaming.ingest import start_ingest, store_batch

START = 1_712_345_640_000


# What a report says unless a test says otherwise.
USUAL = {"lat": "44.1025", "lon": "-78.5510", "routeTag": "27"}


def document(*reports, minute=0):
    """A feed document. A report is a vehicle's name, or the name and what differs from the usual."""
    listed = []
    for report in reports:
        name, changes = (report, {}) if isinstance(report, str) else report
        listed.append({**USUAL, **changes, "id": name})
    return {"lastTime": {"time": f"{START + 60_000 * minute}"}, "vehicle": listed}


class Landing:
    """A landing folder whose files get rising modification times."""

    def __init__(self, path):
        self.path = Path(path)
        self.path.mkdir()
        self.count = 0

    def add(self, document):
        target = self.path / f"{self.count:05d}.json"
        target.write_text(json.dumps(document))
        seconds = START // 1000 + 60 * self.count
        os.utime(target, (seconds, seconds))
        self.count += 1
        return str(target)


@pytest.fixture
def landing(folder):
    return Landing(folder)


@pytest.fixture
def log(spark, folder):
    return PositionLog(spark, folder + "_store")


def write(spark, landing, log, document):
    """Store one payload as its own batch."""
    batch_id = landing.count
    return store_batch(log, feed.read_payloads(spark, landing.add(document)), batch_id)


# --- payloads ---


def test_payload_becomes_one_row_per_vehicle(spark, landing):
    path = landing.add(document(("1", {"heading": "90"}), "2"))
    rows = feed.parse_payloads(feed.read_payloads(spark, path))
    assert set(rows.columns) == {*POSITIONS.names, feed.SOURCE, feed.PLACE}
    found = {r.id: r for r in rows.collect()}
    assert found["1"].heading == "90" and found["2"].heading is None
    assert found["1"].api_timestamp.timestamp() * 1000 == START
    assert found["1"].fetched_at.timestamp() * 1000 == START


def test_payload_numbers_are_kept_as_text(spark, landing):
    path = landing.add(document(("7", {"lat": 43.5, "predictable": True})))
    row = feed.parse_payloads(feed.read_payloads(spark, path)).first()
    assert (row.id, row.lat, row.predictable) == ("7", "43.5", "true")


def test_payload_without_vehicles_gives_no_rows(spark, landing):
    landing.add({"lastTime": {"time": str(START)}})
    landing.add(document())
    assert feed.parse_payloads(feed.read_payloads(spark, str(landing.path))).count() == 0


def test_indented_payload(spark, folder):
    Path(folder).mkdir()
    (Path(folder) / "a.json").write_text(json.dumps(document("1", "2"), indent=2))
    assert feed.parse_payloads(feed.read_payloads(spark, folder)).count() == 2


def test_cursor_is_the_newest_payload_time(spark, landing):
    landing.add(document(minute=2))
    landing.add(document("1"))
    payloads = feed.read_payloads(spark, str(landing.path))
    assert feed.next_cursor(payloads).first().cursor == str(START + 120_000)
    assert feed.next_cursor(payloads.limit(0)).first().cursor == "0"


def test_landed_text_can_be_read_again(spark, folder):
    rows = [(json.dumps(document("1", "2")), "2024-05-06 01:00:00")]
    frame = spark.createDataFrame(rows, "value string, fetched_at string")
    feed.land_payloads(frame.withColumn("fetched_at", F.col("fetched_at").cast("timestamp")), folder)
    assert [p.name for p in Path(folder).iterdir() if p.is_dir()] == ["fetch_date=2024-05-06"]
    read = feed.read_payloads(spark, folder, landed=True)
    found = feed.parse_payloads(read).collect()
    assert {r.fetched_at.isoformat() for r in found} == {"2024-05-06T01:00:00"} and len(found) == 2


def test_a_file_may_hold_a_document_per_line(spark, folder):
    Path(folder).mkdir()
    lines = [json.dumps(document("1")), "", json.dumps(document("2", "3")), json.dumps(document("4"))[:-9]]
    (Path(folder) / "a.json").write_text("\n".join(lines))
    read = feed.read_payloads(spark, folder)
    assert sorted(r.id for r in feed.parse_payloads(read).collect()) == ["1", "2", "3"]
    assert [r.value for r in feed.rejected(read).collect()] == [lines[3]]


@pytest.mark.parametrize("first", ["garbage", json.dumps(document("9"))[:-9], "{"])
def test_a_bad_first_line_takes_no_other_line_with_it(spark, folder, first):
    Path(folder).mkdir()
    lines = [first, json.dumps(document("1")), json.dumps(document("2"))[:-5], json.dumps(document("3"))]
    (Path(folder) / "a.json").write_text("\n".join(lines))
    read = feed.read_payloads(spark, folder)
    assert sorted(r.id for r in feed.parse_payloads(read).collect()) == ["1", "3"]
    assert sorted(r.value for r in feed.rejected(read).collect()) == sorted([lines[0], lines[2]])


def test_lines_that_are_all_cut_off_are_judged_one_by_one(spark, folder):
    Path(folder).mkdir()
    lines = [json.dumps(document(str(n)))[:-5] for n in range(3)]
    (Path(folder) / "a.json").write_text("\n".join(lines))
    assert sorted(r.value for r in feed.rejected(feed.read_payloads(spark, folder)).collect()) == sorted(lines)


def test_an_indented_document_stays_whole_whatever_its_first_line(spark, folder):
    Path(folder).mkdir()
    text = '{"lastTime": {"time": "1714953600000"}\n, "vehicle": [\n{"id": "1"},\n{"id": "2"}\n]}'
    (Path(folder) / "a.json").write_text(text)
    (Path(folder) / "b.json").write_text(json.dumps(document("3"), indent=2)[:-9])
    read = feed.read_payloads(spark, folder)
    assert sorted(r.id for r in feed.parse_payloads(read).collect()) == ["1", "2"]
    assert feed.rejected(read).count() == 1


def test_bad_payloads_of_feed_files_through_the_stream(spark, folder):
    """Every third payload cut off and every fifth without its time, in files of ten lines."""
    Path(folder).mkdir()
    texts = [json.dumps(document(str(n))) for n in range(60)]
    texts = [t[:-5] if n % 3 == 0 else t.replace("lastTime", "noTime") if n % 5 == 0 else t for n, t in enumerate(texts)]
    for k in range(6):
        (Path(folder) / f"{k}.json").write_text("\n".join(texts[10 * k : 10 * k + 10]))
    store = folder + "_log"
    start_ingest(spark, folder, store, f"{store}_offsets", period=None).awaitTermination()
    log = PositionLog(spark, store)
    bad = {n for n in range(60) if n % 3 == 0 or n % 5 == 0}
    assert {r.id for r in log.positions().collect()} == {str(n) for n in range(60) if n not in bad}
    assert sorted(r.value for r in spark.read.parquet(log.rejected_path).collect()) == sorted(texts[n] for n in bad)


@pytest.fixture
def small_splits(spark):
    """Files are read in ranges of 300 bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    for name in names:
        spark.conf.set(name, "300")
    yield
    for name in names:
        spark.conf.unset(name)


def test_a_large_file_of_lines_is_read_by_many_tasks(spark, folder, small_splits):
    Path(folder).mkdir()
    texts = [json.dumps(document(str(n), minute=n)) for n in range(80)]
    texts = [t[:-9] if n % 5 == 3 else t for n, t in enumerate(texts)]
    (Path(folder) / "a.json").write_text("\n\n".join(texts))
    assert spark.read.text(folder).rdd.getNumPartitions() > 10
    read = feed.read_payloads(spark, folder).collect()
    assert [r.value for r in sorted(read, key=lambda r: r[feed.PLACE])] == texts
    assert [r.value for r in read if r.malformed] == sorted((t for n, t in enumerate(texts) if n % 5 == 3), key=[r.value for r in read].index)


def test_documents_over_many_lines_are_found_across_splits(spark, folder, small_splits):
    """Indented documents one after the other, with braces and quotes inside strings, cut-off and foreign lines among them."""
    Path(folder).mkdir()
    names = ["1", 'a "quoted" name', "brace } in { it", "slash \\\\", "[", "2"]
    texts = [json.dumps(document(name, f"{name}!"), indent=1 + n % 3) for n, name in enumerate(names * 6)]
    (Path(folder) / "many.json").write_text("\n".join([*texts[:20], "no document", *texts[20:]]))
    (Path(folder) / "one.json").write_text(json.dumps(document(*map(str, range(40))), indent=2))
    (Path(folder) / "cut.json").write_text(json.dumps(document("7"), indent=2)[:-9])
    read = feed.read_payloads(spark, folder)
    good = read.filter("NOT malformed").collect()
    in_order = sorted((r for r in good if r[feed.SOURCE].endswith("many.json")), key=lambda r: r[feed.PLACE])
    assert [r.value for r in in_order] == texts
    assert [len(r.vehicle) for r in good if r[feed.SOURCE].endswith("one.json")] == [40]
    bad = sorted(r.value for r in feed.rejected(read).collect())
    assert bad == sorted(["no document", json.dumps(document("7"), indent=2)[:-9].rstrip()])


def test_too_large_a_document_is_judged_line_by_line(spark, folder, monkeypatch):
    monkeypatch.setattr(feed, "DOCUMENT_BYTES", 500)
    Path(folder).mkdir()
    large, small = (json.dumps(document(*map(str, range(n))), indent=1) for n in (20, 1))
    (Path(folder) / "a.json").write_text(f"{large}\n{small}")
    read = feed.read_payloads(spark, folder).collect()
    assert [r.value for r in read if not r.malformed] == [small]
    assert sorted(r.value for r in read if r.malformed) == sorted(large.split("\n"))


@pytest.mark.parametrize("text", ["{", "[]", "7", "null", "text", '{"vehicle": []}', '{"lastTime": {"time": "soon"}}'])
def test_what_is_no_payload_is_kept(spark, folder, text):
    Path(folder).mkdir()
    (Path(folder) / "a.json").write_text(text)
    read = feed.read_payloads(spark, folder)
    assert feed.parse_payloads(read).count() == 0
    assert [r.value for r in feed.rejected(read).collect()] == [text]


# --- insert rule ---


def test_first_write_creates_the_log_and_counts_its_rows(spark, landing, log):
    assert log.positions().count() == 0
    counts = write(spark, landing, log, document("1", "2", "3"))
    assert counts == Inserted(3, 3)
    assert log.positions().count() == 3
    assert log.positions().columns == POSITIONS.names


def test_exact_copies_in_one_payload_are_stored_once(spark, landing, log):
    counts = write(spark, landing, log, document("1", "1"))
    assert (counts.inserted, counts.skipped) == (1, 1)


def test_rows_of_one_payload_that_differ_elsewhere_all_stay(spark, landing, log):
    write(spark, landing, log, document(("1", {"heading": "1"}), ("1", {"heading": "2"})))
    assert log.positions().count() == 2


def test_known_position_is_not_stored_again(spark, landing, log):
    write(spark, landing, log, document("1"))
    assert write(spark, landing, log, document("1")) == Inserted(1, 0)
    counts = write(spark, landing, log, document(("1", {"heading": "5"}), minute=1))
    assert counts == Inserted(1, 0)
    assert log.positions().count() == 1


def test_new_position_and_other_vehicle_are_stored(spark, landing, log):
    write(spark, landing, log, document("1"))
    write(spark, landing, log, document(("1", {"lat": "44.2190", "lon": "-78.4025"})))
    write(spark, landing, log, document("2"))
    assert log.positions().count() == 3


def test_positions_compare_as_text(spark, landing, log):
    write(spark, landing, log, document(("1", {"lat": "44.75"})))
    assert write(spark, landing, log, document(("1", {"lat": "44.750"}))).inserted == 1


def test_unknown_position_is_always_stored(spark, landing, log):
    for _ in range(3):
        assert write(spark, landing, log, document(("1", {"lat": None}))).inserted == 1


def test_vehicle_back_at_an_earlier_position_is_not_stored(spark, landing, log):
    for lat in ("43.1", "43.2", "43.1"):
        write(spark, landing, log, document(("1", {"lat": lat})))
    assert log.positions().count() == 2


def test_batch_can_run_again(spark, landing, log):
    write(spark, landing, log, document("1"))
    path = landing.add(document("1", "2", ("3", {"lat": None})))
    for _ in range(2):
        assert store_batch(log, feed.read_payloads(spark, path), 1).inserted == 2
    assert log.positions().count() == 3


def test_rows_after_a_cut_off_write_are_replaced(spark, landing, log):
    write(spark, landing, log, document("1"))
    path = landing.add(document("2", "3"))
    cut_off = feed.read_payloads(spark, path).withColumn("vehicle", F.slice("vehicle", 1, 1))
    store_batch(log, cut_off, 1)
    store_batch(log, feed.read_payloads(spark, path), 1)
    assert sorted(r.id for r in log.positions().collect()) == ["1", "2", "3"]


def random_feed(seed, batches=12, vehicles=6):
    random = Random(seed)
    documents = []
    for n in range(batches):
        rows = [
            (
                random.choice([str(random.randrange(vehicles)), "hot"]),
                {
                    "lat": random.choice(["44.1", "44.2", "44.3", None]),
                    "lon": random.choice(["-78.1", "-78.2"]),
                    "heading": str(random.randrange(2)),
                },
            )
            for _ in range(random.randrange(8))
        ]
        documents.append(document(*rows, minute=n // 2))
    return documents


def model(documents):
    """The insert rule, one payload after the other."""
    stored, rows = set(), []
    for n, document in enumerate(documents):
        fresh = {tuple(v.get(f) for f in FEED_FIELDS) for v in document["vehicle"]}
        keys = []
        for row in fresh:
            key = tuple(row[FEED_FIELDS.index(k)] for k in dedup.POSITION_KEY)
            if None in key or key not in stored:
                rows.append((*row, n))
                keys.append(key)
        stored.update(keys)
    return Counter(rows)


def log_frame(spark, documents):
    rows = [
        (*[v.get(f) for f in FEED_FIELDS], n)
        for n, document in enumerate(documents)
        for v in document["vehicle"]
    ]
    return spark.createDataFrame(rows, ", ".join(f"{f} string" for f in FEED_FIELDS) + ", batch_id int")


@pytest.mark.parametrize("seed", range(3))
def test_replay_equals_the_model(spark, seed):
    documents = random_feed(seed)
    frame = log_frame(spark, documents)
    assert Counter(tuple(r) for r in dedup.replay(frame).collect()) == model(documents)
    counts = {r.batch_id: r for r in dedup.insert_counts(frame).collect()}
    kept = Counter(row[-1] for row in model(documents).elements())
    for n, document in enumerate(documents):
        if document["vehicle"]:
            assert counts[n].received == len(document["vehicle"])
            assert (counts[n].inserted, counts[n].skipped) == (kept[n], counts[n].received - kept[n])


@pytest.mark.parametrize("max_files", [1, 3, None])
def test_stream_equals_the_model_for_any_micro_batch(spark, landing, folder, max_files):
    documents = random_feed(7, batches=8)
    reports = {}
    store, offsets = folder + "_store", folder + "_offsets"
    for some in (documents[:5], documents[5:]):
        for document in some:
            landing.add(document)
        start_ingest(
            spark,
            str(landing.path),
            store,
            offsets,
            period=None,
            max_files=max_files,
            report=lambda n, counts: reports.update({n: counts}),
        ).awaitTermination()
    found = PositionLog(spark, store).positions()
    wanted = Counter(row[:-1] for row in model(documents).elements())
    assert Counter(tuple(r) for r in found.select(*FEED_FIELDS).collect()) == wanted
    assert sum(c.inserted for c in reports.values()) == sum(wanted.values())
    assert sum(c.received for c in reports.values()) == sum(len(d["vehicle"]) for d in documents)
    assert len(reports) == {1: 8, 3: 3, None: 2}[max_files]


def test_failed_batch_runs_again_from_the_checkpoint(spark, landing, folder):
    documents = random_feed(9)
    store, offsets = folder + "_store", folder + "_offsets"
    for document in documents:
        landing.add(document)

    def fail(n, counts):
        if n == 1:
            raise RuntimeError("lost")

    query = start_ingest(
        spark, str(landing.path), store, offsets, period=None, max_files=5, report=fail
    )
    with pytest.raises(Exception, match="lost"):
        query.awaitTermination()
    start_ingest(
        spark, str(landing.path), store, offsets, period=None, max_files=5
    ).awaitTermination()
    found = PositionLog(spark, store).positions().select(*FEED_FIELDS)
    wanted = Counter(row[:-1] for row in model(documents).elements())
    assert Counter(tuple(r) for r in found.collect()) == wanted


# Ends the process, as a kill would, after the n-th write of a batch or before its checkpoint is committed.
KILLED = """
import os, sys
sys.path[:0] = [{root!r}]
from fleetgrid.session import build_session
from fleetgrid.sources.positions import PositionLog
from fleetgrid.sources.keystore import KeyStore
from fleetgrid.streaming.ingest import start_ingest
cut, batch, done = {cut!r}, 1, []
def dying(kind, name, now):
    plain = getattr(kind, name)
    def run(self, *args):
        value = plain(self, *args)
        done.append(name)
        if now(args):
            os._exit(7)
        return value
    setattr(kind, name, run)
if cut == "rows":
    dying(PositionLog, "_overwrite", lambda args: done.count("_overwrite") == 2)
elif cut == "keys":
    dying(KeyStore, "add", lambda args: args[1] == batch)
report = (lambda n, counts: n == batch and os._exit(7)) if cut == "commit" else None
spark = build_session("killed", "local[2]", {{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2"}})
start_ingest(spark, {landing!r}, {store!r}, {offsets!r}, period=None, max_files=3, report=report).awaitTermination()
"""


@pytest.mark.parametrize(("cut", "new_checkpoint"), [("rows", True), ("rows", False), ("keys", False), ("commit", False)])
def test_a_killed_stream_goes_on_as_if_nothing_had_happened(spark, landing, folder, cut, new_checkpoint):
    documents = random_feed(13, batches=9)
    for document in documents:
        landing.add(document)
    store, offsets, root = folder + "_store", folder + "_offsets", str(Path(__file__).parent.parent)
    script = KILLED.format(root=root, cut=cut, landing=str(landing.path), store=store, offsets=offsets)
    killed = subprocess.Popen([sys.executable, "-c", script], stdout=DEVNULL, stderr=DEVNULL, start_new_session=True)
    try:
        assert killed.wait(timeout=200) == 7
    finally:
        with contextlib.suppress(ProcessLookupError):
            os.killpg(killed.pid, signal.SIGKILL)
    if new_checkpoint:
        # The lost run's second batch left rows without keys; what it stored stays known.
        offsets += "_new"
        located = [[v for v in d["vehicle"] if v["lat"]] for d in documents]
        documents = [{**d, "vehicle": vs} for d, vs in zip(documents, located)]
    start_ingest(spark, str(landing.path), store, offsets, period=None, max_files=3).awaitTermination()
    found = PositionLog(spark, store).positions().select(*FEED_FIELDS)
    if new_checkpoint:
        found = found.filter("lat IS NOT NULL")
    wanted = Counter(row[:-1] for row in model(documents).elements())
    assert Counter(tuple(r) for r in found.collect()) == wanted


# --- another rule ---


def consecutive_model(documents):
    """One payload after the other: rows elsewhere than in the last payload that located the vehicle."""
    last, rows = {}, []
    for n, document in enumerate(documents):
        fresh = {tuple(v.get(f) for f in FEED_FIELDS) for v in document["vehicle"]}
        now = {}
        for row in fresh:
            name, *place = (row[FEED_FIELDS.index(k)] for k in dedup.POSITION_KEY)
            if None in (name, *place):
                rows.append((*row, n))
                continue
            if tuple(place) not in last.get(name, ()):
                rows.append((*row, n))
            now.setdefault(name, set()).add(tuple(place))
        last.update(now)
    return Counter(rows)


@pytest.mark.parametrize("seed", range(3))
def test_consecutive_rule_equals_the_model(spark, seed):
    documents = random_feed(seed, batches=20, vehicles=3)
    found = Counter(tuple(r) for r in dedup.consecutive(log_frame(spark, documents)).collect())
    assert found == consecutive_model(documents)
    assert found != model(documents)


# --- merged keys ---


def test_compacted_keys_change_nothing(spark, landing, log):
    documents = random_feed(11, batches=6)
    for n, document in enumerate(documents):
        write(spark, landing, log, document)
        if n in (2, 4):
            log.compact_keys(n)
            log.compact_keys(n)
    wanted = Counter(row[:-1] for row in model(documents).elements())
    assert Counter(tuple(r) for r in log.positions().select(*FEED_FIELDS).collect()) == wanted
    assert set(map(tuple, log.known_keys(99).collect())) == set(
        map(tuple, log.positions().select(*dedup.POSITION_KEY).dropna().collect())
    )


def test_merging_leaves_one_part_of_keys(spark, landing, log):
    for n in range(5):
        write(spark, landing, log, document(str(n)))
        if n in (1, 3):
            log.compact_keys(n)
    assert [p.name for p in Path(log.keys.recent).glob("run_id=0/batch_id=*")] == ["batch_id=4"]
    assert len(list(Path(log.keys.merged).glob("part=*"))) == 2
    assert log.known_keys(5).count() == 5


def test_cut_off_merge_is_ignored_and_repeated(spark, landing, log):
    write(spark, landing, log, document("1"))
    (Path(log.keys.merged) / "part=left" / "bucket=3").mkdir(parents=True)
    assert write(spark, landing, log, document("1")).inserted == 0
    log.compact_keys(0)
    assert log.keys.manifest.newest()[1]["through"] == {"0": 0}
    assert write(spark, landing, log, document("1", "2")).inserted == 1


def test_a_batch_reads_only_its_buckets(spark, landing, log):
    for n in range(3):
        write(spark, landing, log, document(*[str(100 * n + k) for k in range(60)]))
        log.compact_keys(n)
    asked = spark.createDataFrame([("7",), ("111",)], "id string").select(bucket_of(F.col("id"), log.keys.buckets))
    wanted = {r[0] for r in asked.collect()}
    known = log.keys.known(9, "0", wanted)
    read = {int(re.search(r"bucket=(\d+)", f)[1]) for f in known.inputFiles()}
    assert read == wanted and known.count() < 40
    assert "bucket=" in known._jdf.queryExecution().executedPlan().toString()
    assert {"7", "111"} <= {r.id for r in known.collect()}
    before = log.positions().count()
    counts = write(spark, landing, log, document("7", ("111", {"lat": "44.9"}), "new"))
    assert counts == Inserted(3, 2) and log.positions().count() == before + 2


def test_buckets_are_merged_one_by_one(spark, folder):
    """However many batches are merged, a bucket lies in a bounded number of parts, and no key is lost."""
    store = KeyStore(spark, folder, buckets=4, most_parts=2)
    rows = [(f"v{n % 5}", f"44.{n}", "-78.1") for n in range(40)]
    for n in range(10):
        store.add(spark.createDataFrame([*rows[4 * n : 4 * n + 4], (None, "1", "1")], "id string, lat string, lon string"), n, "r")
        store.merge(n, "r")
    parts = store.manifest.newest()[1]["parts"]
    held = Counter(bucket for buckets in parts.values() for bucket in buckets)
    assert max(held.values()) <= 2 and store.runs() == ["r"]
    assert sorted(map(tuple, store.known(99, "r").collect())) == sorted(rows)
    on_disk = Counter(p.name for p in Path(store.merged).glob("part=*/bucket=*") if list(p.glob("*.parquet")))
    assert on_disk == Counter({f"bucket={b}": n for b, n in held.items()})


# --- merged dates ---


def test_a_date_stays_a_few_folders(spark, landing, log):
    """Minute batches over five days: merged dates are one part, and the newest ones a few."""
    documents = []
    for n in range(18):
        documents.append(document(str(n % 7), ("8", {"lat": f"44.{n}"}), minute=n * 400))
        write(spark, landing, log, documents[-1])
        if n % 6 == 5:
            log.compact_keys(n)
            log.merge_dates(n)
    dates = log.manifest.newest()[1]["dates"]
    assert len(dates) == 6 and all(len(dates[day]) == 1 for day in sorted(dates)[:-2])
    stored = log.stored()
    assert stored.schema == STORED_POSITIONS
    wanted = Counter(row[:-1] for row in model(documents).elements())
    assert Counter(tuple(r) for r in stored.select(*FEED_FIELDS).collect()) == wanted
    assert {r.batch_id for r in stored.collect()} == set(range(18))
    assert len({f.rsplit("/", 1)[0] for f in stored.inputFiles() if "_merged/" in f}) <= 6 + 3
    newest = stored.agg(F.max("api_timestamp")).first()[0]
    recent = log.recent(timedelta(hours=5), newest)
    assert recent.count() == stored.filter(F.col("api_timestamp") >= newest - timedelta(hours=5)).count()
    assert len({re.search(r"event_date=([^/]*)", f)[1] for f in recent.inputFiles()}) <= 2


def test_readers_go_on_while_dates_are_merged(spark, landing, log):
    for n in range(4):
        write(spark, landing, log, document(str(n), minute=n))
    planned = log.stored()
    wanted = sorted(r.id for r in planned.collect())
    planned = log.stored()
    log.merge_dates(1)
    between = log.stored()
    assert sorted(r.id for r in planned.collect()) == sorted(r.id for r in between.collect()) == wanted
    again = log.stored()
    log.merge_dates(3)
    assert sorted(r.id for r in again.collect()) == sorted(r.id for r in log.stored().collect()) == wanted
    write(spark, landing, log, document("9", minute=9))
    log.merge_dates(4)
    # What the first two merges replaced is gone, and nothing counts twice.
    assert not list(Path(log.path).glob("event_date=*/run_id=0/batch_id=[01]"))
    assert sorted(r.id for r in log.stored().collect()) == [*wanted, "9"]


def test_late_rows_join_their_closed_date(spark, landing, log):
    for n, minute in enumerate((0, 1440, 2880, 4320, 5)):
        write(spark, landing, log, document(str(n), minute=minute))
        log.merge_dates(n)
    dates = log.manifest.newest()[1]["dates"]
    assert [len(dates[day]) for day in sorted(dates)][0] == 1
    assert sorted(r.id for r in log.stored().collect()) == ["0", "1", "2", "3", "4"]


def test_two_writers_of_one_manifest_conflict(spark, folder):
    one, other = Manifest(spark, folder), Manifest(spark, folder)
    one.replace(0, {"a": 1})
    with pytest.raises(FileExistsError):
        other.replace(0, {"a": 2})
    for n in range(1, 6):
        other.replace(n, {"a": n})
    assert one.newest() == (6, {"a": 5})
    assert len(list(Path(folder).glob("v*.json"))) == 3


def test_only_recent_dates_are_listed(spark, landing, log):
    for n in range(3):
        write(spark, landing, log, document(str(n), minute=n * 1440))
    dates = [r.event_date for r in log.stored().select("event_date").orderBy("event_date").collect()]
    recent = log.stored(since=dates[1])
    assert sorted(r.id for r in recent.collect()) == ["1", "2"]
    assert all("event_date=" + dates[0].isoformat() not in f for f in recent.inputFiles())
    assert log.stored(since=dates[2].replace(year=2030)).count() == 0


def test_batch_runs_again_after_later_compaction(spark, landing, log):
    write(spark, landing, log, document("1"))
    path = landing.add(document("2"))
    store_batch(log, feed.read_payloads(spark, path), 1)
    log.compact_keys(0)
    assert store_batch(log, feed.read_payloads(spark, path), 1).inserted == 1
    assert log.positions().count() == 2


# --- runs and malformed payloads ---


def ingest(spark, landing, folder, checkpoint, **options):
    reports = {}
    start_ingest(
        spark,
        str(landing.path),
        folder + "_store",
        folder + checkpoint,
        period=None,
        report=lambda n, counts: reports.update({n: counts}),
        **options,
    ).awaitTermination()
    return reports


def test_a_new_checkpoint_overwrites_nothing(spark, landing, folder):
    landing.add(document("1"))
    landing.add(document("2", ("1", {"lat": "44.2"})))
    ingest(spark, landing, folder, "_first", max_files=1)
    landing.add(document("3", "1"))
    reports = ingest(spark, landing, folder, "_second", max_files=1)
    stored = PositionLog(spark, folder + "_store").positions()
    assert Counter((r.id, r.lat) for r in stored.collect()) == Counter(
        [("1", USUAL["lat"]), ("2", USUAL["lat"]), ("1", "44.2"), ("3", USUAL["lat"])]
    )
    assert [reports[n].inserted for n in range(3)] == [0, 0, 1]


def test_compaction_runs_in_the_stream(spark, landing, folder):
    for n in range(5):
        landing.add(document(str(n)))
    ingest(spark, landing, folder, "_offsets", max_files=1, compact_every=2)
    log = PositionLog(spark, folder + "_store")
    assert log.known_keys(99).count() == log.positions().count() == 5
    assert list(log.keys.manifest.newest()[1]["through"].values()) == [3]
    assert list(log.manifest.newest()[1]["through"].values()) == [3]


def test_malformed_payloads_are_kept_and_counted(spark, landing, folder):
    landing.add(document("1"))
    cut = json.dumps(document("2"))[:-7]
    (landing.path / "cut.json").write_text(cut)
    (landing.path / "indented.json").write_text(json.dumps(document("3"), indent=2))
    reports = ingest(spark, landing, folder, "_offsets")
    assert (reports[0].received, reports[0].inserted, reports[0].malformed) == (2, 2, 1)
    log = PositionLog(spark, folder + "_store")
    assert [r.value for r in spark.read.parquet(log.rejected_path).collect()] == [cut]


def test_malformed_payloads_can_fail_the_batch(spark, landing, folder):
    landing.add(document("1"))
    broken = landing.path / "broken.json"
    broken.write_text("{")
    with pytest.raises(Exception, match="cannot be read"):
        ingest(spark, landing, folder, "_offsets", on_malformed="fail")
    assert PositionLog(spark, folder + "_store").positions().count() == 0
    broken.write_text(json.dumps(document("2")))
    assert ingest(spark, landing, folder, "_offsets", on_malformed="fail")[0].inserted == 2


def test_payloads_of_one_file_and_time_count_one_after_the_other(spark, folder, log):
    texts = [json.dumps(document(("1", {"heading": h}))) for h in ("10", "20")]
    rows = [(text, "2024-05-06 01:00:00", n) for n, text in enumerate(texts)]
    frame = spark.createDataFrame(rows, "value string, fetched_at string, sequence long").coalesce(1)
    feed.land_payloads(frame.withColumn("fetched_at", F.col("fetched_at").cast("timestamp")), folder)
    assert store_batch(log, feed.read_payloads(spark, folder, landed=True), 0) == Inserted(2, 1)
    assert [r.heading for r in log.positions().collect()] == ["10"]


def test_recent_rows_read_recent_dates_only(spark, landing, log):
    for n in range(3):
        write(spark, landing, log, document(str(n), minute=n * 1440))
    newest = log.positions().agg(F.max("api_timestamp")).first()[0]
    recent = log.recent(timedelta(seconds=60), newest)
    assert [r.id for r in recent.collect()] == ["2"]
    assert len(recent.select("event_date").inputFiles()) == 1
