from __future__ import annotations

import csv
import io
import json
import zipfile
from datetime import date
from pathlib import Path

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetgrid.plans import queries as q
from fleetgrid.schema import POSITIONS, SHAPES_FILE, STOPS_FILE
from fleetgrid.sources import archive, catalogue, files, snapshot


def write_zip(path, members):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as target:
        for name, text in members.items():
            target.writestr(name, text)


STOPS = (
    "﻿stop_id,stop_name,stop_lat,stop_lon,location_type,extra\n"
    '001,"King St, at Bay",44.375,-78.625,0,x\n'
    '2,"two\nlines",44.5,-78.75,,y\n'
    "t_3,,bad,-79.4,1,z\n"
)
SHAPES = "shape_id,shape_pt_lat,shape_pt_lon,shape_pt_sequence\n" + "".join(
    f"{'9' if i < 600 else 'loop north'},43.{i},-79.{i},{i}\n" for i in range(700)
)


@pytest.fixture
def archives(spark, folder):
    Path(folder).mkdir()
    write_zip(f"{folder}/a.zip", {"stops.txt": STOPS, "shapes.txt": SHAPES})
    write_zip(f"{folder}/b.zip", {"more/": "", "stops.txt": "stop_id,stop_lat\n77,44.0\n", "more/none.txt": ""})
    return archive.read_archives(spark, folder)


@pytest.fixture
def unpacked(archives):
    return archive.unpack(archives)


def test_members_and_their_tables(unpacked):
    found = {(r.path.rsplit("/", 1)[1], r.member): r for r in archive.list_members(unpacked).collect()}
    assert sorted(found) == [("a.zip", "shapes.txt"), ("a.zip", "stops.txt"), ("b.zip", "more/none.txt"), ("b.zip", "stops.txt")]
    assert found[("a.zip", "shapes.txt")].table_name == "ttc_shapes"
    assert found[("b.zip", "stops.txt")].columns == ["stop_id", "stop_lat"]
    empty = found[("b.zip", "more/none.txt")]
    assert (empty.table_name, empty.columns) == ("ttc_none", [])
    assert archive.read_member(unpacked, "more/none.txt", SHAPES_FILE).count() == 0


def test_archives_load_into_tables(spark, archives, folder):
    names = archive.load_archives(archives, folder + "_tables")
    assert names == ["ttc_shapes", "ttc_stops"]
    stops = spark.read.parquet(folder + "_tables/ttc_stops")
    assert stops.count() == 4 and dict(stops.dtypes)["stop_lat"] == "double"
    assert q.stops(q.build_stops(stops)).count() == 4
    table = q.build_routes(spark.read.parquet(folder + "_tables/ttc_shapes"))
    assert {r.shape_id: r.n_points for r in table.collect()} == {"9": 600, "loop north": 100}


def test_members_of_one_table_are_loaded_together(spark, folder):
    Path(folder).mkdir()
    write_zip(f"{folder}/a.zip", {"a/stops.txt": "stop_id,stop_lat\n1,44.0\n", "b/stops.txt": "stop_id,stop_lon\n02,-79\n"})
    write_zip(f"{folder}/b.zip", {"stops.txt": "stop_id,stop_lat\n3,45.0\n", "x/fares.txt": "fare\n7\n", "fares.txt": "fare,zone\nfree,A\n"})
    names = archive.load_archives(archive.read_archives(spark, folder), folder + "_tables")
    assert names == ["ttc_fares", "ttc_stops"]
    stops = spark.read.parquet(folder + "_tables/ttc_stops")
    assert dict(stops.dtypes)["location_type"] == "int"
    assert sorted((r.stop_id, r.stop_lat, r.stop_lon) for r in stops.collect()) == [("02", None, -79.0), ("1", 44.0, None), ("3", 45.0, None)]
    fares = spark.read.parquet(folder + "_tables/ttc_fares")
    assert sorted((r.fare, r.zone) for r in fares.collect()) == [("7", None), ("free", "A")]


def test_member_with_declared_types(unpacked):
    rows = archive.read_member(unpacked, "stops.txt", STOPS_FILE)
    assert rows.schema == STOPS_FILE
    found = {r.stop_id: r for r in rows.collect()}
    assert found["001"].stop_name == "King St, at Bay"
    assert found["2"].stop_name == "two\nlines"
    assert (found["2"].location_type, found["001"].location_type) == (None, 0)
    assert (found["t_3"].stop_lat, found["t_3"].stop_name, found["t_3"].stop_url) == (None, None, None)
    assert (found["77"].stop_lat, found["77"].stop_lon) == (44.0, None)


def test_late_text_keeps_a_column_text(unpacked):
    rows = archive.read_member_inferred(unpacked, "shapes.txt")
    kinds = dict(rows.dtypes)
    assert kinds == {
        "shape_id": "string",
        "shape_pt_lat": "double",
        "shape_pt_lon": "double",
        "shape_pt_sequence": "bigint",
    }
    assert rows.count() == 700


def test_missing_member(unpacked):
    assert archive.read_member(unpacked, "routes.txt", SHAPES_FILE).count() == 0
    with pytest.raises(ValueError, match=r"routes\.txt"):
        archive.read_member_inferred(unpacked, "routes.txt")


def test_archive_to_routes(unpacked):
    table = q.build_routes(archive.read_member(unpacked, "shapes.txt", SHAPES_FILE))
    assert {r.shape_id: len(r.points) for r in table.collect()} == {"9": 600, "loop north": 100}


def test_each_archive_is_opened_once_per_load(spark, archives, folder):
    opened = spark.sparkContext.accumulator(0)

    def tap(batches):
        for batch in batches:
            opened.add(batch.num_rows)
            yield batch

    tapped = archives.mapInArrow(tap, archives.schema)
    assert archive.load_archives(tapped, folder + "_tables") == ["ttc_shapes", "ttc_stops"]
    assert opened.value == 2


def test_large_members_are_split(spark, folder):
    """Quoted line feeds, carriage returns and quotes across the blocks and splits that a member is cut into."""
    Path(folder).mkdir()
    rows = [(str(i), f'say "{i}"\nand, more' if i % 7 == 0 else f"row {i}", "é" * (i % 5), "") for i in range(4000)]
    text = io.StringIO()
    writer = csv.writer(text, lineterminator="\r\n")
    writer.writerows([("a", "b", "c", "A"), *rows])
    write_zip(f"{folder}/t.zip", {"t.txt": text.getvalue()})
    unpacked = archive.unpack(archive.read_archives(spark, folder))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        read = unpacked.text_member("t.txt", ["b", "c", "a", "A_3", "absent"])
        assert read.rdd.getNumPartitions() > 10
        got = sorted(read.collect(), key=lambda r: int(r.a))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.a, r.b, r.c or "", r.A_3, r.absent) for r in got] == [(a, b, c, None, None) for a, b, c, _ in rows]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_pieces_hold_whole_records(monkeypatch, size):
    monkeypatch.setattr(archive, "BLOCK_BYTES", size)
    text = 'a,b\r\n1,"x\ny"\r\n2,"q ""\n"" r"\n\n3,z'
    pieces = list(archive.record_pieces(io.BytesIO(b"\xef\xbb\xbf" * (size > 2) + text.encode())))
    assert archive.RECORD.join(pieces).split(archive.RECORD) == [b"a,b", b'1,"x\ny"', b'2,"q ""\n"" r"', b"", b"3,z"]
    monkeypatch.setattr(archive, "RECORD_BYTES", 20)
    with pytest.raises(ValueError, match="more than 20 bytes"):
        list(archive.record_pieces(io.BytesIO(b'"' + b"x" * 4000)))


def test_members_with_one_name_are_all_loaded(spark, folder):
    Path(folder).mkdir()
    with pytest.warns(UserWarning, match="Duplicate name"), zipfile.ZipFile(f"{folder}/a.zip", "w") as target:
        for text in ("Stop_ID,stop_lat\n1,44.0\n", "stop_lat,stop_id\n45.0,2\n"):
            target.writestr("stops.txt", text)
    archive.load_archives(archive.read_archives(spark, folder), folder + "_tables")
    stops = spark.read.parquet(folder + "_tables/ttc_stops")
    assert sorted((r.stop_id, r.stop_lat) for r in stops.collect()) == [("1", 44.0), ("2", 45.0)]


def test_first_resource_outside_the_datastore(spark, folder):
    Path(folder).mkdir()
    document = {
        "result": {
            "resources": [
                {"id": "a", "datastore_active": True, "url": "http://x/a"},
                {"id": "b", "datastore_active": False, "url": "http://x/b"},
                {"id": "c", "datastore_active": False, "name": "C", "url": "http://x/c"},
            ]
        }
    }
    (Path(folder) / "one.json").write_text(json.dumps(document, indent=2))
    document["result"]["resources"] = document["result"]["resources"][:1]
    (Path(folder) / "two.json").write_text(json.dumps(document))
    found = catalogue.archive_resource(catalogue.read_catalogue(spark, folder)).collect()
    assert [(r.resource_id, r.resource_name, r.url) for r in found] == [("b", "b", "http://x/b")]


def test_missing_table_is_empty_and_other_errors_pass(spark, vehicles):
    empty = files.read_table_or_empty(spark, "nothing_here", POSITIONS)
    assert empty.schema == POSITIONS
    assert q.current_locations(empty).count() == 0
    vehicles.createOrReplaceTempView("vehicles_here")
    assert files.read_table_or_empty(spark, "vehicles_here", POSITIONS).count() == 5
    with pytest.raises(AnalysisException):
        files.read_table_or_empty(spark, "vehicles_here", POSITIONS).select("no_such_column")


def test_replace_table(spark, vehicles):
    files.replace_table(vehicles, "replaced")
    files.replace_table(vehicles.filter("id = 'bus-a'").select("id", "lat"), "replaced")
    assert spark.table("replaced").columns == ["id", "lat"]
    assert spark.table("replaced").count() == 3


def test_one_snapshot_per_day(spark, folder, vehicles):
    day = date(2024, 5, 6)
    assert snapshot.take_snapshot(vehicles, folder, day)
    assert not snapshot.take_snapshot(vehicles.limit(1), folder, day)
    assert snapshot.read_snapshot(vehicles, folder, day).count() == 5
    assert snapshot.take_snapshot(vehicles, folder, date(2024, 5, 7))


def test_cut_off_snapshot_is_written_again(spark, folder, vehicles):
    day = date(2024, 5, 6)
    snapshot.take_snapshot(vehicles.limit(2), folder, day)
    (Path(folder) / "snapshot_date=2024-05-06" / "_SUCCESS").unlink()
    assert snapshot.take_snapshot(vehicles, folder, day)
    assert snapshot.read_snapshot(vehicles, folder, day).count() == 5


def test_snapshot_check(spark, folder, vehicles):
    day = date(2024, 5, 6)
    snapshot.take_snapshot(vehicles, folder, day)
    wanted = vehicles.agg(*[v.alias(n) for n, v in snapshot.content_of(vehicles).items()]).first().asDict()
    snapshot.verify_snapshot(vehicles, folder, day, wanted)
    with pytest.raises(ValueError, match="5 rows"):
        snapshot.verify_snapshot(vehicles, folder, day, {**wanted, "n": 6})
    with pytest.raises(ValueError, match="columns"):
        snapshot.verify_snapshot(vehicles.drop("lat"), folder, day, wanted)


def test_a_flipped_cell_fails_the_snapshot_check(spark, folder, vehicles):
    day = date(2024, 5, 6)
    wanted = vehicles.agg(*[v.alias(n) for n, v in snapshot.content_of(vehicles).items()]).first().asDict()
    flipped = vehicles.withColumn("lat", F.when(F.col("lat") == "44.48", "44.84").otherwise(F.col("lat")))
    moved = vehicles.withColumn("heading", F.lag("heading", 1, "77").over(Window.orderBy("api_timestamp")))
    for n, wrong in enumerate((flipped, moved)):
        wrong.write.parquet(f"{folder}{n}/snapshot_date=2024-05-06")
        with pytest.raises(ValueError, match="other values"):
            snapshot.verify_snapshot(vehicles, f"{folder}{n}", day, wanted)
    assert snapshot.take_snapshot(vehicles.limit(0), folder, day)
