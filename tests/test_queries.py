from __future__ import annotations

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from fleetgrid.functions.geometry import coordinate
from fleetgrid.operators.lines import ordered_lines
from fleetgrid.plans import queries as q
from fleetgrid.schema import POSITIONS, SHAPES_FILE, STOPS_FILE
from samples import NOW, position

FIVE_MINUTES = timedelta(seconds=300)


def by_id(df):
    return {row["id"]: row for row in df.collect()}


def test_newest_position_per_vehicle(vehicles):
    found = by_id(q.current_locations(vehicles, FIVE_MINUTES, NOW))
    assert sorted(found) == ["bus-a", "bus-b"]
    assert found["bus-a"].lat == "44.52"
    assert found["bus-a"].geometry.type == "Point"
    assert found["bus-a"].geometry.coordinates == [-78.77, 44.52]


def test_only_the_last_minute_counts_by_default(vehicles):
    assert list(by_id(q.current_locations(vehicles, as_of=NOW))) == ["bus-a"]


def test_look_back_includes_its_bound(vehicles):
    assert sorted(by_id(q.current_locations(vehicles, timedelta(seconds=130), NOW))) == ["bus-a", "bus-b"]


def test_no_rows_in_the_window(vehicles):
    assert q.current_locations(vehicles, as_of=NOW + timedelta(days=1)).count() == 0
    assert q.current_paths(vehicles, as_of=NOW + timedelta(days=1)).count() == 0


def test_current_time_is_the_default(spark, vehicles):
    fresh = vehicles.withColumn("api_timestamp", F.current_timestamp())
    assert q.current_locations(fresh).count() == 2
    assert q.current_locations(vehicles).count() == 0


def test_equal_times_give_one_row_and_the_same_one(spark):
    rows = [position("v", 5, f"43.{i}", "-79.1", heading=str(i)) for i in range(20)]
    for order in (rows, rows[::-1]):
        frame = spark.createDataFrame(order, POSITIONS).repartition(4)
        found = q.current_locations(frame, as_of=NOW).collect()
        assert [r.lat for r in found] == ["43.9"]


def test_position_without_numbers_has_no_geometry(spark):
    rows = [position("v", 5, None, "-79.1"), position("w", 5, "x", "-79.1")]
    found = q.current_locations(spark.createDataFrame(rows, POSITIONS), as_of=NOW)
    assert {r.id: r.geometry for r in found.collect()} == {"v": None, "w": None}


def test_paths(vehicles):
    found = by_id(q.current_paths(vehicles, FIVE_MINUTES, NOW))
    one = found["bus-a"]
    assert one.geometry.type == "LineString"
    assert one.geometry.coordinates == [[-78.9, 44.4], [-78.81, 44.48], [-78.77, 44.52]]
    assert one.avgSpeedKmHr == pytest.approx(24.0)
    assert one.lastHeading == "310"
    assert found["bus-b"].geometry.coordinates == [[-78.2, 44.1], [-78.26, 44.16]]
    assert (one.part, one.n_points) == (0, 3)


def test_path_needs_two_points(vehicles):
    assert list(by_id(q.current_paths(vehicles, timedelta(seconds=125), NOW))) == ["bus-a"]


def test_last_heading_may_be_unknown(spark):
    rows = [position("v", 9, "43.1", "-79.1"), position("v", 5, "43.2", "-79.2", heading=None)]
    frame = spark.createDataFrame(rows, POSITIONS)
    assert q.current_paths(frame, as_of=NOW).first().lastHeading is None
    assert q.vehicle_markers(frame, as_of=NOW).first().marker == "dot"


def test_bad_speed_is_left_out_of_the_mean(spark):
    rows = [
        position("v", 9, "43.1", "-79.1", speedKmHr="30"),
        position("v", 7, "43.2", "-79.2", speedKmHr="n/a"),
        position("v", 5, "43.3", "-79.3", speedKmHr=None),
    ]
    assert q.current_paths(spark.createDataFrame(rows, POSITIONS), as_of=NOW).first().avgSpeedKmHr == 30.0


def test_unlocated_rows_add_no_point(spark):
    rows = [
        position("v", 9, "43.1", "-79.1", speedKmHr="10"),
        position("v", 7, None, "-79.2", speedKmHr="20"),
        position("v", 5, "43.3", "-79.3", speedKmHr="30"),
        position("w", 5, "43.3", "-79.3"),
        position("w", 5, None, None),
    ]
    frame = spark.createDataFrame(rows, POSITIONS)
    found = by_id(q.current_paths(frame, as_of=NOW))
    assert list(found) == ["v"]
    assert found["v"].geometry.coordinates == [[-79.1, 43.1], [-79.3, 43.3]]
    assert found["v"].avgSpeedKmHr == 20.0
    split = by_id(q.current_paths(frame, as_of=NOW, line_points=2))
    assert split["v"].geometry.coordinates == found["v"].geometry.coordinates


def long_path(spark, points=53):
    rows = [
        position("hot", i + 1, f"43.{1000 + i}", f"-79.{1000 + i}", heading=str(i), speedKmHr=str(i))
        for i in range(points)
    ]
    rows += [position("cold", i, f"43.{i}", "-79.5") for i in (1, 2)]
    return spark.createDataFrame(rows, POSITIONS).repartition(4)


@pytest.mark.parametrize("line_points", [2, 7, 10, 13, 26, 52, 53])
def test_long_paths_come_in_parts_that_join_to_the_whole(spark, line_points):
    rows = long_path(spark)
    whole = by_id(q.current_paths(rows, FIVE_MINUTES, NOW))
    parts = q.current_paths(rows, FIVE_MINUTES, NOW, line_points=line_points).collect()
    hot = sorted((p for p in parts if p.id == "hot"), key=lambda p: p.part)
    assert [p.part for p in hot] == list(range(len(hot)))
    joined = list(hot[0].geometry.coordinates)
    for part in hot[1:]:
        assert part.start == len(joined) - 1
        assert part.geometry.coordinates[0] == joined[-1]
        joined += part.geometry.coordinates[1:]
    assert joined == whole["hot"].geometry.coordinates
    assert all(len(p.geometry.coordinates) in range(2, line_points + 2) for p in hot)
    assert {(p.n_points, p.avgSpeedKmHr, p.lastHeading) for p in hot} == {(53, 26.0, "0")}
    cold = [p for p in parts if p.id == "cold"]
    assert [p.geometry.coordinates for p in cold] == [whole["cold"].geometry.coordinates]


def test_long_lines_of_a_null_key(spark):
    frame = spark.createDataFrame([(None, i) for i in range(9)] + [("a", 1)], "k string, n int")
    lines = ordered_lines(frame, "k", ["n"], F.array(F.col("n").cast("double")), line_points=4)
    found = {(r.k, r.part): [p[0] for p in r.points] for r in lines.collect()}
    assert found == {
        (None, 0): [0, 1, 2, 3, 4],
        (None, 1): [4, 5, 6, 7, 8],
        ("a", 0): [1],
    }


def test_long_line_without_located_points_stays(spark):
    frame = spark.createDataFrame([("a", None)] * 9 + [("b", 1.0)], "k string, n double")
    xy = F.when(F.col("n").isNotNull(), F.array("n"))
    for limit in (4, 100):
        lines = ordered_lines(frame, "k", ["n"], xy, line_points=limit)
        found = {r.k: (r.part, r.parts, r.start, r.n_points, r.points) for r in lines.collect()}
        assert found == {"a": (0, 1, 0, 0, []), "b": (0, 1, 0, 1, [[1.0]])}


def test_markers_are_the_last_points_of_paths(spark, vehicles):
    paths = by_id(q.current_paths(vehicles, FIVE_MINUTES, NOW))
    for row in q.vehicle_markers(vehicles, FIVE_MINUTES, NOW).collect():
        assert [row.lon, row.lat] == paths[row.id].geometry.coordinates[-1]
        assert row.avgSpeedKmHr == pytest.approx(paths[row.id].avgSpeedKmHr)
        assert row.marker == "arrow"


def test_speed_map_groups_by_cell_and_hour(spark):
    rows = [
        position("v", 60, "43.6500", "-79.3800", speedKmHr="10"),
        position("w", 120, "43.6501", "-79.3801", speedKmHr="20"),
        position("w", 4000, "43.6501", "-79.3801", speedKmHr="90"),
        position("w", 60, "43.7500", "-79.3800", speedKmHr="40"),
        position("w", 91 * 86400, "43.65", "-79.38", speedKmHr="70"),
    ]
    frame = spark.createDataFrame(rows, POSITIONS)
    as_of = NOW + timedelta(minutes=10)
    moved = frame.withColumn("api_timestamp", F.expr("api_timestamp + INTERVAL 10 MINUTES"))
    found = {
        (r.hex_id, r.hour_of_day): (r.speed, r.num_observations)
        for r in q.avg_speeds(moved, as_of=as_of).collect()
    }
    assert found[("0_0", 12)] == (15.0, 2)
    assert found[("0_0", 11)] == (90.0, 1)
    assert len(found) == 3
    hour = q.avg_speeds_hour(moved, as_of=as_of).collect()
    assert {r.hour_of_day for r in hour} == {12}
    assert sorted(r.speed for r in hour) == [15.0, 40.0]
    ring = next(r for r in hour if r.hex_id == "0_0").geometry.coordinates[0]
    assert len(ring) == 7 and ring[0] == ring[6]


def stop(number, name, lat=44.375, lon=-78.625):
    row = {n: None for n in STOPS_FILE.names}
    row.update(stop_id=number, stop_name=name, stop_lat=lat, stop_lon=lon)
    return tuple(row[n] for n in STOPS_FILE.names)


def test_stops(spark):
    names = [
        "King St at Bay",
        "KING ST AT York St",
        "king st at Bay North",
        "Queen",
        "King St W",
        "King St At Jarvis St E",
    ]
    rows = [stop(str(1000 + i), name) for i, name in enumerate(names)]
    table = q.build_stops(spark.createDataFrame(rows, STOPS_FILE))
    assert table.first().coords.coordinates == [-78.625, 44.375]
    assert "stop_lat" not in table.columns
    found = {r.stop_name: r.label_direction for r in q.stops(table).collect()}
    # The prefix "king st at" is shared; shorter names come first.
    assert found["King St at Bay"] == 0
    assert found["KING ST AT York St"] == 1
    assert found["king st at Bay North"] == 2
    assert found["King St At Jarvis St E"] == 3
    assert found["Queen"] == found["King St W"] == 0


def test_label_direction_of_a_hot_name_equals_the_window(spark):
    rows = [stop(str(i), "Main street" + "x" * (i % 3)) for i in range(97)] + [stop("a", "Queen")]
    table = q.build_stops(spark.createDataFrame(rows, STOPS_FILE).repartition(4))
    window = {r.stop_id: r.label_direction for r in q.stops(table).collect()}
    spread = {r.stop_id: r.label_direction for r in q.stops(table, group_rows=10).collect()}
    assert spread == window
    assert len(window) == 98


def shape(name, points):
    return [(name, lat, lon, n) for n, (lon, lat) in points]


def test_routes_are_built_in_sequence_order_and_simplified(spark):
    straight = [(4, (-78.5, 44.25)), (8, (-78.375, 44.0)), (6, (-78.4375, 44.125)), (5, (-78.46875, 44.1875))]
    bent = [(1, (0.0, 0.0)), (2, (1.0, 1.0)), (3, (2.0, 0.0)), (4, (3.0, 0.00005)), (5, (4.0, 0.0))]
    rows = shape("straight", straight) + shape("bent", bent)
    table = q.build_routes(spark.createDataFrame(rows, SHAPES_FILE))
    built = {r.shape_id: r.points for r in table.collect()}
    assert built["straight"] == [[-78.5, 44.25], [-78.46875, 44.1875], [-78.4375, 44.125], [-78.375, 44.0]]
    found = {r.shape_id: r.geometry.coordinates for r in q.routes(table).collect()}
    assert found["straight"] == [[-78.5, 44.25], [-78.375, 44.0]]
    assert found["bent"] == [[0.0, 0.0], [1.0, 1.0], [2.0, 0.0], [4.0, 0.0]]


@pytest.mark.parametrize("line_points", [4, 9, 40])
def test_long_routes_simplify_like_short_ones(spark, line_points):
    from random import Random

    random = Random(5)
    rows = []
    for name, size in (("a", 37), ("b", 38), ("c", 3), ("loop", 41)):
        x = y = 0.0
        points = []
        for n in range(size):
            x, y = x + random.uniform(0, 1), y + random.uniform(-1, 1)
            points.append((n, (x, y)))
        if name == "loop":
            points[-1] = (size - 1, points[0][1])
        rows += shape(name, points)
    frame = spark.createDataFrame(rows, SHAPES_FILE).repartition(3)
    whole = {
        r.shape_id: r.geometry.coordinates
        for r in q.routes(q.build_routes(frame), tolerance=0.7).collect()
    }
    table = q.build_routes(frame, line_points=line_points)
    parts = q.routes(table, tolerance=0.7, line_points=line_points).collect()
    joined = {}
    for part in sorted(parts, key=lambda p: p.part):
        line = joined.setdefault(part.shape_id, [])
        line += part.geometry.coordinates[1:] if line else part.geometry.coordinates
    assert joined == whole
    assert 2 < len(whole["a"]) < 37


def test_coordinate_is_null_unless_both_are_numbers(spark):
    rows = [("-79.1", "43.1"), ("x", "43.1"), (None, "43.1")]
    frame = spark.createDataFrame(rows, "lon string, lat string")
    got = [r[0] for r in frame.select(coordinate(F.col("lon"), F.col("lat"))).collect()]
    assert got == [[-79.1, 43.1], None, None]


def test_as_of_works_for_both_timestamp_types(vehicles):
    plain = vehicles.withColumn("api_timestamp", F.col("api_timestamp").cast("timestamp_ntz"))
    for frame in (vehicles, plain):
        assert q.current_locations(frame, FIVE_MINUTES, datetime(2024, 5, 6, 12)).count() == 2


def test_rows_after_a_past_moment_do_not_count(vehicles):
    past = NOW - timedelta(seconds=60)
    found = by_id(q.current_locations(vehicles, FIVE_MINUTES, past))
    assert found["bus-a"].lat == "44.48" and found["bus-b"].lat == "44.16"
    path = by_id(q.current_paths(vehicles, FIVE_MINUTES, past))["bus-a"]
    assert path.geometry.coordinates == [[-78.9, 44.4], [-78.81, 44.48]] and path.lastHeading == "200"
    assert list(by_id(q.current_locations(vehicles, timedelta(seconds=30), past))) == ["bus-a"]


def test_a_moment_with_a_zone_is_converted(spark, vehicles):
    there = NOW.replace(tzinfo=timezone.utc).astimezone(timezone(timedelta(hours=-5)))
    assert by_id(q.current_locations(vehicles, as_of=there)).keys() == {"bus-a"}
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert by_id(q.current_locations(vehicles, as_of=there)).keys() == {"bus-a"}
        assert q.current_locations(vehicles, as_of=NOW).count() == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_line_rows_have_one_form_at_every_size(spark):
    rows = spark.createDataFrame(shape("s", [(n, (n * 0.5, float(n % 2))) for n in range(9)]), SHAPES_FILE)
    found = []
    for limit in (3, 100):
        table = q.build_routes(rows, line_points=limit)
        found.append((table.dtypes, q.routes(table, 0.0, limit).dtypes))
        parts = sorted(q.routes(table, 0.0, limit).collect(), key=lambda r: r.part)
        line = [xy for r in parts for xy in (r.geometry.coordinates[1:] if r.part else r.geometry.coordinates)]
        assert line == [[n * 0.5, float(n % 2)] for n in range(9)]
        assert {r.parts for r in parts} == {len(parts)}
    assert found[0] == found[1]
