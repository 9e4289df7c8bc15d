from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from fleetgrid.functions.geometry import coordinate, point
from fleetgrid.operators import features, mapprep, numbering, typing


# --- features ---


def located(vehicles):
    shape = point(coordinate(F.col("lon"), F.col("lat")))
    return vehicles.select("id", "heading", "api_timestamp", shape.alias("geometry"))


def test_rows_become_features(vehicles):
    found = [json.loads(r.feature) for r in features.to_features(located(vehicles)).collect()]
    assert len(found) == 5
    one = next(f for f in found if f["properties"]["heading"] == "310")
    assert one["type"] == "Feature"
    assert one["geometry"] == {"type": "Point", "coordinates": [-78.77, 44.52]}
    assert one["properties"] == {
        "id": "bus-a",
        "heading": "310",
        "api_timestamp": "2024-05-06 11:59:40",
    }


def test_geometry_text_goes_in_as_it_is(spark):
    text = '{"type":"LineString","coordinates":[[5.25,51.5],[5.5,51.75],[5.5,52]]}'
    rows = [("ferry", 17.5, text), ("barge", None, None)]
    frame = spark.createDataFrame(rows, "id string, speed double, geometry string")
    found = [r.feature for r in features.to_features(frame).collect()]
    assert [json.loads(f) for f in found] == [
        {"type": "Feature", "geometry": json.loads(text), "properties": {"id": "ferry", "speed": 17.5}}
    ]


def test_null_properties_stay(spark):
    frame = spark.createDataFrame([(None, "{}")], "heading string, geometry string")
    found = features.to_features(frame).first().feature
    assert json.loads(found)["properties"] == {"heading": None}


def test_no_geometry_column_gives_no_features(spark):
    frame = spark.createDataFrame([("q7", "Harbour", 3)], "code string, title string, zone int")
    assert features.to_features(frame).count() == 0


def test_no_properties(spark):
    frame = spark.createDataFrame([("{}",)], "geometry string")
    assert json.loads(features.to_features(frame).first().feature)["properties"] == {}


@pytest.mark.parametrize(("size", "documents"), [(2, 3), (5, 1), (1000, 1)])
def test_documents_hold_all_features_in_order(vehicles, size, documents):
    rows = features.to_features(located(vehicles))
    found = features.feature_documents(rows, size).orderBy("document").collect()
    assert [r.document for r in found] == list(range(documents))
    held = [json.loads(r.geojson) for r in found]
    assert all(d["type"] == "FeatureCollection" and len(d["features"]) <= size for d in held)
    texts = sorted(r.feature for r in rows.collect())
    assert [f for d in held for f in d["features"]] == [json.loads(t) for t in texts]


def test_no_features_are_one_empty_document(vehicles):
    none = features.to_features(located(vehicles).limit(0))
    found = features.feature_documents(none).collect()
    assert [(r.document, json.loads(r.geojson)) for r in found] == [
        (0, {"type": "FeatureCollection", "features": []})
    ]


def test_documents_are_unpacked(spark, vehicles):
    rows = features.to_features(located(vehicles))
    documents = features.feature_documents(rows, 2).select("geojson")
    again = features.to_features(documents.union(spark.createDataFrame([(None,)], "geojson string")))
    wanted = sorted(json.loads(r.feature)["properties"]["heading"] for r in rows.collect())
    assert sorted(json.loads(r.feature)["properties"]["heading"] for r in again.collect()) == wanted


def test_features_are_written_one_per_line(vehicles, folder):
    rows = features.to_features(located(vehicles))
    features.write_features(rows, folder)
    assert rows.sparkSession.read.json(folder).count() == 5


# --- typing ---


def test_numbers_and_rejected_values(spark):
    rows = [("43.1", "90", "true"), ("x", "9.5", "maybe"), (None, None, None)]
    frame = spark.createDataFrame(rows, "lat string, heading string, predictable string")
    found = [tuple(r) for r in typing.typed_view(frame).collect()]
    assert found[0] == (43.1, 90, True, 0)
    assert found[1][0] is None and found[1][2] is None and found[1][3] >= 2
    assert found[2] == (None, None, None, 0)


def test_column_names_compare_without_case(spark):
    frame = spark.createDataFrame([("12.5", "x")], "speedkmhr string, LAT string")
    found = typing.typed_view(frame)
    assert found.dtypes[:2] == [("speedkmhr", "double"), ("LAT", "double")]
    assert tuple(found.first()) == (12.5, None, 1)


def test_inferred_types(spark):
    rows = [
        (str(i), f"{i}.5", "true", str(i), None, str(i) if i % 2 else None, i) for i in range(600)
    ]
    rows.append(("600", "7", "false", "platform B", None, None, 600))
    text = ", ".join(f"{c} string" for c in "abcdef")
    frame = spark.createDataFrame(rows, f"{text}, g int")
    kinds = dict(typing.infer_types(frame).dtypes)
    assert kinds == {
        "a": "bigint",
        "b": "double",
        "c": "boolean",
        "d": "string",
        "e": "string",
        "f": "bigint",
        "g": "int",
    }
    assert typing.infer_types(frame.select("g")).columns == ["g"]


def test_epoch_millis(spark):
    frame = spark.createDataFrame([("1700000000123",), ("x",), (None,)], "t string")
    found = [r[0] for r in frame.select(typing.epoch_millis(F.col("t")).cast("string")).collect()]
    assert found == ["2023-11-14 22:13:20.123", None, None]


# --- numbering ---


def test_overall_numbers_with_copies_and_nulls(spark):
    rows = [(i % 7 if i % 3 else None, "same") for i in range(200)]
    frame = spark.createDataFrame(rows, "n int, s string").repartition(5)
    found = numbering.number_rows(frame, ["n"]).orderBy("row_no").collect()
    assert [r.row_no for r in found] == list(range(200))
    assert [r.n for r in found] == sorted((r[0] for r in rows), key=lambda v: (v is not None, v))


def test_group_numbers_equal_the_window(spark):
    rows = [("hot", i) for i in range(300)]
    rows += [(f"k{i % 20}", i) for i in range(100)] + [(None, i) for i in range(50)]
    frame = spark.createDataFrame(rows, "k string, n int").repartition(6)
    window = set(map(tuple, numbering.number_in_groups(frame, ["k"], ["n"]).collect()))
    spread = set(map(tuple, numbering.number_in_groups(frame, ["k"], ["n"], group_rows=40).collect()))
    direct = set(map(tuple, numbering.number_rows(frame, ["n"], ["k"]).collect()))
    assert len(window) == 450
    assert spread == window == direct


def test_hot_group_is_spread_over_tasks(spark):
    frame = spark.range(20000).select(F.lit("hot").alias("k"), F.lit(1).alias("n"))
    found = numbering.number_rows(frame, ["n"], ["k"])
    summary = found.agg(F.min("row_no"), F.max("row_no"), F.countDistinct("row_no")).first()
    assert tuple(summary) == (0, 19999, 20000)
    spread = spark.range(20000).select(F.lit("hot").alias("k"), F.monotonically_increasing_id().alias("s"))
    parts = spread.repartitionByRange(4, "k", "s").groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) == 4


def test_oversize_groups(spark):
    frame = spark.createDataFrame([("a",)] * 5 + [("b",)] * 2, "k string")
    assert numbering.oversize_groups(frame, ["k"], 5) is None
    assert [tuple(r) for r in numbering.oversize_groups(frame, ["k"], 4).collect()] == [("a", 5)]


# --- map tables ---


@pytest.mark.parametrize(
    ("zoom", "moving", "stride"),
    [
        (1.0, False, None),
        (1.24, True, None),
        (1.25, False, 12),
        (1.99, True, 36),
        (2.0, False, 6),
        (3.0, False, 3),
        (3.9, True, 9),
        (4.0, True, 3),
        (5.0, False, 1),
        (20.0, True, 1),
    ],
)
def test_stride(zoom, moving, stride):
    assert mapprep.stop_stride(zoom, moving) == stride


def test_thinning(spark):
    stops = spark.range(100).select(F.format_string("%03d", "id").alias("stop_id")).repartition(5)
    shown = mapprep.thin_stops(stops, 2.5)
    assert sorted(r.stop_id for r in shown.collect()) == [f"{i:03d}" for i in range(0, 100, 6)]
    assert mapprep.thin_stops(stops, 1.0).count() == 0
    assert mapprep.thin_stops(stops, 9.0).count() == 100


def test_fit_fills_the_canvas(spark):
    rows = [(-79.6, 43.5), (-79.1, 43.5), (-79.1, 43.9), (-79.3, 43.7)]
    placed = mapprep.mercator(spark.createDataFrame(rows, "lon double, lat double"))
    canvas = mapprep.Canvas(500, 900, 10, 20, 30, 40)
    shown = mapprep.to_canvas(placed, mapprep.fit(mapprep.extent(placed), canvas)).collect()
    xs, ys = [r.px for r in shown], [r.py for r in shown]
    assert min(xs) == pytest.approx(40) and max(xs) == pytest.approx(480)
    assert (min(ys) + max(ys)) / 2 == pytest.approx((10 + 870) / 2)
    assert 10 <= min(ys) and max(ys) <= 870
    north = min(shown, key=lambda r: r.py)
    assert north.lat == 43.9


def test_fit_of_one_place(spark):
    placed = mapprep.mercator(spark.createDataFrame([(-79.6, 43.5)], "lon double, lat double"))
    row = mapprep.to_canvas(placed, mapprep.fit(mapprep.extent(placed))).first()
    assert (row.px, row.py) == (pytest.approx(500), pytest.approx(400))


@pytest.mark.parametrize(
    ("speed", "band", "place"),
    [
        (None, 0, 0.0),
        (-3.0, 0, 0.0),
        (2.5, 0, 0.5),
        (5.0, 1, 0.0),
        (10.0, 1, 0.5),
        (15.0, 2, 0.0),
        (40.0, 3, 0.5),
        (50.0, 3, 1.0),
        (80.0, 3, 1.0),
    ],
)
def test_speed_scale(spark, speed, band, place):
    scaled = mapprep.speed_scale(F.lit(speed).cast("double"))
    row = spark.range(1).select(*[c.alias(n) for n, c in scaled.items()]).first()
    assert (row.speed_band, row.speed_place) == (band, pytest.approx(place))


def test_labels_have_defaults(spark):
    schema = "stop_id string, stop_name string, label_direction int"
    frame = spark.createDataFrame([("1", None, None), ("2", "Bay", 3)], schema)
    assert [tuple(r) for r in mapprep.stop_labels(frame).collect()] == [("1", "", 0), ("2", "Bay", 3)]


def test_rings_need_three_usable_vertices(spark):
    good = [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0]]
    rows = [
        (1, good),
        (2, good[:2]),
        (3, [*good[:2], [None, 1.0]]),
        (4, [*good, [float("nan"), 1.0]]),
        (5, None),
    ]
    frame = spark.createDataFrame(rows, "id int, ring array<array<double>>")
    assert {r.id: r.ring for r in mapprep.drawable_rings(frame).collect()} == {1: good, 4: good}


def test_documents_are_bounded_by_bytes(spark):
    """A few huge features among small ones: a document ends where it is full."""
    rows = [(f"f{n:03}" + "x" * (5000 if n % 10 == 3 else 20),) for n in range(100)]
    frame = spark.createDataFrame(rows, "feature string").repartition(5)
    found = features.feature_documents(frame, 40, 2000).orderBy("document").collect()
    assert [r.document for r in found] == list(range(len(found)))
    texts = [r.geojson.removeprefix('{"type":"FeatureCollection","features":[').removesuffix("]}").split(",") for r in found]
    assert [t for part in texts for t in part] == sorted(r[0] for r in rows)
    for part in texts:
        assert sum(map(len, part[:-1])) <= 2000 and len(part) <= 40
    assert max(map(len, texts)) > 1 and len(found) > 10
