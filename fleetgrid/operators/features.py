"""GeoJSON features, one per row, and documents of a bounded number of features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetgrid.operators.numbering import number_in_groups, number_rows
from fleetgrid.session import durable

# Features and bytes of one document; more make more documents.
DOCUMENT_FEATURES = 10_000
DOCUMENT_BYTES = 64_000_000

KEEP_NULLS = {"ignoreNullFields": "false"}


def _property(df: DataFrame, name: str) -> Column:
    """JSON drops the microseconds of a timestamp, so timestamps go in as text."""
    if isinstance(df.schema[name].dataType, (T.TimestampType, T.TimestampNTZType)):
        return F.col(name).cast("string").alias(name)
    return F.col(name)


def to_features(
    df: DataFrame, geometry: str = "geometry", properties: Sequence[str] | None = None
) -> DataFrame:
    """Rows as GeoJSON feature text in one column ``feature``; rows without geometry are dropped.

    ``geometry`` is a geometry column or GeoJSON text. Other columns become properties, nulls included.
    A frame whose one column is ``geojson`` holds documents: their features come out as they are.
    """
    if df.columns == ["geojson"]:
        document = F.from_json("geojson", "struct<features: array<string>>")
        return df.select(F.explode(document["features"]).alias("feature")).filter("feature IS NOT NULL")
    if geometry not in df.columns:
        return df.limit(0).select(F.lit("").alias("feature"))
    names = [c for c in df.columns if c != geometry] if properties is None else list(properties)
    shape = F.col(geometry)
    if not isinstance(df.schema[geometry].dataType, T.StringType):
        shape = F.to_json(shape)
    values = F.lit("{}")
    if names:
        values = F.to_json(F.struct(*[_property(df, c) for c in names]), KEEP_NULLS)
    text = F.concat(
        F.lit('{"type":"Feature","geometry":'),
        shape,
        F.lit(',"properties":'),
        values,
        F.lit("}"),
    )
    return df.filter(F.col(geometry).isNotNull()).select(text.alias("feature"))


def feature_documents(
    features: DataFrame, per_document: int = DOCUMENT_FEATURES, most_bytes: int = DOCUMENT_BYTES
) -> DataFrame:
    """(document, geojson): all features, sorted by text, in documents of ``per_document`` each.

    A document with more than about ``most_bytes`` is cut into several: a feature goes to the next one where the
    features before it in its run of ``per_document`` fill another ``most_bytes``, so only a feature that is
    larger itself makes a larger document. Without features there is one document with an empty list.
    """
    texts = durable(features.select("feature"))
    if texts.isEmpty():
        none = F.lit('{"type":"FeatureCollection","features":[]}')
        return texts.sparkSession.range(1).select(F.lit(0).cast("long").alias("document"), none.alias("geojson"))
    placed = number_rows(texts, ["feature"], name="_no").withColumn("_run", F.floor(F.col("_no") / per_document))
    before = Window.partitionBy("_run").orderBy("_no").rowsBetween(Window.unboundedPreceding, -1)
    filled = F.coalesce(F.sum(F.octet_length("feature")).over(before), F.lit(0))
    placed = placed.withColumn("_cut", F.floor(filled / most_bytes))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("_no", "feature"))), lambda one: one["feature"])
    documents = placed.groupBy("_run", "_cut").agg(
        F.concat(
            F.lit('{"type":"FeatureCollection","features":['), F.array_join(listed, ","), F.lit("]}")
        ).alias("geojson")
    )
    if texts.agg(F.sum(F.octet_length("feature"))).first()[0] <= most_bytes:
        return documents.select(F.col("_run").alias("document"), "geojson")
    return number_in_groups(documents, [], ["_run", "_cut"], "document").select("document", "geojson")


def write_features(features: DataFrame, path: str) -> None:
    """Newline-delimited GeoJSON: one feature per line, any number of files."""
    features.select("feature").write.mode("overwrite").text(path)
