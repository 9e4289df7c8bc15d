"""Open-data catalogue documents: which resource holds the schedule archive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CATALOGUE = (
    "result struct<resources: array<struct<"
    "id: string, name: string, url: string, datastore_active: boolean>>>"
)


def read_catalogue(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return spark.read.schema(CATALOGUE).json(path, multiLine=multi_line)


def catalogue_from_text(df: DataFrame, text: str = "value") -> DataFrame:
    """Catalogue JSON held in a column; other columns stay."""
    # Inlining the parsed struct keeps the optimizer from parsing once per use.
    parsed = F.inline(F.array(F.from_json(text, CATALOGUE)))
    return df.select(*[c for c in df.columns if c != text], parsed)


def archive_resource(catalogue: DataFrame) -> DataFrame:
    """First listed resource outside the datastore, per document; documents without one drop out.

    Decided inside each row, so nothing is shuffled.
    """
    outside = F.filter("result.resources", lambda r: ~r["datastore_active"])
    kept = [c for c in catalogue.columns if c != "result"]
    return catalogue.select(*kept, F.inline(F.slice(outside, 1, 1))).select(
        *kept,
        F.col("id").alias("resource_id"),
        F.coalesce("name", "id").alias("resource_name"),
        "url",
    )
