"""Text columns to typed columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgrid.schema import FEED_NUMBERS


def typed_view(df: DataFrame, types: Mapping[str, str] = FEED_NUMBERS) -> DataFrame:
    """Feed text as numbers. Text that is not a number becomes null and adds to ``rejected``.

    Column names compare without case, as in SQL; a column keeps the case it has.
    """
    kinds = {name.lower(): kind for name, kind in types.items()}
    present = {c: kinds[c.lower()] for c in df.columns if c.lower() in kinds}
    rejected = F.lit(0)
    for name, kind in present.items():
        bad = F.col(name).isNotNull() & F.col(name).try_cast(kind).isNull()
        rejected = rejected + bad.cast("int")
    return df.withColumns(
        {**{c: F.col(c).try_cast(kind) for c, kind in present.items()}, "rejected": rejected}
    )


def epoch_millis(text: Column) -> Column:
    """Epoch milliseconds given as text."""
    return F.timestamp_millis(text.try_cast("bigint"))


# Types a text column may turn out to hold, narrowest first.
INFERRED = ("boolean", "bigint", "double")


# Forms of numbers in text; looking at the form first is much cheaper than a failed cast.
FORMS = {
    "bigint": r"^\s*[+-]?[0-9]+\s*$",
    "double": r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$",
}


def _fits(name: str, kind: str) -> Column:
    if kind == "boolean":
        return F.col(name).isin("true", "false")
    return F.col(name).rlike(FORMS[kind]) & F.col(name).try_cast(kind).isNotNull()


def infer_types(df: DataFrame) -> DataFrame:
    """Cast each text column to the narrowest type that holds **every** value of the column.

    All rows are looked at, in one aggregate that returns one row; one late text value keeps a column
    text. Columns without any value stay text.
    """
    names = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    if not names:
        return df
    row = df.agg(
        *[
            F.bool_and(_fits(name, kind) | F.col(name).isNull()).alias(f"{i}_{kind}")
            for i, name in enumerate(names)
            for kind in INFERRED
        ],
        *[F.count(name).alias(f"{i}_filled") for i, name in enumerate(names)],
    ).first()
    found = {}
    for i, name in enumerate(names):
        kind = next((k for k in INFERRED if row[f"{i}_{k}"]), None)
        if kind and row[f"{i}_filled"]:
            found[name] = F.col(name).cast(kind)
    return df.withColumns(found) if found else df
