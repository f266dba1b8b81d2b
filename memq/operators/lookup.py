"""Reads by key: a claim, a property, a parameterised query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_key(table: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The row of each wanted key with ``found``; an unknown key has found false and nulls, as has a null key."""
    return wanted.select(key).distinct().join(table.withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def property_of(table: DataFrame, key: str, value: object, prop: str, default: object = None) -> object:
    """One property of the row with a key; the default if there is no such row or the property is null, ValueError if several rows have it."""
    rows = table.where(F.col(key) == F.lit(value)).select(prop).take(2)
    if len(rows) > 1:
        raise ValueError(f"{key} {value!r} is not unique")
    return default if not rows or rows[0][0] is None else rows[0][0]


def run(table: DataFrame, query: str, **args: object) -> DataFrame:
    """A SQL query over ``{t}`` with named parameters (``:name``), which are values and never part of the text."""
    return table.sparkSession.sql(query, args=args, t=table)
