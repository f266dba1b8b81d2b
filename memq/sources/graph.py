"""Node and edge tables with the write rules of a property graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_nodes(writes: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key from a log of writes: each property keeps its last value that is not null, unnamed ones survive."""
    columns = [c for c in writes.columns if c not in (key, order)]
    last = [F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns]
    return writes.where(F.col(key).isNotNull()).groupBy(key).agg(*last)


def add_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Edges are a bag: writing one twice keeps two."""
    return edges.unionByName(new)


def delete_edges(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Without any edge whose (src, rel) is among the sources."""
    return edges.join(sources.select("src", "rel").distinct(), ["src", "rel"], "left_anti")


def exactly_once(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Replace all edges of each written (src, rel) by the new ones, once each; so it may hold only what is written now."""
    return delete_edges(edges, new).unionByName(new.dropDuplicates(["src", "rel", "dst"]))


def set_property(nodes: DataFrame, key: str, values: DataFrame, prop: str) -> DataFrame:
    """Nodes with ``prop`` overwritten where ``values`` (key, prop) has it."""
    new = values.select(key, F.col(prop).alias("__new"))
    return nodes.join(new, key, "left").withColumn(prop, F.coalesce("__new", prop)).drop("__new")


def check_names(names: list[str]) -> None:
    """Property and label names are letters, digits and underscores, not starting with a digit."""
    import re

    for n in names:
        if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", n):
            raise ValueError(f"not a name: {n!r}")
