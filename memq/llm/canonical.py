"""Duplicates hidden by formatting differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memq.functions import text
from memq.operators.skew import salted_join, small_side
from memq.session import materialize, written

#: A dictionary of up to so many distinct values is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 20_000
#: Types whose values are whole numbers of at most 64 bits.
INTEGERS = {"tinyint", "smallint", "int", "bigint", "boolean", "date"}


def _numbered(distinct: DataFrame) -> DataFrame:
    """Integer identifiers; written out, so that they stay the same when a task is repeated."""
    return materialize(distinct.withColumn("__id", F.monotonically_increasing_id()))


def dictionary(rows: DataFrame, column: str, parts: Column) -> DataFrame:
    """(column, __ids, __n): each distinct value canonicalised once into an array of parts, each part an integer.

    ``parts`` is an expression over ``column`` that gives an array of strings; the identifiers of a
    value are sorted, so the order of parts does not matter, while repeated parts count. A value
    that is null or whose array is null or empty is left out.
    """
    values = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("__n"))
    numbered = _numbered(values.withColumn("__parts", parts))  # a filter on the parts here would make them twice
    each = numbered.select("__id", F.explode("__parts").alias("__part"))
    parts_ids = written(_numbered(each.groupBy("__part").agg(F.count("*").alias("__uses"))).withColumnRenamed("__id", "__part_id"))
    few = small_side(parts_ids.drop("__uses"), BROADCAST_ROWS)
    joined = each.join(few, "__part") if few is not None else salted_join(each, parts_ids, ["__part"], "__uses")
    ids = joined.groupBy("__id").agg(F.array_sort(F.collect_list("__part_id")).alias("ids"))
    return materialize(numbered.drop("__parts").join(ids, "__id").select(column, F.col("ids").alias("__ids"), "__n"))


def plain_dictionary(rows: DataFrame, column: str) -> DataFrame:
    """(column, __ids, __n): each distinct value that is not null with an integer of its own."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("__n"))
    return written(_numbered(counts).select(column, F.array("__id").alias("__ids"), "__n"))


def encode(rows: DataFrame, key: str, same: list[str], loose: dict[str, Column], required: list[str]) -> DataFrame:
    """(key, tuple array<bigint>): records rewritten as integer tuples, equal exactly if the records are copies.

    ``same`` columns must be equal as they are, null equal to null; integers, dates and booleans are
    their own numbers, all other types (strings, doubles, decimals, timestamps, binaries) are
    dictionary-encoded, which keeps every digit; a double is equal to itself where it is not a
    number, and 0 to -0. Arrays, maps, structs and variants raise TypeError. ``loose`` columns are equal if their parts are. Rows
    whose ``required`` loose columns have no parts are left out; other values without parts are
    equal to each other, but null differs from a text without words. Columns with a small
    dictionary are rewritten first, so that what is shuffled for the others is narrow.
    """
    kinds = dict(rows.dtypes)
    source = rows.select(key, *same, *loose)
    words = {c: dictionary(source, c, parts) for c, parts in loose.items()}
    for c in same:
        if kinds[c].split("<")[0] in ("array", "map", "struct", "variant"):
            raise TypeError(f"{c}: values of type {kinds[c]} have no place in a tuple")
    words |= {c: plain_dictionary(source, c) for c in same if kinds[c] not in INTEGERS}
    small = {c: small_side(w.drop("__n"), BROADCAST_ROWS) for c, w in words.items()}
    out = source
    for c in sorted(words, key=lambda c: small[c] is None):
        how = "inner" if c in required else "left"
        own = words[c] if small[c] is None else small[c]
        if c in loose:  # its parts behind their number, which keeps neighbouring columns apart
            number = F.when(F.col(c).isNull(), -1).otherwise(F.coalesce(F.size("__ids"), F.lit(0))).cast("bigint")
            code = F.concat(F.array(number), F.coalesce("__ids", F.array().cast("array<bigint>")))
        else:
            code = F.coalesce(F.get("__ids", F.lit(0)), F.lit(-1).cast("bigint"))
        out = salted_join(out, own, [c], "__n", how) if small[c] is None else out.join(own, c, how)
        out = out.withColumn(f"__code_{c}", code).drop(c, "__ids")
    single: list[Column] = []
    for c in same:
        if c in words:
            single.append(F.col(f"__code_{c}"))
        else:
            number = F.unix_date(c) if kinds[c] == "date" else F.col(c)
            single += [F.col(c).isNull().cast("bigint"), F.coalesce(number.cast("bigint"), F.lit(0).cast("bigint"))]
    return materialize(out.select(key, F.concat(F.array(*single), *[F.col(f"__code_{c}") for c in loose]).alias("tuple")))


def collapse(encoded: DataFrame, key: str) -> DataFrame:
    """(tuple, keep_key, n_copies): one row per group of copies, single records included."""
    return encoded.groupBy("tuple").agg(F.min(key).alias("keep_key"), F.count("*").alias("n_copies"))


def copies(rows: DataFrame, key: str, same: list[str], loose: dict[str, Column], required: list[str]) -> DataFrame:
    """(keep_key, copy_key, n_copies): each record of a group of two or more other than the one with the smallest key."""
    encoded = encode(rows, key, same, loose, required)
    groups = collapse(encoded, key).where("n_copies > 1").withColumn("__n", F.col("n_copies"))
    return (
        salted_join(encoded, groups, ["tuple"], "__n")
        .where(F.col(key) != F.col("keep_key"))
        .select("keep_key", F.col(key).alias("copy_key"), F.col("n_copies").cast("int").alias("n_copies"))
    )


def _as_one(c: Column) -> Column:
    return F.array(c)


def claim_copies(claims: DataFrame) -> DataFrame:
    """Claims equal but for the writing of subj and obj."""
    return copies(
        claims, "line_no", ["sid", "turn", "pred", "kind", "card", "ts"],
        {"obj": text.fields("obj"), "subj": _as_one(text.spaced_words("subj"))}, ["obj"],
    )


def session_copies(sessions: DataFrame) -> DataFrame:
    """Sessions equal but for the writing of session_id."""
    return copies(sessions, "line_no", ["ts", "turns"], {"session_id": _as_one(text.spaced_words("session_id"))}, [])
