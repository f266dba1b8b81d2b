"""Messages delivered at least once: keep exactly one copy of each identifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memq.operators.skew import salted_join
from memq.session import materialize

#: Time buckets of a batch, bits of one filter block, bits set per identifier, identifiers of all buckets per block.
#: Evenly spread over the buckets they leave 64 bits for each; all in one bucket 4, with more to verify but nothing lost.
BUCKETS, BLOCK, PROBES, PER_BLOCK = 16, 32_768, 4, 8_192


def _bits(id_col: str) -> list[Column]:
    """Positions in a block, by double hashing (odd step)."""
    h, step = F.xxhash64(id_col, F.lit(1)), F.xxhash64(id_col, F.lit(2)).bitwiseOR(F.lit(1))
    base, step = F.pmod(h, F.lit(BLOCK)), F.pmod(step, F.lit(BLOCK))
    return [F.pmod(base + step * i, F.lit(BLOCK)).cast("int") for i in range(PROBES)]


def bucketed_storage(rows: DataFrame, id_col: str, order: str, at: str, buckets: int = BUCKETS) -> DataFrame:
    """Identifiers by time bucket and filter block, written out: (bucket, block, id, n, last).

    Buckets are equal parts of the time range; a row without a time is in bucket -1. Repeats inside
    a bucket are combined before the shuffle, so no identifier has more than buckets + 1 rows.
    """
    rows = rows.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(order).alias("order"), F.unix_micros(F.col(at).cast("timestamp")).alias("at")
    )
    lo, hi, n = rows.agg(F.min("at"), F.max("at"), F.count("*")).first()
    width = max(1, -(-((hi or 0) - (lo or 0) + 1) // buckets))
    bucket = F.coalesce(F.floor((F.col("at") - F.lit(lo or 0)) / width), F.lit(-1)).cast("int")
    blocks = max(1, -(-n // PER_BLOCK))
    ids = rows.groupBy(bucket.alias("bucket"), "id").agg(F.count("*").alias("n"), F.max("order").alias("last"))
    return materialize(ids.withColumn("block", F.pmod(F.xxhash64("id", F.lit(0)), F.lit(blocks)).cast("int")))


def bloom_filters(storage: DataFrame) -> DataFrame:
    """One blocked Bloom filter per time bucket: (bucket, block, bits), bits as BLOCK / 64 words."""
    bits = storage.select("bucket", "block", F.explode(F.array(*_bits("id"))).alias("bit"))
    word = F.bit_or(F.expr("shiftleft(1L, pmod(bit, 64))")).alias("bits")
    words = bits.groupBy("bucket", "block", F.shiftright("bit", 6).alias("word")).agg(word)
    held = words.groupBy("bucket", "block").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("held"))
    every = F.sequence(F.lit(0), F.lit(BLOCK // 64 - 1))
    return held.select("bucket", "block", F.transform(every, lambda i: F.coalesce(F.try_element_at("held", i), F.lit(0).cast("bigint"))).alias("bits"))


def screen(storage: DataFrame, filters: DataFrame) -> DataFrame:
    """(bucket, block, id, n, last, match): one row per other bucket whose filter may hold the identifier.

    An identifier without a row here is in no other bucket for certain.
    """

    def is_set(p: Column) -> Column:
        return F.getbit(F.get("bits", F.shiftright(p, 6)), F.pmod(p, F.lit(64))) == 1

    on = (F.col("s.block") == F.col("f.block")) & (F.col("s.bucket") != F.col("f.bucket"))
    for p in _bits("id"):
        on = on & is_set(p)
    return storage.alias("s").join(filters.alias("f"), on).select("s.*", F.col("f.bucket").alias("match"))


def repeated_ids(storage: DataFrame) -> DataFrame:
    """(id, n, last) of identifiers with more than one row, exact.

    Identifiers that no other bucket's filter may hold are settled by their own bucket alone.
    Possible repeats are verified against the matching buckets of the storage only.
    """
    possible = screen(storage, bloom_filters(storage))
    hits = possible.join(
        storage.select(F.col("bucket").alias("match"), "block", "id", F.col("n").alias("n2"), F.col("last").alias("last2")),
        ["match", "block", "id"],
    )
    across = hits.groupBy("id").agg(
        (F.max("n") + F.sum("n2")).alias("n0"), F.greatest(F.max("last"), F.max("last2")).alias("last")
    ).select("id", F.col("n0").alias("n"), "last")
    inside = storage.where("n > 1").select("id", "n", "last")
    return across.unionByName(inside).groupBy("id").agg(F.max("n").alias("n"), F.max("last").alias("last"))


def copies(rows: DataFrame, id_col: str, order: str, at: str) -> DataFrame:
    """(id_col, order): every row whose identifier also has a row with a greater ``order``.

    Rows without an identifier are never copies. Of rows that tie in ``order`` none is a copy of
    the other. An empty table gives no rows.
    """
    again = repeated_ids(bucketed_storage(rows, id_col, order, at))
    present = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(order).alias("order"))
    older = salted_join(present, again, ["id"], "n").where(F.col("order") < F.col("last"))
    return older.select(F.col("id").alias(id_col), F.col("order").alias(order))


def exactly_once(rows: DataFrame, id_col: str, order: str, at: str) -> DataFrame:
    """The rows without copies: one per identifier, the one with the greatest ``order``, and all without identifier.

    ``order`` must be unique and not null.
    """
    dropped = copies(rows, id_col, order, at).select(F.col(order).alias("__dropped"))
    return rows.join(dropped, F.col(order) == F.col("__dropped"), "left_anti")
