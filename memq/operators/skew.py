"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memq.session import once

#: Rows of one key that a single join task takes.
PER_TASK = 50_000
#: Hot keys salted one by one; slots by hash through which any further ones are salted. Both bound what is broadcast.
LISTED, SLOTS = 100_000, 65_536
#: Words of 64 bits of the largest key filter.
WORDS = 1 << 20


def free_prefix(*frames: DataFrame) -> str:
    """A beginning that no column of the frames has, for names used inside an operator."""
    prefix = "__"
    while any(c.lower().startswith(prefix) for df in frames for c in df.columns):
        prefix += "_"
    return prefix


def _salts(unique: DataFrame, keys: list[str], n: str, per_task: int) -> tuple[DataFrame | None, DataFrame | None]:
    """((hash, salts) of the LISTED largest hot keys, (slot, salts) that covers all others); None where not needed."""
    hot = (
        unique.where(F.col(n) > per_task)
        .groupBy(F.xxhash64(*keys).alias("__hash"))
        .agg(F.ceil(F.max(n) / per_task).cast("int").alias("__salts"))
    )
    found = hot.count()
    if not found:
        return None, None
    if found <= LISTED:
        return hot, None
    hot = once(hot)
    first = once(hot.orderBy(F.col("__salts").desc(), "__hash").limit(LISTED))
    rest = hot.join(F.broadcast(first.select("__hash")), "__hash", "left_anti")
    return first, rest.groupBy(F.pmod("__hash", F.lit(SLOTS)).alias("__slot")).agg(F.max("__salts").alias("__slot_salts"))


def salted_join(
    rows: DataFrame, unique: DataFrame, keys: list[str], n: str, how: str = "inner", per_task: int = PER_TASK
) -> DataFrame:
    """Join many rows to a side with one row per key, or few, spreading hot keys over several tasks.

    ``unique`` has the keys and in column ``n`` how many rows the other side has of the key (or how
    many pairs the key makes); it is written out unless it is a written table, so it is computed
    once. Every key with more than ``per_task`` rows is salted: its row in ``unique`` is repeated
    once per salt, its rows take a salt by hash. The salts of the LISTED largest hot keys are
    looked up by the hash of the key, those of all others by one of SLOTS slots, each with the
    largest number its keys need; so what is broadcast is at most LISTED + SLOTS pairs of numbers
    however many keys are hot, and no hot key stays whole. Where no key is hot it is a plain join.
    No row is dropped; hashes affect only the layout. Null keys match nothing. Column ``n`` is not in the result.
    """
    unique = once(unique)
    listed, slots = _salts(unique, keys, n, per_task)
    right = unique.drop(n) if n not in keys else unique
    if listed is None:
        return rows.join(right, keys, how)
    kinds, p = dict(unique.dtypes), free_prefix(rows, unique)
    hash_, salts, slot, slot_salts, salt = (f"{p}{x}" for x in ("hash", "salts", "slot", "slot_salts", "salt"))
    listed = listed.toDF(hash_, salts)

    def with_salts(df: DataFrame) -> DataFrame:
        df = df.withColumn(hash_, F.xxhash64(*[F.col(k).cast(kinds[k]) for k in keys]))
        df = df.join(F.broadcast(listed), hash_, "left")
        if slots is not None:
            df = df.withColumn(slot, F.pmod(hash_, F.lit(SLOTS))).join(F.broadcast(slots.toDF(slot, slot_salts)), slot, "left")
            df = df.withColumn(salts, F.coalesce(salts, slot_salts)).drop(slot, slot_salts)
        return df.withColumn(salts, F.coalesce(salts, F.lit(1))).drop(hash_)

    others = [c for c in rows.columns if c not in keys] or keys
    left = with_salts(rows).withColumn(salt, F.pmod(F.xxhash64(*others), F.col(salts)).cast("int")).drop(salts)
    right = with_salts(right).withColumn(salt, F.explode(F.sequence(F.lit(0), F.col(salts) - 1))).drop(salts)
    return left.join(right, [*keys, salt], how).drop(salt)


def small_side(df: DataFrame, most: int = 10_000, most_bytes: int = 64 << 20) -> DataFrame | None:
    """df marked for broadcast if it has at most ``most`` rows and ``most_bytes`` bytes of text and arrays; else None.

    The job that checks stops reading after ``most`` + 1 rows.
    """
    wide = [F.octet_length(c) if t in ("string", "binary") else F.size(c) * 8 for c, t in df.dtypes if t in ("string", "binary") or t.startswith("array")]
    size = sum((F.coalesce(w, F.lit(0)) for w in wide), F.lit(0)).cast("bigint")
    n, total = df.select(size.alias("size")).limit(most + 1).agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    return F.broadcast(df) if n <= most and total <= most_bytes else None


def may_hold(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose key may be among ``wanted``: a filter before a shuffle, never instead of the join after it.

    A bitmap over hashes of the wanted keys, 16 bits a key, is broadcast as words of 64 bits, at most
    WORDS of them whatever the input; with more keys than that it lets more rows pass, and loses
    none. ``wanted`` should be a written table. Null keys are hashed like any other.
    """
    kinds = dict(wanted.dtypes)
    words = max(1, min(WORDS, wanted.count() // 4))
    bit = F.pmod(F.xxhash64(*[F.col(k).cast(kinds[k]) for k in keys], F.lit("held")), F.lit(words * 64))
    p = free_prefix(rows, wanted)
    at, word, bits = f"{p}bit", f"{p}word", f"{p}bits"
    inside = F.expr(f"shiftleft(1L, cast(pmod({at}, 64) as int))")
    held = wanted.select(bit.alias(at)).groupBy(F.shiftright(at, 6).alias(word)).agg(F.bit_or(inside).alias(bits))
    return (
        rows.withColumn(at, bit)
        .withColumn(word, F.shiftright(at, 6))
        .join(F.broadcast(held), word)
        .where(F.getbit(bits, F.pmod(at, F.lit(64)).cast("int")) == 1)
        .select(*[f"`{c}`" for c in rows.columns])
    )
