"""Deterministic keys and numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memq.functions import text


def statement_key(sid: Column | str = "sid", idx: Column | str = "idx") -> Column:
    return F.concat_ws("|", sid, F.col(idx).cast("string") if isinstance(idx, str) else idx.cast("string"))


def claim_key() -> Column:
    """sid|turn|subj|pred|digest of obj; the digest is the start of a SHA-256, since Spark has no BLAKE2."""
    return F.concat_ws("|", "sid", F.col("turn").cast("string"), "subj", "pred", F.substring(F.sha2(F.col("obj"), 256), 1, 8))


def stable_id(kind: str, key: Column | str, bits: int = 52) -> Column:
    """A positive number of 32 to 62 bits from kind and key, the leading ones of a digest; 0 becomes 1, null stays null."""
    if not 32 <= bits <= 62:
        raise ValueError(f"bits must be from 32 to 62: {bits}")
    key = F.col(key) if isinstance(key, str) else key
    size = -(-bits // 4)
    number = F.conv(F.substring(F.sha2(F.concat(F.lit(kind + "|"), key), 256), 1, size), 16, 10)
    lead = F.floor(number.cast("decimal(20,0)") / F.lit(1 << (4 * size - bits))) if bits % 4 else number
    return F.when(number.isNotNull(), F.greatest(F.lit(1).cast("bigint"), lead.cast("bigint")))


def collisions(df: DataFrame, number: str, key: str) -> DataFrame:
    """Numbers issued to more than one key; must be empty."""
    return df.groupBy(number).agg(F.min(key).alias("a"), F.max(key).alias("b")).where("a != b")


def content_hash(turns: Column | str) -> Column:
    """Of a session's array of turns: 16 hex digits over roles and contents; ground truth does not enter."""
    parts = F.transform(turns, lambda t: F.concat(t["role"], F.lit("\0"), t["content"], F.lit("\1")))
    return F.substring(F.sha2(F.array_join(parts, ""), 256), 1, 16)


def predicate(c: Column | str) -> Column:
    """Lower-cased, blanks squeezed, then written with underscores."""
    return F.replace(text.entity(c), F.lit(" "), F.lit("_"))


def normal_object(c: Column | str) -> Column:
    """The form in which two objects count as one value: no underscores, case, punctuation or extra blanks."""
    c = F.col(c) if isinstance(c, str) else c
    plain = F.regexp_replace(F.lower(F.replace(c, F.lit("_"), F.lit(" "))), r"[^\p{L}\p{N}_\s]+", " ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))
