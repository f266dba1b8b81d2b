"""History of changing attributes: which value was valid from when to when."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memq.functions import text
from memq.operators.skew import may_hold, salted_join, small_side
from memq.session import materialize

#: Seconds of one chunk of a timeline.
CHUNK = 3_600


def usable_claims(claims: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Claims with an entity, a predicate, a value and a time, as (ekey, pred, value, ts, sid, turn).

    With ``wanted``, a written table with ekey and pred, claims of most other keys are left out before values are made.
    """
    present = claims.where(F.col("subj").isNotNull() & F.col("pred").isNotNull() & F.col("ts").isNotNull() & text.has_words("obj"))
    keyed = present.select(text.entity("subj").alias("ekey"), "pred", "obj", "ts", "sid", "turn")
    near = keyed if wanted is None else may_hold(keyed, wanted, ["ekey", "pred"])
    return near.select("ekey", "pred", text.value("obj").alias("value"), "ts", "sid", "turn")


def single_valued(claims: DataFrame) -> DataFrame:
    """(pred, n): predicates all of whose claims have card ``one``; a null card is not ``one``."""
    return (
        claims.where("pred is not null")
        .groupBy("pred")
        .agg(F.min(F.coalesce(F.col("card") == "one", F.lit(False))).alias("one"), F.count("*").alias("n"))
        .where("one")
        .select("pred", "n")
    )


def versions(changes: DataFrame, keys: list[str], value: str, ts: str, order: list[str], chunk: int = CHUNK) -> DataFrame:
    """Versions (keys, value, valid_from, valid_to) of each entity, from periodic snapshots or updates.

    Of several rows with the same keys and ts only the last by ``order`` counts (ties: the largest
    value). Each entity's rows of one chunk of time form a sorted struct array, folded by a
    higher-order function that appends a version only upon change; an array has at most ``chunk``
    entries, since times are whole seconds, so a hot entity is spread over its chunks. Chunks of an
    entity are then stitched through one summary row each: a first version equal to the last one
    before it is dropped, and the last version ends where the next kept one begins, -1 if none does.
    Rows with a null key, value or ts must have been removed; an empty input gives an empty result.
    """
    last = F.max(F.struct(*order, value)).alias("__last")
    latest = changes.groupBy(*keys, ts).agg(last).select(*keys, F.col(ts).alias("ts"), F.col(f"__last.{value}").alias("value"))
    runs = F.aggregate(
        "sorted",
        F.slice("sorted", 1, 1),
        lambda acc, x: F.when(F.element_at(acc, -1)["value"] == x["value"], acc).otherwise(F.concat(acc, F.array(x))),
    )
    chunks = materialize(
        latest.withColumn("chunk", F.floor(F.col("ts") / chunk))
        .groupBy(*keys, "chunk")
        .agg(F.array_sort(F.collect_list(F.struct("ts", "value"))).alias("sorted"))
        .select(*keys, "chunk", runs.alias("runs"))
    )
    forward = Window.partitionBy(*keys).orderBy("chunk")
    back = Window.partitionBy(*keys).orderBy(F.col("chunk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    stitched = (
        chunks.select(
            *keys,
            "chunk",
            F.col("runs")[0]["value"].alias("first"),
            F.col("runs")[0]["ts"].alias("ts0"),
            F.try_element_at("runs", F.lit(2))["ts"].alias("ts1"),
            F.element_at("runs", -1)["value"].alias("final"),
        )
        .withColumn("same", F.coalesce(F.lag("final").over(forward) == F.col("first"), F.lit(False)))
        .withColumn("kept", F.when(F.col("same"), F.col("ts1")).otherwise(F.col("ts0")))
        .withColumn("next", F.last("kept", ignorenulls=True).over(back))
        .select(*keys, "chunk", "same", "next")
    )
    runs_kept = F.when(F.col("same"), F.slice("runs", F.lit(2), F.size("runs"))).otherwise(F.col("runs"))
    with_ends = F.transform(
        "kept",
        lambda r, i: F.struct(
            r["value"].alias("value"),
            r["ts"].alias("valid_from"),
            F.coalesce(F.get("kept", i + 1)["ts"], F.col("next"), F.lit(-1).cast("bigint")).alias("valid_to"),
        ),
    )
    return (
        chunks.join(stitched, [*keys, "chunk"])
        .select(*keys, "next", runs_kept.alias("kept"))
        .select(*keys, F.inline(with_ends))
    )


def claim_history(claims: DataFrame) -> DataFrame:
    """(ekey, pred, value, valid_from, valid_to) for single-valued predicates.

    Claims without a value or time count for nothing, except that any claim whose card is not
    ``one`` makes its predicate multi-valued. A null subject or predicate has no history.
    """
    usable, one = usable_claims(claims), single_valued(claims)
    few = small_side(one.select("pred"))
    usable = usable.join(few, "pred") if few is not None else salted_join(usable, one, ["pred"], "n")
    return versions(usable, ["ekey", "pred"], "value", "ts", ["sid", "turn"])
