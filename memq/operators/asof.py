"""Attributes as known at event time: periodic snapshots plus change logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memq.functions import text
from memq.operators.history import usable_claims
from memq.operators.skew import may_hold, salted_join
from memq.session import materialize

PERIOD = 86_400
#: Seconds of one chunk of a timeline whose rows are counted.
CHUNK = 3_600


def as_known(
    probes: DataFrame, changes: DataFrame, keys: list[str], at: str, ts: str, order: list[str], carry: list[str], period: int = PERIOD, screened: bool = False
) -> DataFrame:
    """For each distinct probe (keys, at) the last change with ts <= at, as (keys, at, ts, carry); no row if none.

    The last change is by ts, then by ``order``. Snapshots hold, for each period in which a probe
    falls, the state known when the period began; they and the change log are written out once. A probe starts from its
    period's snapshot and replays only that period's changes. Both steps are running windows:
    a snapshot window has at most two rows per key and period, a replay window at most 2 * period
    + 1 rows, since times are whole seconds and both sides are unique by key and second. A change
    later than the probe is never seen. Changes of keys that no probe asks for are mostly left out
    before anything is shuffled; ``screened`` says that this has been done. Null keys or times give no row.
    """
    present = [F.col(k).isNotNull() for k in keys]
    ok = present[0]
    for p in present[1:]:
        ok = ok & p
    state = F.struct(F.col(ts).alias("ts"), *[c for c in dict.fromkeys([*order, *carry])])
    asked = materialize(probes.where(ok & F.col(at).isNotNull()).select(*keys, F.col(at).alias("__at")).distinct().withColumn("__period", F.floor(F.col("__at") / period)))
    log = materialize(
        (changes if screened else may_hold(changes, asked, keys))
        .where(ok & F.col(ts).isNotNull())
        .groupBy(*keys, F.col(ts).alias("__at"))
        .agg(F.max(state).alias("__state"))
        .withColumn("__period", F.floor(F.col("__at") / period))
    )
    nothing = F.lit(None).cast(dict(log.dtypes)["__state"])
    closing = log.groupBy(*keys, "__period").agg(F.max_by("__state", "__at").alias("__state"))
    before = Window.partitionBy(*keys).orderBy("__period", "__change").rowsBetween(Window.unboundedPreceding, 0)
    periods = asked.select(*keys, "__period").distinct()
    snapshots = materialize(
        closing.select(*keys, "__period", F.lit(1).alias("__change"), "__state")
        .unionByName(periods.select(*keys, "__period", F.lit(0).alias("__change"), nothing.alias("__state")))
        .withColumn("__state", F.last("__state", ignorenulls=True).over(before))
        .where("__change = 0 and __state is not null")
        .select(*keys, "__period", "__state")
    )
    replay = Window.partitionBy(*keys, "__period").orderBy("__at", "__step").rowsBetween(Window.unboundedPreceding, 0)
    rows = (
        snapshots.select(*keys, "__period", (F.col("__period") * period).alias("__at"), F.lit(0).alias("__step"), "__state")
        .unionByName(log.join(periods, [*keys, "__period"], "left_semi").select(*keys, "__period", "__at", F.lit(1).alias("__step"), "__state"))
        .unionByName(asked.select(*keys, "__period", "__at", F.lit(2).alias("__step"), nothing.alias("__state")))
    )
    return (
        rows.withColumn("__state", F.last("__state", ignorenulls=True).over(replay))
        .where("__step = 2 and __state is not null")
        .select(*keys, F.col("__at").alias(at), "__state.*")
    )


def question_facts(instances: DataFrame, targets: DataFrame, claims: DataFrame) -> DataFrame:
    """(question_id, ekey, pred, asked_at, ts, sid, turn, value): each question's object as known when it was asked.

    Repeated instances count once; a question without asked_at, target or earlier claim has no row.
    """
    asked = instances.where("question_id is not null and asked_at is not null").select("question_id", "asked_at").distinct()
    aims = targets.select("question_id", text.entity("subj").alias("ekey"), "pred").where("ekey is not null and pred is not null").distinct()
    events = asked.join(aims, "question_id")
    events = materialize(events)
    per_probe = materialize(events.groupBy("ekey", "pred", "asked_at").agg(F.count("*").alias("n")))
    found = as_known(per_probe, usable_claims(claims, per_probe), ["ekey", "pred"], "asked_at", "ts", ["sid", "turn"], ["sid", "turn", "value"], screened=True)
    counted = found.join(per_probe, ["ekey", "pred", "asked_at"])
    return salted_join(events, counted, ["ekey", "pred", "asked_at"], "n")


def placed(rows: DataFrame, keys: list[str], order: list[str], chunk: int = CHUNK) -> DataFrame:
    """rows with ``place``, counted from 1 within the keys by ``order``, which begins with a time in seconds.

    Counted per chunk of time first and shifted by the chunks before, so a hot key is spread over its chunks.
    """
    cut = rows.withColumn("__chunk", F.floor(F.col(order[0]) / chunk))
    sizes = cut.groupBy(*keys, "__chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(*keys, "__chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__shift"))
    own = cut.withColumn("__own", F.row_number().over(Window.partitionBy(*keys, "__chunk").orderBy(*order)))
    return own.join(shift, [*keys, "__chunk"]).withColumn("place", F.col("__own") + F.col("__shift")).drop("__own", "__shift", "__chunk")


def tips(instances: DataFrame, targets: DataFrame, claims: DataFrame, limit: int = 5) -> DataFrame:
    """(question_id, nth, line_no, ts): the newest ``limit`` claims about each question's subject said by then.

    Strict: nothing later than the question. Ties go to the greater sid, turn, line. The newest
    place is found by as_known(), the others are the places before it, so no pairs are made.
    """
    said = claims.where("subj is not null and pred is not null and ts is not null").select(text.entity("subj").alias("ekey"), "pred", "ts", "sid", "turn", "line_no")
    asked = instances.where("question_id is not null and asked_at is not null").select("question_id", "asked_at").distinct()
    aims = targets.select("question_id", text.entity("subj").alias("ekey"), "pred").where("ekey is not null and pred is not null").distinct()
    events = materialize(asked.join(aims, "question_id"))
    said = materialize(may_hold(said, events, ["ekey", "pred"]))
    line = materialize(placed(said, ["ekey", "pred"], ["ts", "sid", "turn", "line_no"]).select("ekey", "pred", "ts", "line_no", "place"))
    newest = as_known(events, line, ["ekey", "pred"], "asked_at", "ts", ["place"], ["place"])
    wanted = newest.select("ekey", "pred", "asked_at", F.posexplode(F.sequence(F.col("place"), F.greatest(F.lit(1), F.col("place") - limit + 1), F.lit(-1))).alias("nth", "place"))
    found = wanted.join(line, ["ekey", "pred", "place"])
    return events.join(found, ["ekey", "pred", "asked_at"]).select("question_id", (F.col("nth") + 1).alias("nth"), "line_no", "ts")
