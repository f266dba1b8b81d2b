"""From conversations and extracted claims to statements, sessions, entities and valid claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memq.functions import keys, report, text, timeparse
from memq.session import materialize

ROLES = ("user", "assistant")
KINDS = ("fact", "preference", "event", "plan")
CARDS = ("one", "many")
LONGEST = {"subj": 120, "pred": 60, "obj": 400}


def last_rows(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The row with the greatest ``order`` of each key, as in a log where the last line wins.

    ``order`` must be unique. Only key and order are shuffled to find the winners, combined before
    the shuffle; rows with a null key are dropped.
    """
    present = df.dropna(subset=key)
    last = present.groupBy(*key).agg(F.max(order).alias("__last")).select("__last")
    return present.join(last, F.col(order) == F.col("__last"), "left_semi")


def one_per_turn(turns: DataFrame) -> DataFrame:
    """(sid, idx, t): content and role of each turn of a known role; of turns that share a key the greatest content counts."""
    said = F.struct(F.coalesce("content", F.lit("")).alias("content"), "role")
    known = turns.where(F.col("role").isin(*ROLES) & F.col("session_id").isNotNull() & F.col("idx").isNotNull())
    return known.groupBy(F.col("session_id").alias("sid"), "idx").agg(F.max(said).alias("t"))


def statements(turns: DataFrame, sessions: DataFrame) -> DataFrame:
    """(nkey, id, sid, idx, role, ts, nchunks, chars): one per turn of a known role, ground truth left out.

    Repeated turns are one; of turns that share a key the greatest content counts. A turn whose
    session is unknown has a null ts.
    """
    times = sessions.where("session_id is not null").groupBy(F.col("session_id").alias("sid")).agg(F.max("ts").alias("ts"))
    return one_per_turn(turns).join(times, "sid", "left").select(
        keys.statement_key().alias("nkey"),
        keys.stable_id("Statement", keys.statement_key()).alias("id"),
        "sid",
        "idx",
        F.col("t.role").alias("role"),
        "ts",
        F.greatest(F.lit(1), F.ceil(F.length("t.content") / 12_000)).cast("int").alias("nchunks"),
        F.length("t.content").cast("bigint").alias("chars"),
    )


def role_rejects(turns: DataFrame) -> DataFrame:
    """(role, n) of turns that are no statements."""
    return turns.where(~F.coalesce(F.col("role").isin(*ROLES), F.lit(False))).groupBy("role").agg(F.count("*").alias("n"))


def entities(claims: DataFrame) -> DataFrame:
    """(ekey, id, name, claims): the name last written, by line."""
    named = claims.select(text.entity("subj").alias("ekey"), "subj", "line_no").where("ekey is not null")
    return (
        named.groupBy("ekey")
        .agg(F.max_by("subj", "line_no").alias("name"), F.count("*").alias("claims"))
        .select("ekey", keys.stable_id("Entity", "ekey").alias("id"), "name", "claims")
    )


def claim_edges(claims: DataFrame) -> DataFrame:
    """(src, rel, dst): ASSERTS from the statement a claim cites to the claim, ABOUT from the claim to its entity.

    A bag, as claims are written; a claim whose key or end is null has no edge there.
    """
    end = lambda src, rel, dst: claims.select(src.alias("src"), F.lit(rel).alias("rel"), dst.alias("dst")).dropna()
    cites = F.when(F.col("sid").isNotNull() & F.col("turn").isNotNull(), keys.statement_key("sid", "turn"))
    return end(cites, "ASSERTS", F.col("nkey")).unionByName(end(F.col("nkey"), "ABOUT", text.entity("subj")))


def claim_load(claims: DataFrame) -> DataFrame:
    """One row: claims_written, and entities they are about."""
    return claims.where("nkey is not null").agg(F.count("*").alias("claims_written"), F.countDistinct(text.entity("subj")).alias("entities"))


def drop_reason(turns_in_session: Column) -> Column:
    """Why a claim is dropped, the first reason that holds; null if it is kept."""
    blank = F.lit(False)
    for c in ("subj", "pred", "obj"):
        blank = blank | F.coalesce(F.trim(F.regexp_replace(c, text.BLANK, " ")) == "", F.lit(True))
    long = F.lit(False)
    for c, n in LONGEST.items():
        long = long | (F.length(c) > n)
    turn = F.col("turn")
    return (
        F.when(turn.isNull(), "turn_not_an_integer")
        .when(~F.coalesce((turn >= 0) & (turn < turns_in_session), F.lit(False)), "turn_out_of_range")
        .when(blank, "missing_or_empty_field")
        .when(long, "field_too_long")
        .when(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), "bad_kind")
    )


def checked_claims(claims: DataFrame, turns: DataFrame) -> DataFrame:
    """Claims with reason (null: kept) and card, ``many`` where it was missing; lengths count before trimming.

    A claim's turn must exist in its session, which has as many turns as its highest index says.
    """
    size = turns.where("session_id is not null and idx is not null").groupBy(F.col("session_id").alias("sid")).agg((F.max("idx") + 1).alias("__turns"))
    joined = claims.join(size, "sid", "left").withColumn("reason", drop_reason(F.coalesce("__turns", F.lit(0))))
    known = F.coalesce(F.col("card").isin(*CARDS), F.lit(False))
    return joined.drop("__turns").withColumn("defaulted", ~known).withColumn("card", F.when(known, F.col("card")).otherwise("many"))


def claim_drops(checked: DataFrame) -> DataFrame:
    """(reason, n): drops by reason; duplicates and defaulted cards are counted too, the latter being kept."""
    kept = checked.where("reason is null")
    groups = kept.groupBy("sid", "turn", text.entity("subj"), keys.predicate("pred"), F.lower("obj")).agg(F.count("*").alias("n"))
    return (
        checked.where("reason is not null")
        .groupBy("reason")
        .agg(F.count("*").alias("n"))
        .unionByName(kept.where("defaulted").groupBy(F.lit("cardinality_missing_defaulted_to_many").alias("reason")).agg(F.count("*").alias("n")))
        .unionByName(
            groups.where("n > 1").groupBy(F.lit("duplicate_in_response").alias("reason")).agg(F.sum(F.col("n") - 1).alias("n"))
        )
    )


def valid_claims(checked: DataFrame) -> DataFrame:
    """Kept claims without repeats inside their session: the first line of each (turn, entity, predicate, object)."""
    kept = checked.where("reason is null")
    first = kept.groupBy("sid", "turn", text.entity("subj"), keys.predicate("pred"), F.lower("obj")).agg(F.min("line_no").alias("line_no")).select("line_no")
    return (
        kept.join(first, "line_no", "left_semi")
        .withColumns({"subj": text.strip("subj"), "pred": keys.predicate("pred"), "obj": text.strip("obj")})
        .drop("reason", "defaulted")
    )


def claims_from_json(rows: DataFrame, sid: str = "sid", turns: str = "turns", claims: str = "claims") -> DataFrame:
    """(sid, ord, turn, subj, pred, obj, kind, card, reason) from a model's JSON array per session.

    Types are checked as written: a turn must be a JSON integer, not a boolean, text or decimal. A
    text that is no JSON array raises nothing here and gives no rows.
    """
    spark = rows.sparkSession
    rows.select(F.col(sid).alias("sid"), F.col(turns).alias("n"), F.expr(f"try_parse_json(`{claims}`)").alias("v")).createOrReplaceTempView("__claims_json")
    items = spark.sql("select sid, n, e.pos as ord, e.value as item from __claims_json, lateral variant_explode(v) e where schema_of_variant(v) like 'ARRAY%'")
    is_text = lambda k: f"coalesce(schema_of_variant(try_variant_get(item, '$.{k}', 'variant')) = 'STRING', false)"
    of = lambda k: F.expr(f"case when {is_text(k)} then try_variant_get(item, '$.{k}', 'string') end")
    out = items.select(
        "sid", "ord", "n",
        F.expr("schema_of_variant(item) like 'OBJECT%'").alias("object"),
        F.expr("case when schema_of_variant(try_variant_get(item, '$.turn', 'variant')) = 'BIGINT' then try_variant_get(item, '$.turn', 'bigint') end").alias("turn"),
        of("subject").alias("subj"), of("predicate").alias("pred"), of("object").alias("obj"), of("kind").alias("kind"), of("cardinality").alias("card"),
    )
    reason = F.when(~F.coalesce("object", F.lit(False)), "not_an_object").otherwise(drop_reason(F.col("n")))
    return out.withColumn("reason", reason).drop("object", "n")


def instance_sessions(instances: DataFrame) -> DataFrame:
    """(question_id, pos, nth, sid, ts): the sessions of an instance in order of time, ties as stored.

    ids and dates are paired by position; a different number of them fails. A date that cannot be
    read fails too. Repeated instances count once.
    """
    once = instances.select("question_id", "haystack_session_ids", "haystack_dates").where("haystack_session_ids is not null").distinct()
    same = F.size("haystack_session_ids") == F.size("haystack_dates")
    pairs = F.when(F.coalesce(same, F.lit(False)), F.arrays_zip(F.col("haystack_session_ids").alias("sid"), F.col("haystack_dates").alias("date")))
    pairs = F.coalesce(pairs, F.raise_error(F.concat(F.coalesce("question_id", F.lit("?")), F.lit(": sessions and dates differ in number"))).cast("array<struct<sid:string,date:string>>"))
    timed = F.array_sort(F.transform(pairs, lambda p, i: F.struct(timeparse.epoch(p["date"]).alias("ts"), i.alias("pos"), p["sid"].alias("sid"))))
    out = once.select("question_id", F.posexplode(timed).alias("nth", "s"))
    return out.select("question_id", F.col("s.pos").alias("pos"), "nth", F.col("s.sid").alias("sid"), F.col("s.ts").alias("ts"))


def out_of_order(slots: DataFrame) -> DataFrame:
    """One row: instances, how many are stored out of order, how many still are after sorting (must be none)."""
    stored = F.lag("ts").over(Window.partitionBy("question_id").orderBy("pos")) > F.col("ts")
    loaded = F.lag("ts").over(Window.partitionBy("question_id").orderBy("nth")) > F.col("ts")
    per = slots.select("question_id", stored.cast("int").alias("a"), loaded.cast("int").alias("b")).groupBy("question_id").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return per.agg(F.count("*").alias("instances"), F.coalesce(F.sum("a"), F.lit(0)).alias("stored_unsorted"), F.coalesce(F.sum("b"), F.lit(0)).alias("loaded_unsorted"))


def session_prints(turns: DataFrame) -> DataFrame:
    """(sid, turns, chars, print): a session's size and a fingerprint of its turns, in one pass without gathering them.

    The fingerprint combines hashes of index, role and content, so it changes with any of them;
    repeated turns count once.
    """
    once = turns.where("session_id is not null").select("session_id", "idx", "role", F.coalesce("content", F.lit("")).alias("content")).distinct()
    digest = F.conv(F.substring(F.md5(F.concat_ws("\0", F.col("idx").cast("string"), "role", "content")), 1, 15), 16, 10).cast("bigint")
    return once.groupBy(F.col("session_id").alias("sid")).agg(
        F.count("*").alias("turns"), F.sum(F.length("content")).alias("chars"), F.bit_xor(digest).alias("print")
    )


def session_collisions(turns: DataFrame) -> DataFrame:
    """(sid, idx, texts): places in a session under which more than one text is stored."""
    return (
        turns.where("session_id is not null")
        .select(F.col("session_id").alias("sid"), "idx", F.md5(F.coalesce("content", F.lit(""))).alias("h"))
        .groupBy("sid", "idx")
        .agg(F.countDistinct("h").alias("texts"))
        .where("texts > 1")
    )


def upper_median(df: DataFrame, column: str) -> DataFrame:
    """One row (least, median, most); the median is the element at n div 2 of the sorted values, exact.

    Works on the counts of distinct values, in ranges: one row for each range tells where it
    begins, and only inside ranges values are sorted.
    """
    sizes = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    ranged = materialize(sizes.repartitionByRange(F.col("v")).withColumn("part", F.spark_partition_id()))
    parts = ranged.groupBy("part").agg(F.sum("n").alias("size"))
    every = Window.orderBy("part")  # as many rows as there are shuffle partitions
    begins = parts.select("part", (F.sum("size").over(every) - F.col("size")).alias("begin"), F.floor(F.sum("size").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) / 2).alias("mid"))
    upto = F.col("begin") + F.sum("n").over(Window.partitionBy("part").orderBy("v"))
    placed = ranged.join(begins, "part").select("v", upto.alias("upto"), "mid")
    return placed.agg(F.min("v").alias("least"), F.min(F.when(F.col("upto") > F.col("mid"), F.col("v"))).alias("median"), F.max("v").alias("most"))


def dataset_stats(instances: DataFrame, slots: DataFrame, prints: DataFrame) -> DataFrame:
    """One row of counts over instances, session slots, distinct sessions, turns and characters."""
    a = instances.select("question_id").distinct().agg(F.count("*").alias("instances"), F.count_if(report.is_abstention("question_id")).alias("abstention"))
    b = slots.agg(F.count("*").alias("session_slots"), F.countDistinct("sid").alias("unique_sessions"))
    used = prints.join(slots.select("sid").distinct(), "sid", "left_semi")
    c = used.agg(F.coalesce(F.sum("turns"), F.lit(0)).alias("turns_in_unique"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars_in_unique"))
    one = F.lit(1).alias("one")
    joined = a.select("*", one).join(b.select("*", one), "one").join(c.select("*", one), "one").drop("one")
    return joined.withColumn("reuse_factor", F.round(F.try_divide("session_slots", "unique_sessions"), 2)).withColumn(
        "approx_tokens", F.floor(F.col("chars_in_unique") / 4)
    )
