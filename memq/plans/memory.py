"""Queries that build memory: statements, entities, valid claims, instances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memq.functions import text
from memq.operators import memory
from memq.plans.common import BLANK, LATEST_ANSWERS, LATEST_CLAIMS, entity, latest_answers, latest_claims, predicate, spaced, strip, table


def statements(spark: SparkSession, d: str) -> DataFrame:
    return memory.statements(table(spark, d, "turns"), table(spark, d, "sessions"))


def role_rejects(spark: SparkSession, d: str) -> DataFrame:
    """Turns, and documents written as turns whose role is their kind: what is neither user nor assistant."""
    kinds = table(spark, d, "documents").select(F.col("doc_kind").alias("role"))
    return memory.role_rejects(table(spark, d, "turns").select("role").unionByName(kinds))


def sessions_latest(spark: SparkSession, d: str) -> DataFrame:
    s = memory.last_rows(table(spark, d, "sessions"), ["session_id"], "line_no")
    return s.select(F.col("session_id").alias("sid"), "ts", "turns")


def sessions_without_turns(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sessions").select(F.col("session_id").alias("sid")).where("sid is not null").distinct()
    return s.join(table(spark, d, "turns").select(F.col("session_id").alias("sid")).distinct(), "sid", "left_anti")


def entities(spark: SparkSession, d: str) -> DataFrame:
    return memory.entities(table(spark, d, "claims"))


def claims_latest(spark: SparkSession, d: str) -> DataFrame:
    return latest_claims(spark, d).select("line_no", "nkey", "subj", "pred", "obj", "ts")


def answers_latest(spark: SparkSession, d: str) -> DataFrame:
    return latest_answers(spark, d).select("line_no", "question_id", "status", "answer")


def claim_validation_drops(spark: SparkSession, d: str) -> DataFrame:
    return memory.claim_drops(memory.checked_claims(table(spark, d, "claims"), table(spark, d, "turns")))


def claim_dedupe(spark: SparkSession, d: str) -> DataFrame:
    valid = memory.valid_claims(memory.checked_claims(table(spark, d, "claims"), table(spark, d, "turns")))
    return valid.select("line_no", "subj", "pred", "obj", "kind", "card", "sid", "turn", "ts")


def instance_sessions(spark: SparkSession, d: str) -> DataFrame:
    return memory.instance_sessions(table(spark, d, "instances"))


def out_of_order(spark: SparkSession, d: str) -> DataFrame:
    return memory.out_of_order(instance_sessions(spark, d))


def session_collisions(spark: SparkSession, d: str) -> DataFrame:
    """Places under which more than one text is stored, by exact id over turns and by the words of the id over session dates."""
    turns = table(spark, d, "turns").select("session_id", "idx", "content")
    dates = table(spark, d, "sessions").select(text.spaced_words("session_id").alias("session_id"), F.lit(-1).alias("idx"), F.col("session_date").alias("content"))
    return memory.session_collisions(turns.unionByName(dates))


def dataset_stats(spark: SparkSession, d: str) -> DataFrame:
    i, t = table(spark, d, "instances"), table(spark, d, "turns")
    return memory.dataset_stats(i, memory.instance_sessions(i), memory.session_prints(t))


def turns_per_session(spark: SparkSession, d: str) -> DataFrame:
    return memory.upper_median(memory.session_prints(table(spark, d, "turns")), "turns")


def question_types(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "instances").select("question_id", F.coalesce("question_type", F.lit("unknown")).alias("question_type")).distinct()
    return i.groupBy("question_type").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        statements, role_rejects, sessions_latest, sessions_without_turns, entities, claims_latest, answers_latest, claim_validation_drops,
        claim_dedupe, instance_sessions, out_of_order, session_collisions, dataset_stats, turns_per_session, question_types,
    )
}

_BLANK = lambda c: f"coalesce(trim(regexp_replace({c}, '{BLANK}', ' ', 'g')) = '', true)"
_CHECKED = f"""
size as (select session_id as sid, max(idx) + 1 as n from turns where session_id is not null and idx is not null group by 1),
checked as (select c.* replace (case when card in ('one', 'many') then card else 'many' end as card), not coalesce(card in ('one', 'many'), false) as defaulted,
  case when turn is null then 'turn_not_an_integer'
    when not (turn >= 0 and turn < coalesce(n, 0)) then 'turn_out_of_range'
    when {_BLANK("subj")} or {_BLANK("pred")} or {_BLANK("obj")} then 'missing_or_empty_field'
    when length(subj) > 120 or length(pred) > 60 or length(obj) > 400 then 'field_too_long'
    when not coalesce(kind in ('fact', 'preference', 'event', 'plan'), false) then 'bad_kind' end as reason
  from claims c left join size using (sid)),
firsts as (select *, row_number() over (partition by sid, turn, {entity("subj")}, {predicate("pred")}, lower(obj) order by line_no) as nth from checked where reason is null)"""
_SLOTS = r"""
i as (select distinct question_id, haystack_session_ids as ids, haystack_dates as dates from instances where haystack_session_ids is not null),
p as (select question_id, unnest(range(0, len(ids))) as pos, ids, dates from i),
t as (select question_id, cast(pos as int) as pos, ids[pos + 1] as sid,
  cast(epoch(strptime(regexp_replace(dates[pos + 1], ' \([A-Za-z]{3}\) ', ' '), '%Y/%m/%d %H:%M')) as bigint) as ts from p),
slots as (select question_id, pos, cast(row_number() over (partition by question_id, ids order by ts, pos) - 1 as int) as nth, sid, ts
  from (select t.*, p.ids from t join p using (question_id, pos)))"""
_PRINTS = """
u as (select distinct session_id as sid, idx, role, coalesce(content, '') as content from turns where session_id is not null),
prints as (select sid, count(*) as turns, cast(sum(length(content)) as bigint) as chars from u group by 1)"""

SQL = {
    "statements": """
with s as (select session_id as sid, max(ts) as ts from sessions where session_id is not null group by 1),
t as (select session_id as sid, idx, coalesce(content, '') as content, role from turns
  where role in ('user', 'assistant') and session_id is not null and idx is not null
  qualify row_number() over (partition by session_id, idx order by coalesce(content, '') desc, role desc) = 1)
select sid || '|' || idx as nkey, greatest(1, ('0x' || substr(sha256('Statement|' || sid || '|' || idx), 1, 13))::bigint) as id,
  sid, idx, role, ts, greatest(1, cast(ceil(length(content) / 12000.0) as int)) as nchunks, length(content) as chars from t left join s using (sid)""",
    "role_rejects": "select role, count(*) as n from (select role from turns union all select doc_kind from documents) where not coalesce(role in ('user', 'assistant'), false) group by 1",
    "sessions_latest": "select session_id as sid, ts, turns from sessions where session_id is not null qualify row_number() over (partition by session_id order by line_no desc) = 1",
    "sessions_without_turns": "select distinct session_id as sid from sessions where session_id is not null and session_id not in (select session_id from turns where session_id is not null)",
    "entities": f"""
select ekey, greatest(1, ('0x' || substr(sha256('Entity|' || ekey), 1, 13))::bigint) as id, arg_max(subj, line_no) as name, count(*) as claims
from (select {entity("subj")} as ekey, subj, line_no from claims) where ekey is not null group by 1""",
    "claims_latest": f"with {LATEST_CLAIMS} select line_no, nkey, subj, pred, obj, ts from claims0",
    "answers_latest": f"with {LATEST_ANSWERS} select line_no, question_id, status, answer from answers0",
    "claim_validation_drops": f"""
with {_CHECKED}
select reason, count(*) as n from checked where reason is not null group by 1
union all select 'cardinality_missing_defaulted_to_many', count(*) from checked where reason is null and defaulted having count(*) > 0
union all select 'duplicate_in_response', count(*) from firsts where nth > 1 having count(*) > 0""",
    "claim_dedupe": f"with {_CHECKED} select line_no, {strip('subj')} as subj, {predicate('pred')} as pred, {strip('obj')} as obj, kind, card, sid, turn, ts from firsts where nth = 1",
    "instance_sessions": f"with {_SLOTS} select question_id, pos, nth, sid, ts from slots",
    "out_of_order": f"""
with {_SLOTS}, w as (select question_id, lag(ts) over (partition by question_id order by pos) > ts as a, lag(ts) over (partition by question_id order by nth) > ts as b from slots),
g as (select question_id, max(coalesce(a, false)::int) as a, max(coalesce(b, false)::int) as b from w group by 1)
select count(*) as instances, cast(sum(a) as bigint) as stored_unsorted, cast(sum(b) as bigint) as loaded_unsorted from g""",
    "session_collisions": f"""
select session_id as sid, idx, count(distinct coalesce(content, '')) as texts
from (select session_id, idx, content from turns union all select {spaced("session_id")}, -1, session_date from sessions) where session_id is not null
group by 1, 2 having count(distinct coalesce(content, '')) > 1""",
    "dataset_stats": f"""
with {_SLOTS}, {_PRINTS},
c as (select coalesce(sum(turns), 0)::bigint as turns_in_unique, coalesce(sum(chars), 0)::bigint as chars_in_unique from prints where sid in (select sid from slots))
select (select count(distinct question_id) from instances) as instances,
  (select count(distinct question_id) from instances where question_id like '%\\_abs' escape '\\') as abstention,
  (select count(*) from slots) as session_slots, (select count(distinct sid) from slots) as unique_sessions,
  turns_in_unique, chars_in_unique, round((select count(*) / count(distinct sid) from slots), 2) as reuse_factor, chars_in_unique // 4 as approx_tokens from c""",
    "turns_per_session": f"""
with {_PRINTS} select min(turns) as least, (list_sort(list(turns)))[cast(count(*) // 2 as int) + 1] as median, max(turns) as most from prints""",
    "question_types": "select question_type, count(*) as n from (select distinct question_id, coalesce(question_type, 'unknown') as question_type from instances) group by 1",
}
