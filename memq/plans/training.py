"""Queries over attribute history, as-known state and delivery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from memq.operators import asof, delivery, history
from memq.plans.common import entity
from memq.plans.common import table as _t


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_history(spark, d).drop("value")


def p2_history(spark: SparkSession, d: str) -> DataFrame:
    return history.claim_history(_t(spark, d, "claims"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return delivery.copies(_t(spark, d, "answers"), "question_id", "line_no", "delivered_at")


def p4_exactly_once(spark: SparkSession, d: str) -> DataFrame:
    kept = delivery.exactly_once(_t(spark, d, "answers"), "question_id", "line_no", "delivered_at")
    return kept.select("line_no", "batch_id", "question_id", "status", "answer")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_facts(spark, d).select("question_id", "sid", "turn")


def p6_facts(spark: SparkSession, d: str) -> DataFrame:
    return asof.question_facts(_t(spark, d, "instances"), _t(spark, d, "question_targets"), _t(spark, d, "claims")).drop("asked_at")


QUERIES = {f.__name__: f for f in (p2_found, p2_history, p4_found, p4_exactly_once, p6_found, p6_facts)}

def value(c: str) -> str:
    return rf"""nullif(array_to_string(list_sort(list_filter(list_transform(
  regexp_split_to_array(lower({c}), '[;|]'), lambda x: trim(regexp_replace(x, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))), lambda x: x <> '')), ';'), '')"""


_USABLE = f"""usable as (select * from (select {entity("subj")} as ekey, pred, {value("obj")} as value, ts, sid, turn
  from claims) where ekey is not null and pred is not null and value is not null and ts is not null)"""
_HISTORY = f"""
with {_USABLE},
one as (select pred from claims group by pred having count(*) = count(*) filter (where card = 'one')),
last as (select ekey, pred, ts, value from usable semi join one using (pred)
  qualify row_number() over (partition by ekey, pred, ts order by sid desc, turn desc, value desc) = 1),
kept as (select * from last qualify lag(value) over (partition by ekey, pred order by ts) is distinct from value)
select ekey, pred, @value@ ts as valid_from, coalesce(lead(ts) over (partition by ekey, pred order by ts), -1) as valid_to from kept"""
_FACTS = f"""
with {_USABLE},
asked as (select distinct question_id, asked_at from instances where question_id is not null and asked_at is not null),
aims as (select distinct question_id, {entity("subj")} as ekey, pred from question_targets),
found as (select a.question_id, t.ekey, t.pred, u.ts, u.sid, u.turn, u.value
  from asked a join aims t using (question_id) join usable u on u.ekey = t.ekey and u.pred = t.pred and u.ts <= a.asked_at
  qualify row_number() over (partition by a.question_id, t.ekey, t.pred order by u.ts desc, u.sid desc, u.turn desc, u.value desc) = 1)"""

SQL = {
    "p2_found": _HISTORY.replace("@value@", ""),
    "p2_history": _HISTORY.replace("@value@", "value,"),
    "p4_found": """
select a.question_id, a.line_no from answers a
join (select question_id, max(line_no) as last from answers group by question_id) b using (question_id) where a.line_no < b.last""",
    "p4_exactly_once": """
select line_no, batch_id, question_id, status, answer from answers
qualify question_id is null or row_number() over (partition by question_id order by line_no desc) = 1""",
    "p6_found": _FACTS + " select question_id, sid, turn from found",
    "p6_facts": _FACTS + " select * from found",
}
