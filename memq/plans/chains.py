"""Queries over replacement links and as-of reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memq.functions import text
from memq.operators import asof, chains
from memq.plans.common import LATEST_CLAIMS, entity, latest_claims, normal_object, table


def predicate_cardinality(spark: SparkSession, d: str) -> DataFrame:
    return chains.predicate_cardinality(table(spark, d, "claims"))


def predicate_disputes(spark: SparkSession, d: str) -> DataFrame:
    return chains.disputes(table(spark, d, "claims"))


def supersedes_links(spark: SparkSession, d: str) -> DataFrame:
    return chains.supersedes(latest_claims(spark, d))


def chain_walk(spark: SparkSession, d: str) -> DataFrame:
    return chains.walk(supersedes_links(spark, d))


def chain_terminal(spark: SparkSession, d: str) -> DataFrame:
    """Walks of up to three hops that end at a claim of one predicate; the filter looks at the end only."""
    ends = latest_claims(spark, d).where("pred = 'lives_in'").select(F.col("line_no").alias("node"))
    return chains.walk(supersedes_links(spark, d), hops=3).join(ends, "node", "left_semi")


def chain_paths(spark: SparkSession, d: str) -> DataFrame:
    p = chains.paths(supersedes_links(spark, d))
    return p.withColumn("path", F.array_join(F.transform("path", lambda x: x.cast("string")), ">"))


def two_hops(spark: SparkSession, d: str) -> DataFrame:
    a = supersedes_links(spark, d)
    b = a.select(F.col("later").alias("earlier"), F.col("earlier").alias("earliest"))
    return a.join(b, "earlier")


def optional_chain(spark: SparkSession, d: str) -> DataFrame:
    """Every claim of a single-valued predicate with what it replaced, null where it replaced nothing."""
    c = latest_claims(spark, d)
    one = chains.predicate_cardinality(c).where("resolved = 'one'").select("pred")
    links = chains.supersedes(c).withColumnRenamed("later", "line_no")
    return c.select("line_no", "pred").join(one, "pred", "left_semi").join(links, "line_no", "left")


def tip_asof(spark: SparkSession, d: str) -> DataFrame:
    return asof.tips(table(spark, d, "instances"), table(spark, d, "question_targets"), table(spark, d, "claims"))


def hop_statement(spark: SparkSession, d: str) -> DataFrame:
    """Each claim with the turn it cites; null where the turn was never stored."""
    t = table(spark, d, "turns").where("session_id is not null and idx is not null").groupBy(F.col("session_id").alias("sid"), F.col("idx").alias("turn")).agg(F.max("role").alias("role"))
    return table(spark, d, "claims").select("line_no", "sid", "turn").join(t, ["sid", "turn"], "left")


def hop_reverse(spark: SparkSession, d: str) -> DataFrame:
    """How many claims cite each turn."""
    c = table(spark, d, "claims").groupBy("sid", "turn").agg(F.count("*").alias("claims"))
    t = table(spark, d, "turns").where("session_id is not null and idx is not null").select(F.col("session_id").alias("sid"), F.col("idx").alias("turn")).distinct()
    return t.join(c, ["sid", "turn"], "left").select("sid", "turn", F.coalesce("claims", F.lit(0)).alias("claims"))


def property_filters(spark: SparkSession, d: str) -> DataFrame:
    """Equality, inequality, range, prefix and membership on labelled rows, with counts."""
    c = table(spark, d, "claims")
    return c.agg(
        F.count("*").alias("all_claims"),
        F.count_if((F.col("pred") == "lives_in") & (F.col("subj") == "user")).alias("two_properties"),
        F.count_if(F.col("kind") != "fact").alias("not_fact"),
        F.count_if((F.col("ts") > 1_680_000_000) & (F.col("ts") <= 1_700_000_000)).alias("interval"),
        F.count_if((F.col("turn") < 2) | (F.col("turn") >= 10)).alias("either"),
        F.count_if(F.col("sid").startswith("chat-")).alias("prefixed"),
        F.count_if(F.col("pred").isin("owns", "likes")).alias("member"),
    )


def union_distinct(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "claims")
    return c.where("pred = 'lives_in'").select("sid").union(c.where("pred = 'works_at'").select("sid")).distinct()


def ordered_page(spark: SparkSession, d: str) -> DataFrame:
    """ORDER BY, SKIP and LIMIT are the feature: one page of claims by key."""
    return latest_claims(spark, d).select("nkey", "ts").orderBy("nkey").offset(100).limit(50)


def chain_summary(spark: SparkSession, d: str) -> DataFrame:
    """One row: links, claims, entities and how predicates resolved."""
    c = latest_claims(spark, d)
    one = F.lit(1).alias("one")
    links = chains.supersedes(c).agg(F.count("*").alias("links"), one)
    said = c.agg(F.count("*").alias("claims"), F.countDistinct(text.entity("subj")).alias("entities"), one)
    votes = chains.predicate_cardinality(c).agg(
        F.count_if(F.col("resolved") == "one").alias("single_valued"), F.count_if(F.col("resolved") == "many").alias("accumulating"),
        F.count_if((F.col("one") > 0) & (F.col("many") > 0)).alias("disputed"), one,
    )
    return links.join(said, "one").join(votes, "one").drop("one")


QUERIES = {
    f.__name__: f
    for f in (
        chain_summary, predicate_cardinality, predicate_disputes, supersedes_links, chain_walk, chain_terminal, chain_paths, two_hops, optional_chain,
        tip_asof, hop_statement, hop_reverse, property_filters, union_distinct, ordered_page,
    )
}

_VOTES = "votes as (select pred, count(*) filter (where coalesce(card = 'one', false)) as one, count(*) filter (where not coalesce(card = 'one', false)) as many from {t} where pred is not null group by 1)"
LINKS = f"""{LATEST_CLAIMS},
{_VOTES.format(t="claims0")},
r as (select pred, {entity("subj")} as ekey, ts, coalesce(sid, '') as sid, coalesce(turn, -1) as turn, {normal_object("obj")} as norm, line_no
  from claims0 where pred in (select pred from votes where many = 0 and one > 0)),
heads as (select * from (select * from r where ekey is not null and ts is not null and norm is not null)
  qualify lag(norm) over (partition by ekey, pred order by ts, sid, turn, line_no) is distinct from norm),
links as (select * from (select line_no as later, lag(line_no) over (partition by ekey, pred order by ts, sid, turn, line_no) as earlier from heads) where earlier is not null)"""
_WALK = f"""with recursive {LINKS},
w as (select later as start, 1 as hop, earlier as node from links union all
  select w.start, w.hop + 1, l.earlier from w join links l on l.later = w.node where w.hop < @n@)"""

SQL = {
    "chain_summary": f"""with {LINKS} select (select count(*) from links) as links, (select count(*) from claims0) as claims,
  (select count(distinct {entity("subj")}) from claims0) as entities, count(*) filter (where many = 0 and one > 0) as single_valued,
  count(*) filter (where not (many = 0 and one > 0)) as accumulating, count(*) filter (where one > 0 and many > 0) as disputed from votes""",
    "predicate_cardinality": f"with {_VOTES.format(t='claims')} select *, case when many = 0 and one > 0 then 'one' else 'many' end as resolved from votes",
    "predicate_disputes": f"with {_VOTES.format(t='claims')} select * from votes where one > 0 and many > 0",
    "supersedes_links": f"with {LINKS} select later, earlier from links",
    "chain_walk": _WALK.replace("@n@", "5") + " select * from w",
    "chain_terminal": _WALK.replace("@n@", "3") + " select * from w where node in (select line_no from claims0 where pred = 'lives_in')",
    "chain_paths": f"""with {LINKS}
select later as start, earlier as target, 1 as hops, later || '>' || earlier as path from links
union all select a.later, b.earlier, 2, a.later || '>' || a.earlier || '>' || b.earlier from links a join links b on b.later = a.earlier
union all select a.later, c.earlier, 3, a.later || '>' || a.earlier || '>' || b.earlier || '>' || c.earlier
  from links a join links b on b.later = a.earlier join links c on c.later = b.earlier""",
    "two_hops": f"with {LINKS} select a.later, a.earlier, b.earlier as earliest from links a join links b on b.later = a.earlier",
    "optional_chain": f"""with {LINKS} select line_no, pred, earlier from claims0 left join links on later = line_no
where pred in (select pred from votes where many = 0 and one > 0)""",
    "tip_asof": f"""
with said as (select {entity("subj")} as ekey, pred, ts, sid, turn, line_no from claims where ts is not null and pred is not null),
asked as (select distinct question_id, asked_at from instances where question_id is not null and asked_at is not null),
aims as (select distinct question_id, {entity("subj")} as ekey, pred from question_targets)
select question_id, cast(row_number() over (partition by question_id, ekey, pred order by ts desc, sid desc, turn desc, line_no desc) as int) as nth, line_no, ts
from asked join aims using (question_id) join said using (ekey, pred) where ts <= asked_at
qualify row_number() over (partition by question_id, ekey, pred order by ts desc, sid desc, turn desc, line_no desc) <= 5""",
    "hop_statement": """
with t as (select session_id as sid, idx as turn, max(role) as role from turns where session_id is not null and idx is not null group by 1, 2)
select line_no, sid, turn, role from claims left join t using (sid, turn)""",
    "hop_reverse": """
select t.sid, t.turn, count(c.line_no) as claims from (select distinct session_id as sid, idx as turn from turns where session_id is not null and idx is not null) t
left join claims c on c.sid = t.sid and c.turn = t.turn group by 1, 2""",
    "property_filters": """
select count(*) as all_claims, count(*) filter (where pred = 'lives_in' and subj = 'user') as two_properties, count(*) filter (where kind <> 'fact') as not_fact,
  count(*) filter (where ts > 1680000000 and ts <= 1700000000) as interval, count(*) filter (where turn < 2 or turn >= 10) as either,
  count(*) filter (where starts_with(sid, 'chat-')) as prefixed, count(*) filter (where pred in ('owns', 'likes')) as member from claims""",
    "union_distinct": "select sid from claims where pred = 'lives_in' union select sid from claims where pred = 'works_at'",
    "ordered_page": f"with {LATEST_CLAIMS} select nkey, ts from claims0 order by nkey limit 50 offset 100",
}
