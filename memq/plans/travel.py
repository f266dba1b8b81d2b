"""Queries on facts that changed and what was current at each change."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memq.functions import timeparse
from memq.operators import asof, chains, timetravel
from memq.plans.chains import LINKS
from memq.plans.common import LATEST_CLAIMS, latest_claims


def changed_facts(spark: SparkSession, d: str) -> DataFrame:
    return timetravel.changed_facts(latest_claims(spark, d))


def _chain_lengths(spark: SparkSession, d: str) -> DataFrame:
    """How many claims the newest one of each fact replaced, up to five."""
    claims = latest_claims(spark, d)
    newest = timetravel.mentions(claims).groupBy("pred", "subj").agg(F.max_by("line_no", F.struct("ts", "line_no")).alias("start"))
    reached = chains.walk(chains.supersedes(claims)).groupBy("start").agg(F.count("*").alias("chain"))
    return newest.join(reached, "start").select("pred", "subj", "chain")


def ranked_facts(spark: SparkSession, d: str) -> DataFrame:
    """The facts most worth showing; the cut of the probe is the feature."""
    return timetravel.ranked_facts(changed_facts(spark, d), _chain_lengths(spark, d))


def change_marks(spark: SparkSession, d: str) -> DataFrame:
    return timetravel.change_marks(latest_claims(spark, d), changed_facts(spark, d))


def timetravel_reads(spark: SparkSession, d: str) -> DataFrame:
    """What each changed fact was at each mark, with its day; nothing before the first mention."""
    claims = latest_claims(spark, d)
    marks = change_marks(spark, d)
    said = timetravel.mentions(claims)
    tips = asof.as_known(marks, said, ["pred", "subj"], "mark", "ts", ["line_no"], ["line_no", "obj"])
    out = marks.distinct().join(tips, ["pred", "subj", "mark"], "left")
    return out.select("pred", "subj", "mark", timeparse.day("mark").alias("day"), "line_no", "obj")


def timetravel_chain(spark: SparkSession, d: str) -> DataFrame:
    """The values behind the newest one of each changed fact, along up to five links."""
    claims = latest_claims(spark, d)
    facts = changed_facts(spark, d).select("pred", "subj")
    newest = timetravel.mentions(claims).join(facts, ["pred", "subj"]).groupBy("pred", "subj").agg(F.max_by("line_no", F.struct("ts", "line_no")).alias("start"))
    steps = chains.walk(chains.supersedes(claims), newest.select("start"))
    older = claims.select(F.col("line_no").alias("node"), "obj", timeparse.day("ts").alias("day"))
    return newest.join(steps, "start").join(older, "node").select("pred", "subj", "hop", "obj", "day")


QUERIES = {f.__name__: f for f in (changed_facts, ranked_facts, change_marks, timetravel_reads, timetravel_chain)}

_FACTS = f"""{LATEST_CLAIMS},
m as (select pred, subj, obj, ts, line_no from claims0 where pred is not null and obj is not null and ts is not null),
facts as (select pred, subj, count(distinct obj) as values, count(*) as mentions, max(ts) - min(ts) as span from m group by 1, 2
  having count(distinct obj) between 2 and 8 and count(*) <= 40)"""
_MARKS = f"""{_FACTS},
o as (select pred, subj, ts, obj, row_number() over (partition by pred, subj order by ts, line_no) as k, count(*) over (partition by pred, subj) as n from m join facts using (pred, subj)),
f as (select pred, subj, k, ts - 86400 as begins, [ts] as marked, obj as seen from o where k = 1 union all
  select o.pred, o.subj, o.k, f.begins, case when o.obj is distinct from seen and not list_contains(marked, o.ts) then list_append(marked, o.ts) else marked end,
    case when o.obj is distinct from seen and not list_contains(marked, o.ts) then o.obj else seen end
  from f join o on o.pred = f.pred and o.subj = f.subj and o.k = f.k + 1),
whole as (select f.* from f join o using (pred, subj, k) where k = n),
thin as (select pred, subj, begins, case when len(marked) > 6 then list_transform(range(0, 6), lambda i: marked[cast(round_even(i * (len(marked) - 1) / 5.0, 0) as int) + 1]) else marked end as marked from whole),
marks as (select pred, subj, unnest(list_prepend(begins, marked)) as mark from thin)"""

SQL = {
    "change_marks": f"with recursive {_MARKS} select pred, subj, mark from marks",
    "timetravel_reads": f"""with recursive {_MARKS}
select t.pred, t.subj, t.mark, strftime(to_timestamp(t.mark) at time zone 'UTC', '%Y-%m-%d') as day, m.line_no, m.obj from (select distinct pred, subj, mark from marks) t
left join m on m.pred = t.pred and m.subj = t.subj and m.ts <= t.mark qualify row_number() over (partition by t.pred, t.subj, t.mark order by m.ts desc nulls last, m.line_no desc) = 1""",
    "timetravel_chain": f"""with recursive {LINKS},
m as (select pred, subj, obj, ts, line_no from claims0 where pred is not null and obj is not null and ts is not null),
facts as (select pred, subj from m group by 1, 2 having count(distinct obj) between 2 and 8 and count(*) <= 40),
newest as (select pred, subj, line_no as start from m join facts using (pred, subj) qualify row_number() over (partition by pred, subj order by ts desc, line_no desc) = 1),
w as (select later as start, 1 as hop, earlier as node from links where later in (select start from newest) union all select w.start, w.hop + 1, l.earlier from w join links l on l.later = w.node where w.hop < 5)
select n.pred, n.subj, hop, c.obj, coalesce(strftime(to_timestamp(c.ts) at time zone 'UTC', '%Y-%m-%d'), 'unknown') as day from newest n join w using (start) join claims0 c on c.line_no = node""",
    "changed_facts": f"with {_FACTS} select * from facts",
    "ranked_facts": f"""with recursive {LINKS},
w as (select later as start, 1 as hop, earlier as node from links union all select w.start, w.hop + 1, l.earlier from w join links l on l.later = w.node where w.hop < 5),
reached as (select start, count(*) as chain from w group by 1),
m as (select pred, subj, obj, ts, line_no from claims0 where pred is not null and obj is not null and ts is not null),
newest as (select pred, subj, line_no as start from m qualify row_number() over (partition by pred, subj order by ts desc, line_no desc) = 1),
facts as (select pred, subj, count(distinct obj) as values, count(*) as mentions, max(ts) - min(ts) as span from m group by 1, 2
  having count(distinct obj) between 2 and 8 and count(*) <= 40),
probed as (select * from facts order by values, span desc, pred, subj limit 40)
select p.*, coalesce(chain, 0) as chain, cast(row_number() over (order by coalesce(chain, 0) desc, values, span desc, p.pred, p.subj) as int) as place
from probed p left join newest n on n.pred = p.pred and n.subj = p.subj left join reached r on r.start = n.start""",
}
