"""Scalar expressions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memq.functions import keys, report, terms, text, timeparse
from memq.operators import memory
from memq.plans.common import entity, normal_object, predicate, table


def tokens_stemmed(spark: SparkSession, d: str) -> DataFrame:
    return terms.explode_terms(table(spark, d, "documents"), "text").groupBy("term").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


def normalise_object(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "claims").where("obj is not null")
    return c.groupBy(keys.normal_object("obj").alias("norm")).agg(F.count("*").alias("n"), F.countDistinct("obj").alias("writings"))


def entity_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "claims").groupBy(text.entity("subj").alias("ekey"), keys.predicate("pred").alias("pred")).agg(F.count("*").alias("n"))


def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "turns").where("session_id is not null and idx is not null").select(keys.statement_key("session_id", "idx").alias("nkey")).distinct()
    return t.select("nkey", keys.stable_id("Statement", "nkey").alias("id"))


def id_collisions(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of statements cut to four digits, which do collide; whole ones must not."""
    ids = stable_ids(spark, d)
    return keys.collisions(ids.unionByName(ids.select("nkey", (F.col("id") % 10_000).alias("id"))), "id", "nkey")


def claim_keys(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "claims").where("obj is not null")
    return c.select("line_no", keys.claim_key().alias("nkey"))


def session_dates(spark: SparkSession, d: str) -> DataFrame:
    e = timeparse.try_epoch("session_date")
    s = table(spark, d, "sessions").select("line_no", "ts", e.alias("epoch"))
    return s.select("line_no", "epoch", timeparse.human_date("epoch").alias("day"), timeparse.minute("ts").alias("at"), (F.col("epoch") == F.col("ts")).alias("agrees"))


def text_chunks(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "turns").where("content is not null").select("session_id", "idx", "content").distinct()
    parts = t.select("session_id", "idx", F.posexplode(report.chunks("content")).alias("part", "chunk"))
    return parts.select("session_id", "idx", "part", F.length("chunk").cast("bigint").alias("chars"), F.md5("chunk").alias("digest"))


def session_prints(spark: SparkSession, d: str) -> DataFrame:
    return memory.session_prints(table(spark, d, "turns"))


def one_line(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where("text is not null")
    return t.select("doc_id", report.one_line("text", 80).alias("line"), report.approx_tokens("text").alias("tokens"))


QUERIES = {f.__name__: f for f in (tokens_stemmed, normalise_object, entity_key, stable_ids, id_collisions, claim_keys, session_dates, text_chunks, session_prints, one_line)}

_STOP = ", ".join(f"'{w}'" for w in terms.STOPWORDS)


def terms_sql(source: str, columns: str, c: str) -> str:
    """Rows of (columns, term) from a text column."""
    return f"""(select {columns}, {terms.stem_sql("w")} as term from (
      select {columns}, unnest(regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+')) as w from {source}) where w not in ({_STOP}))"""


SQL = {
    "tokens_stemmed": f"select term, count(*) as n, count(distinct doc_id) as docs from {terms_sql('documents', 'doc_id', 'text')} group by term",
    "normalise_object": f"select {normal_object('obj')} as norm, count(*) as n, count(distinct obj) as writings from claims where obj is not null group by 1",
    "entity_key": f"select {entity('subj')} as ekey, {predicate('pred')} as pred, count(*) as n from claims group by 1, 2",
    "stable_ids": """
select nkey, greatest(1, ('0x' || substr(sha256('Statement|' || nkey), 1, 13))::bigint) as id
from (select distinct session_id || '|' || idx as nkey from turns where session_id is not null and idx is not null)""",
    "id_collisions": """
with i as (select nkey, greatest(1, ('0x' || substr(sha256('Statement|' || nkey), 1, 13))::bigint) as id
  from (select distinct session_id || '|' || idx as nkey from turns where session_id is not null and idx is not null))
select id, min(nkey) as a, max(nkey) as b from (select * from i union all select nkey, id % 10000 from i) group by id having min(nkey) <> max(nkey)""",
    "claim_keys": "select line_no, concat_ws('|', sid, turn, subj, pred, substr(sha256(obj), 1, 8)) as nkey from claims where obj is not null",
    "session_dates": r"""
with s as (select *, try_strptime(case when regexp_matches(session_date, '^\d{4}/\d{1,2}/\d{1,2} \([A-Za-z]{3}\) \d{1,2}:\d{1,2}$')
    then regexp_replace(session_date, ' \([A-Za-z]{3}\) ', ' ') end, '%Y/%m/%d %H:%M') as t from sessions),
e as (select line_no, ts, case when strftime(t, '%a') = regexp_extract(session_date, '\(([A-Za-z]{3})\)', 1) then cast(epoch(t) as bigint) end as epoch from s)
select line_no, epoch, coalesce(strftime(to_timestamp(epoch) at time zone 'UTC', '%Y-%m-%d (%a)'), 'unknown') as day,
  ts || '  (' || strftime(to_timestamp(ts) at time zone 'UTC', '%Y-%m-%d %H:%M') || ')' as at, epoch = ts as agrees from e""",
    "text_chunks": """
with t as (select distinct session_id, idx, content from turns where content is not null),
p as (select *, cast(unnest(range(0, greatest(1, cast(ceil(length(content) / 12000.0) as int)))) as int) as part from t)
select session_id, idx, part, length(substr(content, part * 12000 + 1, 12000)) as chars, md5(substr(content, part * 12000 + 1, 12000)) as digest from p""",
    "session_prints": """
with t as (select distinct session_id, idx, role, coalesce(content, '') as content from turns where session_id is not null)
select session_id as sid, count(*) as turns, cast(sum(length(content)) as bigint) as chars,
  bit_xor(('0x' || substr(md5(concat_ws(chr(0), idx, role, content)), 1, 15))::bigint) as print from t group by 1""",
    "one_line": r"select doc_id, substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 80) as line, length(text) // 4 as tokens from documents where text is not null",
}
