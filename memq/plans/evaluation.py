"""Queries that score a run: over the last answer row of each question."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memq.functions import report, terms, timeparse
from memq.operators import answering, evaluate, gate, memory
from memq.plans.common import EVERY, LATEST_ANSWERS, LATEST_CLAIMS, latest_answers, latest_claims, strip, table
from memq.plans.memory import _SLOTS
from memq.plans.scalars import terms_sql


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.runs(latest_answers(spark, d))


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.judge(_runs(spark, d), evaluate.says_gold())


def score_retrieval(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.score(_runs(spark, d))


def score_by_type(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.score(_runs(spark, d), "question_type")


def retrieval_drops(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.drops(_runs(spark, d))


def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d).groupBy("status").agg(F.count("*").alias("n"))


def recall_by_type(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.recall_by_type(_runs(spark, d))


def judge_free(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts without a judge model: answers stay unjudged."""
    return evaluate.judge(_runs(spark, d)).select("question_id", "verdict", "kind")


def judge_stub(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts with the offline stand-in for a judge."""
    return _judged(spark, d).select("question_id", "verdict", "kind")


def tally(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.tally(_judged(spark, d))


def tally_by_type(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.tally(_judged(spark, d), "question_type")


def abstention(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.abstention(_judged(spark, d))


def report_headline(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.headline(_judged(spark, d))


def report_regimes(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.regimes(_runs(spark, d), _judged(spark, d))


def _offsets(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "instances")
    return evaluate.offsets(memory.instance_sessions(i), i)


def date_audit(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.date_audit(_offsets(spark, d))


def offset_buckets(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.offset_buckets(_offsets(spark, d))


def _diagnosed(spark: SparkSession, d: str, evidence: str) -> DataFrame:
    number = F.conv(F.regexp_extract("question_id", "([0-9a-f]{8})", 1), 16, 10).cast("bigint")
    rows = latest_answers(spark, d).where((number % EVERY == 0) & ~F.coalesce("is_abstention", F.lit(False)) & ~evaluate.gold_cited(evidence))
    misses = rows.select(
        F.col("question_id").alias("q"), "question", F.coalesce("gold_sessions", F.array().cast("array<string>")).alias("gold_sessions"),
        F.col("retrieval.candidates").alias("candidates"), F.col("retrieval.dropped_future").alias("dropped_future"),
    )
    claims = latest_claims(spark, d)
    contribs = gate.contributions(misses, gate.index(claims, "nkey", terms.claim_document()), "q", F.col("question"))
    return evaluate.diagnose_misses(misses, claims.select(F.col("nkey").alias("key"), "sid"), gate.search(contribs, 200))


def diagnose_misses(spark: SparkSession, d: str) -> DataFrame:
    """Why gold never reached the evidence, for the search query set; the deep search goes to rank 200."""
    return _diagnosed(spark, d, "evidence")


def diagnose_second(spark: SparkSession, d: str) -> DataFrame:
    """The same for what the second piece of evidence alone would have missed."""
    return _diagnosed(spark, d, "slice(evidence, 2, 1)")


def diagnose_refusals(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.diagnose_refusals(_judged(spark, d))


def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.stratified_sample(table(spark, d, "instances"), 60, seed=7, floor=10)


def done_ids(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.done_ids(table(spark, d, "answers"), retry_unmeasured=True)


def todo_ids(spark: SparkSession, d: str) -> DataFrame:
    """Questions with no usable answer row yet."""
    asked = table(spark, d, "instances").select("question_id").distinct()
    return asked.join(done_ids(spark, d), "question_id", "left_anti")


def run_mix(spark: SparkSession, d: str) -> DataFrame:
    stratum = F.when(F.col("is_abstention"), "abstention").otherwise(F.col("question_type"))
    return _runs(spark, d).groupBy(stratum.alias("stratum"), "status").agg(F.count("*").alias("n"))


def judge_pilot(spark: SparkSession, d: str) -> DataFrame:
    """The first rows a pilot would judge: answerable and answered first. The limit is the feature."""
    first = (~F.col("is_abstention") & (F.col("status") == report.ANSWERED)).cast("int")
    return _runs(spark, d).select("question_id", "line_no", first.alias("first")).orderBy(F.col("first").desc(), "line_no").limit(25)


def first_misses(spark: SparkSession, d: str) -> DataFrame:
    """The first ten answerable questions, by line, whose evidence missed every gold session. The limit is the feature."""
    rows = _runs(spark, d).where("not is_abstention and not hit")
    return rows.select("line_no", "question_id", "question_type", "cited").orderBy("line_no").limit(10)


def no_memory_baseline(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes when every question is asked with no evidence at all: nothing can be answered."""
    asked = table(spark, d, "instances").select(F.col("question_id").alias("q")).distinct()
    return answering.free_outcome(asked.select("q", F.lit(0).alias("hits"), F.lit(0).alias("kept"))).groupBy("status", "reason").agg(F.count("*").alias("n"))


def inspector_rows(spark: SparkSession, d: str) -> DataFrame:
    """One record per question; a question without a verdict is unjudged, never left out."""
    a = latest_answers(spark, d).select("question_id", "asked_at", "question")
    j = _judged(spark, d).select("question_id", "question_type", "is_abstention", "status", "verdict", "kind", "cited", "gold_hits")
    day = timeparse.day("asked_at", "")
    return a.join(j, "question_id", "left").select(
        F.col("question_id").alias("id"), "question_type", F.coalesce("question", F.lit("")).alias("question"), day.alias("at"), "status",
        F.coalesce("verdict", F.lit("unjudged")).alias("verdict"), F.coalesce("kind", F.lit("")).alias("kind"), "cited", "gold_hits",
    )


QUERIES = {
    f.__name__: f
    for f in (
        score_retrieval, score_by_type, retrieval_drops, status_counts, recall_by_type, judge_free, judge_stub, tally, tally_by_type, abstention,
        report_headline, report_regimes, date_audit, offset_buckets, diagnose_misses, diagnose_second, diagnose_refusals, stratified_sample, done_ids, todo_ids,
        run_mix, judge_pilot, first_misses, no_memory_baseline, inspector_rows,
    )
}

_RUNS = f"""{LATEST_ANSWERS},
runs as (select line_no, question_id, coalesce(question_type, 'unknown') as question_type, coalesce(is_abstention, false) as is_abstention,
  lower(regexp_replace(status, '^\\s+|\\s+$', '', 'g')) as status, answer, gold, retrieval, len(coalesce(gold_sessions, [])) as gold_n, len(coalesce(evidence, [])) as cited,
  len(list_filter(coalesce(evidence, []), lambda e: coalesce(list_contains(gold_sessions, e.session), false))) as gold_hits,
  len(list_filter(coalesce(evidence, []), lambda e: coalesce(list_contains(gold_sessions, e.session), false))) > 0 as hit from answers0)"""
_JUDGED = f"""{_RUNS},
v as (select *, case when is_abstention and status = 'absent' then 'correct' when is_abstention and status = 'answered' then 'incorrect' when is_abstention then 'unjudged'
  when status = 'absent' then 'incorrect'
  when status = 'answered' and coalesce({strip('answer')}, '') <> '' and coalesce({strip('gold')}, '') <> '' then @verdict@ else 'unjudged' end as verdict from runs),
judged as (select *, case when is_abstention and status = 'absent' then 'refused' when is_abstention and status = 'answered' then 'hallucinated'
  when not is_abstention and status = 'absent' and gold_n > 0 and not hit then 'retrieval_miss' when not is_abstention and status = 'absent' then 'false_refusal'
  when verdict = 'unjudged' then 'unmeasured' else verdict end as kind from v)"""
_STUB = _JUDGED.replace("@verdict@", "case when contains(lower(answer), lower(trim(gold))) then 'correct' else 'incorrect' end")
_SCORE = """count(*) as n, count(*) filter (where hit) as hits, coalesce(sum(cited), 0)::bigint as cited_total, coalesce(sum(gold_hits), 0)::bigint as gold_total,
  count(*) filter (where cited = 0) as no_evidence, round(count(*) filter (where hit) / nullif(count(*), 0)::double, 4) as recall,
  round(sum(gold_hits) / nullif(sum(cited), 0)::double, 4) as density from runs where not is_abstention"""
_TALLY = """count(*) as n, count(*) filter (where verdict = 'correct') as correct, count(*) filter (where verdict = 'incorrect') as incorrect,
  count(*) filter (where verdict = 'unjudged') as unjudged, count(*) filter (where kind = 'false_refusal') as false_refusals,
  count(*) filter (where kind = 'retrieval_miss') as retrieval_misses,
  round(count(*) filter (where verdict = 'correct') / nullif(count(*) filter (where verdict in ('correct', 'incorrect')), 0)::double, 4) as accuracy,
  round(count(*) filter (where kind = 'false_refusal') /
    nullif(count(*) filter (where verdict in ('correct', 'incorrect')) - count(*) filter (where kind = 'retrieval_miss'), 0)::double, 4) as false_refusal_rate
  from judged where not is_abstention"""
_RECALL = "select question_type, count(*) as n, count(*) filter (where hit) as hits, round(count(*) filter (where hit) / count(*)::double, 4) as recall from runs where not is_abstention and gold_n > 0 group by 1"
_OFFSETS = f"""{_SLOTS},
a as (select distinct question_id, asked_at, coalesce(answer_session_ids, []) as gold_ids from instances where asked_at is not null),
o as (select question_id, coalesce(list_contains(gold_ids, sid), false) as gold, ts - asked_at as late from slots join a using (question_id)),
offs as (select * from o where question_id in (select question_id from o where gold))"""
_MISSES = f"""{LATEST_ANSWERS}, {LATEST_CLAIMS},
misses as (select question_id as q, question, coalesce(gold_sessions, []) as gold, retrieval.candidates as candidates, retrieval.dropped_future as dropped_future from answers0
  where regexp_extract(question_id, '([0-9a-f]{{8}})', 1) <> '' and ('0x' || regexp_extract(question_id, '([0-9a-f]{{8}})', 1))::bigint % {EVERY} = 0
  and not coalesce(is_abstention, false)
  and len(list_filter(coalesce(@evidence@, []), lambda e: coalesce(list_contains(gold_sessions, e.session), false))) = 0),
docs as (select nkey as key, sid, concat_ws(' ', subj, pred, obj, kind) as text from claims0),
postings as (select term, key, count(*) as tf from {terms_sql("docs", "key", "text")} group by 1, 2),
lengths as (select docs.key, coalesce(sum(tf), 0) as len from docs left join postings using (key) group by 1),
frequencies as (select term, count(*) as df from postings group by 1),
corpus as (select count(*) as n, avg(len) as avg_len from lengths),
qterms as (select distinct q, term from {terms_sql("misses", "q", "question")}),
contribs as (select q, key, round(greatest(0e0, ln(1e0 + (n - df + 0.5e0) / (df + 0.5e0))) * (tf * 2.2e0) /
    (tf + 1.2e0 * (1 - 0.75e0 + 0.75e0 * (greatest(len, 1) / avg_len))), 9) as contrib
  from qterms join postings using (term) join frequencies using (term) join lengths using (key), corpus),
scores as (select q, key, round(sum(contrib), 6) as score from contribs where contrib > 0 group by 1, 2),
ranked as (select *, row_number() over (partition by q order by score desc, key) as rank from scores where score > 0),
gold as (select distinct q, unnest(gold) as sid from misses),
n as (select q, count(*) as gold_claims from gold join docs using (sid) group by 1),
r as (select q, min(rank) as best_rank, count(*) as gold_in_depth from ranked join docs using (key) join gold using (q, sid) where rank <= 200 group by 1)"""

SQL = {
    "score_retrieval": f"with {_RUNS} select {_SCORE}",
    "score_by_type": f"with {_RUNS} select question_type, {_SCORE} group by question_type",
    "retrieval_drops": f"""with {_RUNS} select coalesce(sum(retrieval.dropped_future), 0)::bigint as dropped_future, coalesce(sum(retrieval.hits), 0)::bigint as gate_hits,
  coalesce(sum(retrieval.kept), 0)::bigint as kept, count(*) filter (where is_abstention) as abstention, count(*) filter (where is_abstention and status = 'absent') as refused,
  round(count(*) filter (where is_abstention and status = 'absent') / nullif(count(*) filter (where is_abstention), 0)::double, 4) as rate from runs""",
    "status_counts": f"with {_RUNS} select status, count(*) as n from runs group by 1",
    "recall_by_type": f"with {_RUNS} {_RECALL}",
    "judge_free": f"with {_JUDGED.replace('@verdict@', repr('unjudged'))} select question_id, verdict, kind from judged",
    "judge_stub": f"with {_STUB} select question_id, verdict, kind from judged",
    "tally": f"with {_STUB} select {_TALLY}",
    "tally_by_type": f"with {_STUB} select question_type, {_TALLY} group by question_type",
    "abstention": f"""with {_STUB} select count(*) as n, count(*) filter (where kind = 'refused') as refused, count(*) filter (where kind = 'hallucinated') as hallucinated,
  count(*) filter (where kind not in ('refused', 'hallucinated')) as unjudged,
  round(count(*) filter (where kind = 'refused') / nullif(count(*) filter (where kind in ('refused', 'hallucinated')), 0)::double, 4) as refusal_rate from judged where is_abstention""",
    "report_headline": f"""with {_STUB}, t as (select {_TALLY})
select correct + incorrect as graded, correct, correct + incorrect - false_refusals - retrieval_misses as answered, incorrect - false_refusals - retrieval_misses as answered_wrong,
  false_refusals, retrieval_misses, accuracy, round(correct / nullif(correct + incorrect - false_refusals - retrieval_misses, 0)::double, 4) as precision,
  case when false_refusals > 0 and correct + incorrect - false_refusals - retrieval_misses > 0 then
    round((correct + false_refusals * (correct / (correct + incorrect - false_refusals - retrieval_misses)::double)) / (correct + incorrect), 3) end as headroom from t""",
    "report_regimes": f"""with {_STUB}, t as (select question_type, {_TALLY} group by question_type), r as ({_RECALL})
select question_type, t.n, accuracy, false_refusals, retrieval_misses, recall, case when accuracy <> 0 and recall <> 0 then round(accuracy / recall, 3) end as conversion
from t left join r using (question_type)""",
    "date_audit": f"""with {_OFFSETS},
tol as (select unnest([0, 3600, 21600, 86400, 172800, 604800, 2592000])::bigint as tolerance),
worst as (select question_id, max(late) as worst from offs where gold group by 1)
select tolerance, case when tolerance = 0 then 'strict' when tolerance % 86400 = 0 then '+' || tolerance // 86400 || 'd' else '+' || tolerance // 3600 || 'h' end as label,
  (select count(*) from worst where worst <= tolerance) as fitting, round((select count(*) from worst where worst <= tolerance) / (select count(*) from worst)::double * 100, 1) as pct,
  (select count(*) from offs where not gold and late > 0 and late <= tolerance) as others_admitted from tol""",
    "offset_buckets": f"""with {_OFFSETS} select gold, case when late <= 0 then '<=0 (before the question)' when late <= 3600 then '0-1h' when late <= 21600 then '1-6h'
  when late <= 86400 then '6-24h' when late <= 172800 then '1-2d' when late <= 604800 then '2-7d' else '>7d' end as bucket, count(*) as n from offs group by 1, 2""",
    **{name: f"""with {_MISSES.replace("@evidence@", evidence)} select q, coalesce(gold_claims, 0) as gold_claims, cast(best_rank as int) as best_rank, coalesce(gold_in_depth, 0) as gold_in_depth,
  case when gold_claims is null then 'EXTRACTION' when best_rank > candidates and candidates > 0 then 'RANKING' when best_rank is not null and dropped_future > 0 then 'FILTER'
    when best_rank is not null then 'RANKING' else 'EXTRACTION' end as verdict from misses left join n using (q) left join r using (q)"""
    for name, evidence in (("diagnose_misses", "evidence"), ("diagnose_second", "evidence[2:2]"))},
    "diagnose_refusals": f"""with {_STUB} select question_type, count(*) as refusals, count(*) filter (where hit) as gold_present, count(*) filter (where not hit) as gold_absent
from judged where kind in ('false_refusal', 'retrieval_miss') group by 1""",
    "stratified_sample": """with r as (select question_id, min(case when coalesce(is_abstention, false) then 'abstention' else coalesce(question_type, 'unknown') end) as stratum
  from instances where question_id is not null group by 1),
z as (select stratum, count(*) as n from r group by 1),
f as (select least(10, coalesce((select n from z where stratum = 'abstention'), 0), 60) as first),
p as (select stratum, n - case when stratum = 'abstention' then first else 0 end as n from z, f),
e as (select stratum, ((60 - first) * n) // (select sum(n) from p) as share, ((60 - first) * n) % (select sum(n) from p) as rest from p, f where n > 0),
k as (select stratum, share + (row_number() over (order by rest desc, stratum) <= 60 - first - (select sum(share) from e))::int as take from e, f),
t as (select stratum, case when (select sum(n) from z) <= 60 then n else coalesce(take, 0) + case when stratum = 'abstention' then first else 0 end end as take from z left join k using (stratum), f)
select question_id, stratum from r join t using (stratum) qualify row_number() over (partition by stratum order by sha256(question_id || '|7'), question_id) <= take""",
    "done_ids": f"with {_RUNS} select question_id from runs where coalesce(status <> 'unmeasured', true)",
    "todo_ids": f"with {_RUNS} select distinct question_id from instances where question_id not in (select question_id from runs where coalesce(status <> 'unmeasured', true))",
    "run_mix": f"with {_RUNS} select case when is_abstention then 'abstention' else question_type end as stratum, status, count(*) as n from runs group by 1, 2",
    "judge_pilot": f"with {_RUNS} select question_id, line_no, (not is_abstention and status = 'answered')::int as first from runs order by first desc, line_no limit 25",
    "first_misses": f"with {_RUNS} select line_no, question_id, question_type, cited from runs where not is_abstention and not hit order by line_no limit 10",
    "no_memory_baseline": f"select 'absent' as status, '{answering.NO_MATCH}' as reason, count(distinct question_id) as n from instances having count(*) > 0",
    "inspector_rows": f"""with {_STUB} select question_id as id, j.question_type, coalesce(question, '') as question,
  coalesce(strftime(to_timestamp(asked_at) at time zone 'UTC', '%Y-%m-%d'), '') as at, j.status, verdict, kind, cited, gold_hits
from answers0 join judged j using (question_id)""",
}
