"""Queries that write tables as nested files, logs, graphs, replies and streams, and read them back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memq import session
from memq.functions import keys, report, text
from memq.operators import answering, chains, lookup, memory, model
from memq.plans.chains import _VOTES, LINKS
from memq.plans.common import LATEST_CLAIMS, entity, latest_claims, spaced, strip, table
from memq.plans.memory import _CHECKED
from memq.sources import dataset, graph, logs, reports
from memq.streaming import logs as streams

NO_SUCH = "no such claim"
#: Instances of one nested file, each of which is read by one task.
PER_FILE = 200


def _lines(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).text(path)


def dataset_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Dated instances written as JSON arrays with their sessions nested, read back: one row per session slot with hash and sizes."""
    i = table(spark, d, "instances").where("question_date is not null and haystack_session_ids is not null").dropDuplicates(["question_id"])
    said = memory.one_per_turn(table(spark, d, "turns"))
    turn = F.struct("idx", F.col("t.role").alias("role"), F.col("t.content").alias("content"))
    texts = said.groupBy("sid").agg(F.transform(F.array_sort(F.collect_list(turn)), lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("turns"))
    slots = i.select("question_id", F.posexplode("haystack_session_ids").alias("pos", "sid")).join(texts, "sid", "left")
    none = F.array().cast("array<struct<role:string,content:string>>")
    nested = slots.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("turns", none).alias("turns")))), lambda s: s["turns"]).alias("haystack_sessions"))
    raw = i.join(nested, "question_id").select(
        "question_id", "question_type", "question", "answer", "question_date", "haystack_dates", "haystack_session_ids", "haystack_sessions", "answer_session_ids"
    )
    parts = -(-i.count() // PER_FILE) or 1
    files = raw.groupBy(F.pmod(F.xxhash64("question_id"), F.lit(parts))).agg(F.to_json(F.collect_list(F.struct(*raw.columns))).alias("value")).select("value")
    path = session.scratch(spark)
    files.write.option("maxRecordsPerFile", 1).text(path)  # a file is one array
    each = dataset.instances(dataset.read(spark, path)).select("question_id", "is_abstention", F.posexplode("sessions").alias("nth", "s"))
    return each.select(
        "question_id", "is_abstention", "nth", F.col("s.sid").alias("sid"), F.col("s.ts").alias("ts"), keys.content_hash("s.turns").alias("hash"),
        F.md5(dataset.plain("s.turns")).alias("plain"), F.md5(dataset.rendered("s.turns")).alias("rendered"),
    )


def session_first_texts(spark: SparkSession, d: str) -> DataFrame:
    """Sessions whose ids have the same words, in order of lines: how many later ones have another time than the first."""
    s = table(spark, d, "sessions").where("session_id is not null")
    slots = s.select(text.spaced_words("session_id").alias("sid"), F.col("line_no").alias("file_order"), F.lit(0).alias("pos"), "ts", F.coalesce("ts", F.lit(-1)).cast("string").alias("hash"), F.lit(None).cast("string").alias("turns"))
    return dataset.unique_sessions(slots)[1].groupBy("sid").agg(F.count("*").alias("differing"))


def _answer_log(spark: SparkSession, d: str) -> str:
    path = session.scratch(spark)
    rows = table(spark, d, "answers").select("line_no", "question_id", "status", "answer")
    reports.append_log(rows.orderBy("line_no"), path)
    return path


LOGGED = "line_no bigint, question_id string, status string, answer string"


def log_last_rows(spark: SparkSession, d: str) -> DataFrame:
    """Answers appended to a JSON log that ends in blank and half-written lines, read tolerantly: the last line of each question."""
    path = _answer_log(spark, d)
    _lines(spark.createDataFrame([("",), ("   ",), ('{"question_id": "half writ',)], "value string"), path)
    schema = LOGGED.replace("line_no", "line")
    rows = logs.read_log(spark, path, schema.replace("line bigint", "place bigint"), "question_id")
    return rows.select("question_id", "status", "answer")


def log_strict(spark: SparkSession, d: str) -> DataFrame:
    """The same log without broken lines, read strictly: rows by status as written."""
    return logs.read_strict(spark, _answer_log(spark, d), LOGGED).groupBy("status").agg(F.count("*").alias("n"))


def _events(spark: SparkSession, d: str) -> DataFrame:
    """Ingest as logged: every session was started, those with turns are done."""
    s = table(spark, d, "sessions").where("session_id is not null").select(F.col("session_id").alias("sid")).distinct()
    done = s.join(table(spark, d, "turns").select(F.col("session_id").alias("sid")).distinct(), "sid", "left_semi")
    path = session.scratch(spark)
    for name, rows in (("start", s), ("done", done)):
        reports.append_log(rows.select(F.lit(name).alias("event"), "sid", F.lit(0.0).alias("at")), path)
    return logs.checkpoint(logs.read_log(spark, path, logs.CHECKPOINT))


def checkpoint_state(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d)


def ingest_summary(spark: SparkSession, d: str) -> DataFrame:
    """One row: sessions, those done, those to be written anew in order of time, and statements stored."""
    s = memory.last_rows(table(spark, d, "sessions"), ["session_id"], "line_no").select(F.col("session_id").alias("sid"), "ts")
    state = session.materialize(_events(spark, d))
    one = F.lit(1).alias("one")
    a = state.agg(F.count("*").alias("sessions"), F.count_if("done").alias("done"), F.count_if("interrupted").alias("interrupted"), one)
    b = logs.to_ingest(s, state).agg(F.count("*").alias("to_ingest"), F.min("ts").alias("first_ts"), one)
    c = memory.statements(table(spark, d, "turns"), table(spark, d, "sessions")).agg(F.count("*").alias("statements"), one)
    return a.join(b, "one").join(c, "one").drop("one")


def _cache(spark: SparkSession, d: str) -> DataFrame:
    """Claims as an extraction cache: one row per session, of the first prompt where the length of the id is divisible by three."""
    c = table(spark, d, "claims").where("sid is not null")
    claim = F.struct("line_no", "turn", F.col("subj").alias("subject"), F.col("pred").alias("predicate"), F.col("obj").alias("object"), "kind", F.col("card").alias("cardinality"))
    names = ("turn", "subject", "predicate", "object", "kind", "cardinality")
    listed = c.groupBy("sid").agg(F.transform(F.array_sort(F.collect_list(claim)), lambda x: F.struct(*[x[n].alias(n) for n in names])).alias("claims"), F.count_if(F.col("obj").isNull()).alias("bare"))
    rows = listed.select(
        "sid", F.lit("measured").alias("status"), "claims", F.create_map(F.lit("missing_or_empty_field"), "bare").alias("drops"), F.size("claims").alias("turns"),
        F.when(F.length("sid") % 3 == 0, 1).otherwise(2).alias("prompt_version"), F.lit(0.0).alias("at"),
    )
    silent = table(spark, d, "sessions").select(F.col("session_id").alias("sid")).where("sid is not null").distinct().join(c.select("sid").distinct(), "sid", "left_anti")
    path = session.scratch(spark)
    reports.append_log(rows, path)
    reports.append_log(silent.select("sid", F.lit("unmeasured").alias("status"), F.lit("no reply").alias("reason"), F.lit(0.0).alias("at")), path)
    return logs.read_log(spark, path, logs.CACHE, "sid")


def cached_claims(spark: SparkSession, d: str) -> DataFrame:
    s = memory.last_rows(table(spark, d, "sessions"), ["session_id"], "line_no").select(F.col("session_id").alias("sid"), "ts")
    return logs.cached_claims(_cache(spark, d), s)


def cache_states(spark: SparkSession, d: str) -> DataFrame:
    """How many sessions of the cache are measured, unmeasured and stale, and what was dropped."""
    cache = session.materialize(_cache(spark, d))
    count = lambda df, name: df.agg(F.lit(name).alias("state"), F.count("*").alias("n"))
    kinds = count(logs.measured(cache), "measured").unionByName(count(logs.unmeasured(cache), "unmeasured")).unionByName(count(logs.stale(cache, 2), "stale"))
    return kinds.unionByName(logs.drop_totals(cache).select(F.col("reason").alias("state"), "n"))


def _checks(spark: SparkSession, d: str) -> DataFrame:
    """Two reports on predicates, one in each layout: whether nobody disputes them, and whether most votes are for one value."""
    votes = session.materialize(chains.predicate_cardinality(table(spark, d, "claims")))
    old = F.struct(F.col("pred").alias("check"), (F.col("many") == 0).alias("ok"), F.lit("").alias("error"), F.lit("d").alias("detail"), F.lit("n").alias("note"))
    verdict = F.when(F.col("one") + F.col("many") < 3, "SKIP").when(F.col("one") > F.col("many"), "ok").otherwise("no")
    new = F.struct(F.col("pred").alias("name"), verdict.alias("verdict"), F.lit("d").alias("detail"), F.lit(" q ").alias("query"))
    paths = {}
    for label, field, item in (("first", "report", old), ("second", "checks", new)):
        paths[label] = session.scratch(spark)
        votes.agg(F.to_json(F.struct(F.collect_list(item).alias(field))).alias("value")).coalesce(1).write.text(paths[label])
    return logs.probe_checks(spark, paths)


def probe_tally(spark: SparkSession, d: str) -> DataFrame:
    return logs.capability_tally(_checks(spark, d))


def probe_latest(spark: SparkSession, d: str) -> DataFrame:
    return logs.latest_verdicts(_checks(spark, d))


def probe_overturned(spark: SparkSession, d: str) -> DataFrame:
    return logs.overturned(_checks(spark, d), "first")


def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Entities from a log of writes: each property keeps its last value that is not null; ``seen`` is set afterwards."""
    c = table(spark, d, "claims").select(text.entity("subj").alias("ekey"), "line_no", F.col("subj").alias("name"), "kind", "card")
    nodes = graph.merge_nodes(c, "ekey", "line_no").withColumn("seen", F.lit(None).cast("bigint"))
    graph.check_names(nodes.columns)
    seen = table(spark, d, "claims").groupBy(text.entity("subj").alias("ekey")).agg(F.max("ts").alias("seen"))
    return graph.set_property(nodes, "ekey", seen, "seen")


def claim_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges of all claim writes by kind: a bag, so repeated writes are repeated edges."""
    e = memory.claim_edges(table(spark, d, "claims"))
    return e.groupBy("rel", "src", "dst").agg(F.count("*").alias("n"))


def claim_load(spark: SparkSession, d: str) -> DataFrame:
    return memory.claim_load(table(spark, d, "claims"))


def graph_exactly_once(spark: SparkSession, d: str) -> DataFrame:
    """The same edges after those from claims of one predicate were deleted and all of another were written again, once each."""
    c = table(spark, d, "claims")
    edges = session.materialize(memory.claim_edges(c))
    gone = memory.claim_edges(c.where("pred = 'likes'")).where("rel = 'ABOUT'")
    again = memory.claim_edges(c.where("pred = 'lives_in'"))
    left = graph.delete_edges(edges, gone)
    return graph.exactly_once(left, again).groupBy("rel", "src", "dst").agg(F.count("*").alias("n"))


def graph_bag(spark: SparkSession, d: str) -> DataFrame:
    """Edges written twice are there twice."""
    edges = memory.claim_edges(table(spark, d, "claims"))
    return graph.add_edges(edges, edges).groupBy("rel").agg(F.count("*").alias("n"))


def chunk_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Contents cut into chunks and joined again; a missing chunk would fail."""
    t = table(spark, d, "turns").where("content is not null").select("session_id", "idx", "content").distinct()
    parts = t.withColumn("parts", report.chunks("content"))
    return parts.select("session_id", "idx", F.md5(report.join_chunks("parts", F.size("parts"))).alias("digest"))


def _replies(spark: SparkSession, d: str) -> DataFrame:
    """Answers as a model might wrap them: a preamble with a stray bracket, a code fence, trailing prose."""
    value = F.to_json(F.struct("answer", F.array(F.lit(1)).alias("used")), {"ignoreNullFields": "false"})
    return table(spark, d, "answers").select("line_no", F.concat(F.lit("Here [as asked:\n```json\n"), value, F.lit("\n```\nThat is all.")).alias("reply"))


def model_replies(spark: SparkSession, d: str) -> DataFrame:
    read = model.parse_replies(_replies(spark, d), "line_no", "reply")
    return read.select("line_no", F.get_json_object("value", "$.answer").alias("answer"), "rest", "error")


def fences(spark: SparkSession, d: str) -> DataFrame:
    fenced = F.concat(F.lit(" ```json\n"), F.to_json(F.struct("line_no")), F.lit("\n``` "))
    return table(spark, d, "answers").select("line_no", report.strip_fences(fenced).alias("bare"))


def verdict_words(spark: SparkSession, d: str) -> DataFrame:
    """What a judge's word for correct is read as: each status as such a word."""
    word = F.when(F.col("status").ilike("%answered%"), " True ").when(F.col("status").ilike("%absent%"), "NO").otherwise(F.col("status"))
    return table(spark, d, "answers").groupBy(report.read_verdict(word).alias("verdict")).agg(F.count("*").alias("n"))


def not_in_memory(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "answers").groupBy(report.says_not_in_memory("answer").alias("says")).agg(F.count("*").alias("n"))


def extracted_claims(spark: SparkSession, d: str) -> DataFrame:
    """Claims read from a model that gives back the list it is shown, checked as written: kept and dropped by reason."""
    c = table(spark, d, "claims").where("sid is not null")
    size = table(spark, d, "turns").where("session_id is not null and idx is not null").groupBy(F.col("session_id").alias("sid")).agg((F.max("idx") + 1).cast("int").alias("turns"))
    item = F.struct("turn", F.col("subj").alias("subject"), F.col("pred").alias("predicate"), F.col("obj").alias("object"), "kind", F.col("card").alias("cardinality"))
    prompts = c.groupBy("sid").agg(F.concat(F.lit("The list: "), F.to_json(F.collect_list(item))).alias("prompt")).join(size, "sid", "left")
    claims, _ = model.extract(prompts.withColumn("turns", F.coalesce("turns", F.lit(0))), lambda prompt: prompt)
    return claims.groupBy("reason").agg(F.count("*").alias("n"))


def claim_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The newest claim of each question's target by key, and one key that no claim has."""
    wanted = latest_claims(spark, d).where("pred = 'lives_in'").select("nkey").unionByName(spark.createDataFrame([(NO_SUCH,)], "nkey string"))
    return lookup.by_key(latest_claims(spark, d).select("nkey", "obj", "ts"), "nkey", wanted)


def parameters(spark: SparkSession, d: str) -> DataFrame:
    """A query with named parameters, and a scalar read by key among them."""
    c = latest_claims(spark, d)
    first = c.where("nkey is not null").agg(F.min("nkey")).first()[0]
    subject = lookup.property_of(c, "nkey", first, "subj", "user")
    return lookup.run(c.select("nkey", "subj", "pred", "ts"), "select nkey, ts from {t} where pred = :p and (subj = :s or ts >= :t)", p="lives_in", s=subject, t=1_700_000_000)


def pair_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths between claims that are two replacements apart."""
    links = session.materialize(chains.supersedes(latest_claims(spark, d)))
    a, b = links.alias("a"), links.alias("b")
    pairs = a.join(b, F.col("a.earlier") == F.col("b.later")).select(F.col("a.later").alias("start"), F.col("b.earlier").alias("target"))
    return chains.pair_paths(links, pairs).select("start", "target", "hops", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


def wide_ids(spark: SparkSession, d: str) -> DataFrame:
    """Entity numbers of the narrowest and the widest kind."""
    e = table(spark, d, "claims").select(text.entity("subj").alias("ekey")).where("ekey is not null").distinct()
    return e.select("ekey", keys.stable_id("Entity", "ekey", 32).alias("narrow"), keys.stable_id("Entity", "ekey", 62).alias("wide"))


def _source(spark: SparkSession, d: str, name: str, *columns: Column | str) -> tuple[DataFrame, str]:
    """A stream over a copy of a table."""
    path = session.scratch(spark)
    rows = table(spark, d, name).select(*columns)
    rows.write.parquet(path)
    return streams.read_stream(spark, path, rows.schema), session.scratch(spark)


def stream_once(spark: SparkSession, d: str) -> DataFrame:
    """Answers as a stream: each question's first delivery once, whatever is repeated within ten years."""
    stream, out = _source(spark, d, "answers", "question_id", "delivered_at")
    present = stream.where("question_id is not null and delivered_at is not null")
    streams.sink(streams.once_per_id(present, "question_id", "delivered_at", "3650 days"), out, session.scratch(spark)).awaitTermination()
    return spark.read.schema("question_id string").parquet(out).select("question_id")


def stream_latest(spark: SparkSession, d: str) -> DataFrame:
    """The newest object of each subject and predicate, kept up by a stateful stream and read back as an upsert."""
    stream, out = _source(spark, d, "claims", "subj", "pred", "obj", "ts")
    newest = streams.latest_values(stream.where("subj is not null and pred is not null"), ["subj", "pred"], "obj", "ts")
    streams.batch_sink(newest, out, session.scratch(spark), "update").awaitTermination()
    if not spark.read.option("recursiveFileLookup", True).schema("x int").parquet(out).limit(1).count():
        return spark.createDataFrame([], "subj string, pred string, ts bigint, value string")
    return streams.upserted(spark, out, ["subj", "pred"], "ts")


def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Answers a day, of the days that were closed when the stream ended."""
    stream, out = _source(spark, d, "answers", "status", "delivered_at")
    counts = streams.windowed_counts(stream, "delivered_at", ["status"], "1 day", "1 hour")
    streams.sink(counts, out, session.scratch(spark)).awaitTermination()
    rows = spark.read.schema("start timestamp, status string, n bigint").parquet(out)
    return rows.select(F.unix_timestamp("start").alias("start"), "status", "n")


def answer_retries(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes with a model that fails once for each prompt and is asked again, and that answers with nothing for some."""
    q = table(spark, d, "instances").where("question is not null").groupBy(F.col("question_id").alias("q")).agg(F.max("question").alias("prompt"))

    def flaky() -> model.Callable:
        failed: set[str] = set()

        def call(prompt: str) -> object:
            if prompt not in failed:
                failed.add(prompt)
                raise ConnectionError("try again")
            return {"answer": "" if len(prompt) % 7 == 0 else prompt, "used": [1]} if len(prompt) % 5 else [prompt]

        return model.with_retries(call, sleep=lambda s: None)

    asked = flaky()
    out = answering.answer(q.select("q", F.lit(1).alias("hits"), "prompt"), asked)
    return out.groupBy("status", F.substring_index("reason", ":", 1).alias("reason")).agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        dataset_roundtrip, session_first_texts, log_last_rows, log_strict, checkpoint_state, ingest_summary, cached_claims, cache_states, probe_tally, probe_latest,
        probe_overturned, graph_nodes, claim_edges, claim_load, graph_exactly_once, graph_bag, chunk_roundtrip, model_replies, fences, verdict_words, not_in_memory,
        extracted_claims, claim_lookup, parameters, pair_paths, wide_ids, stream_once, stream_latest, stream_windows, answer_retries,
    )
}

_TURNS = """t as (select session_id as sid, idx, coalesce(content, '') as content, role from turns where role in ('user', 'assistant') and session_id is not null and idx is not null
  qualify row_number() over (partition by session_id, idx order by coalesce(content, '') desc, role desc) = 1)"""
_EVENTS = """s as (select distinct session_id as sid from sessions where session_id is not null),
e as (select sid, sid in (select session_id from turns where session_id is not null) as done from s)"""
_CHECKS = f"""{_VOTES.format(t="claims")},
checks as (select 0 as place, 'first' as probe, pred as name, case when many = 0 then 'WORKS' else 'FAILS' end as verdict from votes
  union all select 1, 'second', pred, case when one + many < 3 then 'SKIPPED' when one > many then 'WORKS' else 'FAILS' end from votes),
latest as (select name, probe, verdict from checks where verdict <> 'SKIPPED' qualify row_number() over (partition by name order by place desc) = 1)"""
_EDGES = f"""edges as (select sid || '|' || turn as src, 'ASSERTS' as rel, nkey as dst, pred, subj from claims where sid is not null and turn is not null and nkey is not null
  union all select nkey, 'ABOUT', {entity("subj")}, pred, subj from claims where nkey is not null and subj is not null)"""
_WRAPPED = "sha256('Entity|' || ekey)"
_ANSWER = "coalesce(answer, '')"
_WORD = "case when status ilike '%answered%' then ' True ' when status ilike '%absent%' then 'NO' else status end"

SQL = {
    "dataset_roundtrip": rf"""with {_TURNS},
i as (select distinct question_id, haystack_session_ids as ids, haystack_dates as dates from instances where question_date is not null and haystack_session_ids is not null),
p as (select question_id, ids, dates, unnest(range(1, len(ids) + 1)) as pos from i),
x as (select sid, substr(sha256(string_agg(role || chr(0) || content || chr(1), '' order by idx)), 1, 16) as hash, md5(string_agg(role || ': ' || content, chr(10) order by idx)) as plain,
  md5(string_agg('[' || n || '] ' || role || ': ' || content, chr(10) order by idx)) as rendered from (select *, row_number() over (partition by sid order by idx) - 1 as n from t) group by 1),
s as (select question_id, pos, ids[pos] as sid, cast(epoch(strptime(regexp_replace(dates[pos], ' \([A-Za-z]{{3}}\) ', ' '), '%Y/%m/%d %H:%M')) as bigint) as ts from p)
select question_id, question_id like '%\_abs' escape '\' as is_abstention, cast(row_number() over (partition by question_id order by ts, pos) - 1 as int) as nth, sid, ts,
  coalesce(hash, substr(sha256(''), 1, 16)) as hash, coalesce(plain, md5('')) as plain, coalesce(rendered, md5('')) as rendered from s left join x using (sid)""",
    "session_first_texts": f"""
with s as (select *, first_value(n) over (partition by sid order by line_no) as f from (select {spaced("session_id")} as sid, coalesce(ts, -1) as n, line_no from sessions where session_id is not null))
select sid, count(*) as differing from s where n <> f group by 1""",
    "log_last_rows": "select question_id, status, answer from answers where question_id is not null qualify row_number() over (partition by question_id order by line_no desc) = 1",
    "log_strict": "select status, count(*) as n from answers group by 1",
    "checkpoint_state": f"with {_EVENTS} select sid, done, not done as interrupted from e",
    "ingest_summary": f"""with {_EVENTS}, {_TURNS}, l as (select session_id as sid, ts from sessions where session_id is not null qualify row_number() over (partition by session_id order by line_no desc) = 1)
select (select count(*) from e) as sessions, (select count(*) from e where done) as done, (select count(*) from e where not done) as interrupted,
  (select count(*) from l where sid not in (select sid from e where done)) as to_ingest, (select min(ts) from l where sid not in (select sid from e where done)) as first_ts, (select count(*) from t) as statements""",
    "cached_claims": """with l as (select session_id as sid, ts from sessions where session_id is not null qualify row_number() over (partition by session_id order by line_no desc) = 1)
select c.sid, cast(row_number() over (partition by c.sid order by line_no) - 1 as int) as ord, turn, subj, pred, obj, kind, coalesce(card, 'many') as card, l.ts
from claims c left join l using (sid) where c.sid is not null and length(c.sid) % 3 <> 0""",
    "cache_states": """with m as (select distinct sid from claims where sid is not null)
select 'measured' as state, count(*) as n from m union all select 'stale', count(*) from m where length(sid) % 3 = 0
union all select 'unmeasured', count(distinct session_id) from sessions where session_id is not null and session_id not in (select sid from m)
union all select 'missing_or_empty_field', count(*) from claims where sid is not null and obj is null having (select count(*) from m) > 0""",
    "probe_tally": f"with {_CHECKS} select probe, verdict, count(*) as n from checks group by 1, 2",
    "probe_latest": f"with {_CHECKS} select name, probe, verdict from latest",
    "probe_overturned": f"with {_CHECKS} select c.name, c.verdict as before, l.verdict as now from checks c join latest l using (name) where c.probe = 'first' and c.verdict <> l.verdict",
    "graph_nodes": f"""select ekey, arg_max(subj, line_no) filter (where subj is not null) as name, arg_max(kind, line_no) filter (where kind is not null) as kind,
  arg_max(card, line_no) filter (where card is not null) as card, max(ts) as seen from (select *, {entity("subj")} as ekey from claims) where ekey is not null group by 1""",
    "claim_edges": f"with {_EDGES} select rel, src, dst, count(*) as n from edges group by 1, 2, 3",
    "claim_load": f"select count(*) as claims_written, count(distinct {entity('subj')}) as entities from claims where nkey is not null",
    "graph_exactly_once": f"""with {_EDGES},
gone as (select distinct src from edges where rel = 'ABOUT' and pred = 'likes'), again as (select distinct src, rel, dst from edges where pred = 'lives_in'),
kept as (select * from edges e where not (rel = 'ABOUT' and src in (select src from gone)) and not exists (select 1 from again a where a.src = e.src and a.rel = e.rel))
select rel, src, dst, count(*) as n from (select src, rel, dst from kept union all select * from again) group by 1, 2, 3""",
    "graph_bag": f"with {_EDGES} select rel, 2 * count(*) as n from edges group by 1",
    "chunk_roundtrip": "select session_id, idx, md5(content) as digest from (select distinct session_id, idx, content from turns where content is not null)",
    "model_replies": "select line_no, answer, 'That is all.' as rest, cast(null as varchar) as error from answers",
    "fences": """select line_no, '{"line_no":' || line_no || '}' as bare from answers""",
    "verdict_words": f"""select case when lower(trim({_WORD})) in ('true', 'yes', 'correct') then 'correct' when lower(trim({_WORD})) in ('false', 'no', 'incorrect') then 'incorrect'
  else 'unjudged' end as verdict, count(*) as n from answers group by 1""",
    "not_in_memory": f"select {strip(_ANSWER)} = '' or replace(upper({strip(_ANSWER)}), ' ', '_') = 'NOT_IN_MEMORY' as says, count(*) as n from answers group by 1",
    "extracted_claims": f"with {_CHECKED} select reason, count(*) as n from checked where sid is not null group by 1",
    "pair_paths": f"""with {LINKS} select a.later as start, b.earlier as target, 2 as hops, a.later || '>' || a.earlier || '>' || b.earlier as path
from links a join links b on b.later = a.earlier""",
    "claim_lookup": f"""with {LATEST_CLAIMS} select nkey, obj, ts, true as found from claims0 where pred = 'lives_in' union all select '{NO_SUCH}', null, null, false""",
    "parameters": f"""with {LATEST_CLAIMS} select nkey, ts from claims0
where pred = 'lives_in' and (subj = coalesce((select subj from claims0 order by nkey limit 1), 'user') or ts >= 1700000000)""",
    "wide_ids": f"""select ekey, greatest(1, ('0x' || substr({_WRAPPED}, 1, 8))::bigint) as narrow, greatest(1, ((('0x' || substr({_WRAPPED}, 1, 16))::ubigint) // 4)::bigint) as wide
from (select distinct {entity("subj")} as ekey from claims) where ekey is not null""",
    "stream_once": "select distinct question_id from answers where question_id is not null and delivered_at is not null",
    "stream_latest": """select subj, pred, ts, obj as value from claims where subj is not null and pred is not null and obj is not null and ts is not null
qualify row_number() over (partition by subj, pred order by ts desc, obj desc) = 1""",
    "stream_windows": """with w as (select cast(epoch(date_trunc('day', delivered_at)) as bigint) as start, status from answers where delivered_at is not null)
select start, status, count(*) as n from w where start + 86400 <= (select epoch(max(delivered_at)) - 3600 from answers) group by 1, 2""",
    "answer_retries": """with q as (select question_id, max(question) as p from instances where question is not null group by 1)
select case when length(p) % 5 = 0 then 'unmeasured' when length(p) % 7 = 0 then 'absent' else 'answered' end as status,
  case when length(p) % 5 = 0 then 'model returned an unusable shape' when length(p) % 7 = 0 then 'the model was given evidence and said it does not contain the answer' end as reason,
  count(*) as n from q group by 1, 2""",
}
