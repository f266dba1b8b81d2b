"""Queries over the operators for training data, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memq.llm import canonical, defects, leakage, packing, spans, splitting
from memq.plans.training import value
from memq.session import materialize


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.hard_cuts(_t(spark, d, "turns"), ["session_id", "idx"], "content")


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(_t(spark, d, "turns"), ["session_id", "idx"], "content")


def p1_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """The content of each oversized turn put together again from its pieces: what a piece repeats must be the end of the one before."""
    t = _t(spark, d, "turns").withColumn("digest", F.md5("content"))
    pieces = splitting.split_oversized(t, ["session_id", "idx", "digest"], "content")
    sorted_ = F.array_sort(F.collect_list(F.struct("piece_no", "piece")))
    whole = pieces.groupBy("session_id", "idx", "digest").agg(sorted_.alias("p"), F.max(F.length("piece")).alias("longest"))
    tail = F.transform("p", lambda x, i: F.when(i == 0, x["piece"]).otherwise(F.substr(x["piece"], F.lit(splitting.OVERLAP + 1))))
    repeats = F.transform(
        F.slice("p", F.lit(2), F.size("p")),
        lambda x, i: F.when(F.right(F.get("p", i)["piece"], F.lit(splitting.OVERLAP)) == F.left(x["piece"], F.lit(splitting.OVERLAP)), 1).otherwise(0),
    )
    return whole.select(
        "session_id", "idx", "digest", F.md5(F.array_join(tail, "")).alias("rebuilt"),
        (F.forall(repeats, lambda x: x == 1)).alias("overlaps"), (F.col("longest") <= splitting.LIMIT).alias("fits"),
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return defects.defective(_t(spark, d, "answers"))


def p3_by_defect(spark: SparkSession, d: str) -> DataFrame:
    return p3_found(spark, d).groupBy("defect").agg(F.count("*").alias("n"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    claims = canonical.claim_copies(_t(spark, d, "claims")).withColumn("src", F.lit("claim"))
    sessions = canonical.session_copies(_t(spark, d, "sessions")).withColumn("src", F.lit("session"))
    return claims.unionByName(sessions).select("src", "keep_key", "copy_key", "n_copies")


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.assign(_t(spark, d, "documents"), "doc_id", "text")


def p7_integrity(spark: SparkSession, d: str) -> DataFrame:
    """One row: documents and those without text as placed, containers too full, gaps between pieces, and needless splits (none of the last three)."""
    placed = materialize(p7_containers(spark, d))
    sums = placed.where("container >= 0").groupBy("container").agg(F.sum("n_tokens").alias("n"))
    per = placed.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.max(F.col("token_from") + F.col("n_tokens")).alias("end"), F.count("*").alias("pieces"))
    one = F.lit(1).alias("one")
    a = sums.agg(F.count_if(F.col("n") > packing.CAPACITY).alias("overfull"), one)
    b = per.agg(
        F.count("*").alias("documents"), F.count_if(F.col("n") == 0).alias("without_text"), F.count_if(F.col("n") != F.col("end")).alias("gaps"),
        F.count_if((F.col("pieces") > 1) & (F.col("n") <= packing.CAPACITY)).alias("needless_splits"), one,
    )
    return a.join(b, "one").drop("one")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_tiles(spark, d).select("doc_id", "item_id")


def p8_tiles(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(_t(spark, d, "documents"), _t(spark, d, "eval_items"))


def p8_leaked_items(spark: SparkSession, d: str) -> DataFrame:
    """Items of which a document's tiles cover at least half, in whatever order."""
    return (
        p8_tiles(spark, d)
        .where(F.col("coverage") >= leakage.COVERAGE)
        .groupBy("item_id")
        .agg(F.count("*").alias("documents"), F.round(F.max("coverage"), 6).alias("coverage"))
    )


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_chars(_t(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_pieces, p1_rebuilt, p3_found, p3_by_defect, p5_found, p7_containers, p7_integrity, p8_found, p8_tiles, p8_leaked_items, p9_found)}


def _words(c: str) -> str:
    return rf"trim(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


_LIST = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"

SQL = {
    "p1_found": r"""
select distinct session_id, idx,
  cast(regexp_matches(content, '[^\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}.!?;。！？]{1000}') and
       list_max(list_transform(regexp_split_to_array(content, '[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}.!?;。！？]'), lambda x: length(x))) > 12000 as int) as hard_cut
from turns where length(content) > 12000""",
    "p5_found": f"""
with c as (select line_no, sid, turn, pred, kind, card, ts, {_words("subj")} as s, {value("obj")} as v from claims),
g as (select line_no, min(line_no) over w as keep_key, count(*) over w as n from c where v is not null
      window w as (partition by sid, turn, pred, kind, card, ts, s, v)),
h as (select line_no, min(line_no) over w as keep_key, count(*) over w as n from sessions
      window w as (partition by ts, turns, {_words("session_id")}))
select 'claim' as src, keep_key, line_no as copy_key, cast(n as int) as n_copies from g where line_no <> keep_key
union all select 'session', keep_key, line_no, cast(n as int) from h where line_no <> keep_key""",
    "p1_rebuilt": "select distinct session_id, idx, md5(content) as digest, md5(content) as rebuilt, true as overlaps, true as fits from turns where length(content) > 12000",
    "p7_integrity": "select 0 as overfull, count(*) as documents, count(*) filter (where coalesce(text, '') = '') as without_text, 0 as gaps, 0 as needless_splits from documents",
    "p8_found": rf"""
with d as (select doc_id, {_LIST} as w from documents), i as (select item_id, {_LIST} as w from eval_items),
a as (select doc_id, unnest(list_transform(range(1, len(w) - {leakage.MIN_WORDS} + 2), lambda p: array_to_string(w[p:p + {leakage.MIN_WORDS} - 1], ' '))) as s from d),
b as (select item_id, unnest(list_transform(range(1, len(w) - {leakage.MIN_WORDS} + 2), lambda p: array_to_string(w[p:p + {leakage.MIN_WORDS} - 1], ' '))) as s from i)
select distinct doc_id, item_id from a join b using (s)""",
    "p9_found": f"""
with w as (select doc_id, unnest(range(0, length(text) - {spans.SPAN} + 1)) as p, text from documents where length(text) >= {spans.SPAN}),
h as (select doc_id, p, md5_number(substr(text, p + 1, {spans.SPAN})) as s from w),
g as (select s from h group by s having min(doc_id) <> max(doc_id)),
k as (select doc_id, p, lag(p) over (partition by doc_id order by p) as before from h semi join g using (s))
select doc_id, cast(sum(least({spans.SPAN}, p - coalesce(before, p - {spans.SPAN}))) as bigint) as shared_chars from k group by 1""",
}
