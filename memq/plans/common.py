"""Tables and query sets that several queries use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memq.operators import memory

BLANK = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
#: A row is in the query set of a search if the number in its id is divisible by this.
EVERY = 50


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def entity(c: str) -> str:
    return f"trim(regexp_replace(lower({c}), '{BLANK}', ' ', 'g'))"


def spaced(c: str) -> str:
    return rf"trim(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{BLANK}|{BLANK}$', '', 'g')"


def predicate(c: str) -> str:
    return f"replace({entity(c)}, ' ', '_')"


def normal_object(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower(replace({c}, '_', ' ')), '[^\p{{L}}\p{{N}}_\s]+', ' ', 'g'), '\s+', ' ', 'g'))"


def latest_claims(spark: SparkSession, d: str) -> DataFrame:
    """The last line of each claim key."""
    return memory.last_rows(table(spark, d, "claims"), ["nkey"], "line_no")


def latest_answers(spark: SparkSession, d: str) -> DataFrame:
    return memory.last_rows(table(spark, d, "answers"), ["question_id"], "line_no")


def all_questions(instances: DataFrame) -> DataFrame:
    """(q, question, asked_at) of every question; one without an id is none."""
    return instances.where("question_id is not null").groupBy(F.col("question_id").alias("q")).agg(F.max("question").alias("question"), F.max("asked_at").alias("asked_at"))


def query_set(instances: DataFrame) -> DataFrame:
    """(q, question, asked_at): questions whose id holds a number divisible by EVERY; these are the searches made."""
    number = F.conv(F.regexp_extract("question_id", "([0-9a-f]{8})", 1), 16, 10).cast("bigint")
    return all_questions(instances.where(number % EVERY == 0))


LATEST_CLAIMS = "claims0 as (select * from claims where nkey is not null qualify row_number() over (partition by nkey order by line_no desc) = 1)"
LATEST_ANSWERS = "answers0 as (select * from answers where question_id is not null qualify row_number() over (partition by question_id order by line_no desc) = 1)"
ALL_QUESTIONS = "asked as (select question_id as q, max(question) as question, max(asked_at) as asked_at from instances where question_id is not null group by 1)"
QUERY_SET = f"""asked as (select question_id as q, max(question) as question, max(asked_at) as asked_at from instances
  where regexp_extract(question_id, '([0-9a-f]{{8}})', 1) <> '' and ('0x' || regexp_extract(question_id, '([0-9a-f]{{8}})', 1))::bigint % {EVERY} = 0 group by 1)"""
