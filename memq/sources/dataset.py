"""The benchmark's nested file: instances with their sessions and turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memq.functions import keys, report, timeparse

TURN = "struct<role:string,content:string,has_answer:boolean>"
RAW = (
    "question_id string, question_type string, question string, answer string, question_date string, haystack_dates array<string>, "
    f"haystack_session_ids array<string>, haystack_sessions array<array<{TURN}>>, answer_session_ids array<string>"
)


def first_character(spark: SparkSession, path: str) -> str | None:
    """The first character of a file, or of the first file of a folder, that is no blank; empty if there is none. Reads no more than that.

    None for a folder without any file that has content.
    """
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getFileStatus(p).isDirectory():
        files = sorted(s.getPath().toString() for s in fs.listStatus(p) if s.getLen() and not s.getPath().getName().startswith(("_", ".")))
        if not files:
            return None
        p = jvm.org.apache.hadoop.fs.Path(files[0])
    stream = fs.open(p)
    try:
        while (byte := stream.read()) >= 0:
            if not chr(byte).isspace() and byte not in (0xEF, 0xBB, 0xBF):
                return chr(byte)
        return ""
    finally:
        stream.close()


def read(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Raw instances with file_order. A file must be one JSON array; ``limit`` takes the first ones, it does not sample.

    One file is parsed by one task, record by record; a folder of several such files is read in
    parallel, and one without content holds no instances.
    """
    if first_character(spark, path) not in ("[", None):
        raise ValueError("the file holds no JSON array")
    rows = spark.read.schema(RAW).option("multiLine", True).option("mode", "FAILFAST").json(path).withColumn("file_order", F.monotonically_increasing_id())
    return rows if limit is None else rows.orderBy("file_order").limit(limit)


def instances(raw: DataFrame) -> DataFrame:
    """Instances with sessions (sid, ts, pos, turns) in order of time; a wrong number, date or turn fails."""
    sizes = (F.size("haystack_sessions") == F.size("haystack_session_ids")) & (F.size("haystack_dates") == F.size("haystack_session_ids"))
    zipped = F.arrays_zip(F.col("haystack_session_ids").alias("sid"), F.col("haystack_dates").alias("date"), F.col("haystack_sessions").alias("turns"))
    sessions = F.array_sort(
        F.transform(
            zipped,
            lambda s, i: F.struct(
                timeparse.epoch(s["date"]).alias("ts"), i.alias("pos"), s["sid"].alias("sid"),
                F.transform(s["turns"], lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("turns"),
            ),
        )
    )
    broken = F.exists(F.flatten("haystack_sessions"), lambda t: t["role"].isNull() | t["content"].isNull())
    kind = "array<struct<ts:bigint,pos:int,sid:string,turns:array<struct<role:string,content:string>>>>"
    checked = (
        F.when(~F.coalesce(sizes, F.lit(False)), F.raise_error(F.concat("question_id", F.lit(": sessions, dates and ids differ in number"))).cast(kind))
        .when(F.coalesce(broken, F.lit(False)), F.raise_error(F.lit("a turn lacks its role or content")).cast(kind))
        .otherwise(sessions)
    )
    return raw.select(
        "file_order", "question_id", F.coalesce("question_type", F.lit("unknown")).alias("question_type"), "question", F.coalesce("answer", F.lit("")).alias("gold"),
        timeparse.epoch("question_date").alias("asked_at"), report.is_abstention("question_id").alias("is_abstention"),
        F.coalesce("answer_session_ids", F.array().cast("array<string>")).alias("gold_sessions"), checked.alias("sessions"),
    )


def session_texts(inst: DataFrame) -> DataFrame:
    """(sid, file_order, pos, ts, hash, turns): one row per session slot."""
    each = inst.select("file_order", F.explode("sessions").alias("s"))
    return each.select("file_order", F.col("s.pos").alias("pos"), F.col("s.sid").alias("sid"), F.col("s.ts").alias("ts"), keys.content_hash("s.turns").alias("hash"), F.col("s.turns").alias("turns"))


def unique_sessions(slots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(first slot of each sid, slots whose text differs from it): a collision is reported, not resolved."""
    first = slots.groupBy("sid").agg(F.min_by(F.struct("file_order", "pos", "ts", "hash", "turns"), F.struct("file_order", "pos")).alias("f"))
    unique = first.select("sid", "f.*")
    same = slots.join(unique.select("sid", F.col("hash").alias("first_hash")), "sid")
    return unique, same.where("hash != first_hash").select("sid", "file_order", "pos")


def rendered(turns_col: str = "turns") -> Column:
    """A session as numbered turns, the form in which claims can name where they come from."""
    return F.array_join(F.transform(turns_col, lambda t, i: F.concat(F.lit("["), i.cast("string"), F.lit("] "), t["role"], F.lit(": "), t["content"])), "\n")


def plain(turns_col: str = "turns") -> Column:
    return F.array_join(F.transform(turns_col, lambda t: F.concat(t["role"], F.lit(": "), t["content"])), "\n")
