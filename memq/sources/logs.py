"""Append-only JSON logs: tolerant and strict readers, checkpoints, claim caches, probe reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memq.operators.memory import last_rows

CLAIMS = "array<struct<turn:int,subject:string,predicate:string,object:string,kind:string,cardinality:string>>"
CACHE = f"sid string, status string, claims {CLAIMS}, drops map<string,bigint>, turns int, prompt_version int, reason string, at double"
CHECKPOINT = "event string, sid string, at double"
PROBE = (
    "report array<struct<check:string,ok:boolean,error:string,detail:string,note:string>>, checks array<struct<name:string,verdict:string,detail:string,query:string>>"
)


def read_log(spark: SparkSession, path: str, schema: str, key: str | None = None) -> DataFrame:
    """Rows of a JSON-lines log with line_no, in file order; blank and broken lines are skipped.

    A half-written last line is such a line. With ``key`` the last line of each key wins. Lines are
    ordered by the time their file was written, its name, and their place in it, so several
    appended files are one log.
    """
    place = F.struct(
        F.col("_metadata.file_modification_time").alias("written"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("nth"),
    )
    text = spark.read.text(path).select("value", place.alias("line_no"))
    corrupt = f"{schema}, _corrupt string"
    parsed = text.where(F.trim("value") != "").select("line_no", F.from_json("value", corrupt, {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    good = parsed.where("r is not null and r._corrupt is null")
    rows = good.select("line_no", *[F.col(f"r.{f.name}").alias(f.name) for f in T.StructType.fromDDL(schema).fields])
    return last_rows(rows, [key], "line_no") if key else rows


def read_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """As read_log() but any broken line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def checkpoint(log: DataFrame) -> DataFrame:
    """(sid, done, interrupted) from start and done events."""
    sums = log.where("sid is not null").groupBy("sid").agg(F.count_if(F.col("event") == "start").alias("s"), F.count_if(F.col("event") == "done").alias("d"))
    return sums.select("sid", (F.col("d") > 0).alias("done"), ((F.col("d") == 0) & (F.col("s") > 0)).alias("interrupted"))


def to_ingest(sessions: DataFrame, state: DataFrame) -> DataFrame:
    """Sessions (sid, ts, ...) that are not done, in order of time; interrupted ones are written anew."""
    return sessions.join(state.where("done").select("sid"), "sid", "left_anti").orderBy("ts", "sid")


def measured(cache: DataFrame) -> DataFrame:
    return cache.where("status = 'measured'")


def unmeasured(cache: DataFrame) -> DataFrame:
    return cache.where(F.coalesce(F.col("status") != "measured", F.lit(True)))


def stale(cache: DataFrame, version: int) -> DataFrame:
    """Measured rows of an older prompt; a row without a version is of the first."""
    return measured(cache).where(F.coalesce("prompt_version", F.lit(1)) < version)


def cached_claims(cache: DataFrame, sessions: DataFrame, version: int = 2) -> DataFrame:
    """One row per claim of current measured sessions, with the session's time (the cache itself has none)."""
    rows = measured(cache).where(F.coalesce("prompt_version", F.lit(1)) >= version)
    each = rows.select("sid", F.posexplode("claims").alias("ord", "c"))
    flat = each.select("sid", "ord", F.col("c.turn").alias("turn"), F.col("c.subject").alias("subj"), F.col("c.predicate").alias("pred"), F.col("c.object").alias("obj"), F.col("c.kind").alias("kind"), F.coalesce("c.cardinality", F.lit("many")).alias("card"))
    return flat.join(sessions.select("sid", "ts"), "sid", "left")


def drop_totals(cache: DataFrame) -> DataFrame:
    return cache.select(F.explode("drops").alias("reason", "n")).groupBy("reason").agg(F.sum("n").alias("n"))


def probe_checks(spark: SparkSession, sources: dict[str, str]) -> DataFrame:
    """(place, probe, name, verdict, detail, query, note) of reports in either layout; ``sources`` maps label to path, oldest first."""
    out = None
    for place, (label, path) in enumerate(sources.items()):
        data = spark.read.schema(PROBE).option("multiLine", True).json(path)
        old = data.select(F.inline("report")).select(
            F.coalesce("check", F.lit("")).alias("name"), F.when(F.col("ok"), "WORKS").otherwise("FAILS").alias("verdict"),
            F.trim(F.coalesce(F.when(F.col("error") != "", F.col("error")), "detail", F.lit(""))).alias("detail"), F.lit("").alias("query"), F.trim(F.coalesce("note", F.lit(""))).alias("note"),
        )
        v = F.upper(F.coalesce("verdict", F.lit("")))
        new = data.select(F.inline("checks")).select(
            F.coalesce("name", F.lit("")).alias("name"), F.when(v.isin("OK", "YES"), "WORKS").when(v == "SKIP", "SKIPPED").otherwise("FAILS").alias("verdict"),
            F.trim(F.coalesce("detail", F.lit(""))).alias("detail"), F.trim(F.coalesce("query", F.lit(""))).alias("query"), F.lit("").alias("note"),
        )
        rows = old.unionByName(new).select(F.lit(place).alias("place"), F.lit(label).alias("probe"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out


def capability_tally(checks: DataFrame) -> DataFrame:
    return checks.groupBy("probe", "verdict").agg(F.count("*").alias("n"))


def latest_verdicts(checks: DataFrame) -> DataFrame:
    """The verdict of each name in the newest probe that reached it."""
    seen = checks.where("verdict != 'SKIPPED'")
    return seen.groupBy("name").agg(F.max_by(F.struct("probe", "verdict"), "place").alias("x")).select("name", "x.*")


def overturned(checks: DataFrame, first: str) -> DataFrame:
    """(name, before, now): verdicts of the first probe that a later one reversed."""
    then = checks.where(F.col("probe") == first).select("name", F.col("verdict").alias("before"))
    return then.join(latest_verdicts(checks).select("name", F.col("verdict").alias("now")), "name").where("before != now")
