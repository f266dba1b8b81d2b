"""Scores of a run: retrieval, judging, refusals, dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memq.functions import report, timeparse

HOUR, DAY = 3_600, 86_400
TOLERANCES = (0, HOUR, 6 * HOUR, DAY, 2 * DAY, 7 * DAY, 30 * DAY)


def gold_cited(evidence: str = "evidence") -> Column:
    """Whether evidence, a column or an expression, holds a gold session; false, never null."""
    cited = F.transform(F.expr(evidence), lambda e: e["session"])
    return F.coalesce(F.arrays_overlap(F.array_compact("gold_sessions"), F.array_compact(cited)), F.lit(False))


def runs(answers: DataFrame) -> DataFrame:
    """Answer rows reduced to what scoring needs, statuses cleaned, a missing type as ``unknown``."""
    gold = F.coalesce("gold_sessions", F.array())
    sessions = F.coalesce("evidence.session", F.array())
    return answers.select(
        "line_no",
        "question_id",
        F.coalesce("question_type", F.lit("unknown")).alias("question_type"),
        F.coalesce("is_abstention", F.lit(False)).alias("is_abstention"),
        report.status("status").alias("status"),
        "answer",
        "gold",
        "reason",
        F.size(gold).alias("gold_n"),
        F.size(sessions).cast("bigint").alias("cited"),
        F.size(F.filter(sessions, lambda s: F.coalesce(F.array_contains(gold, s), F.lit(False)))).cast("bigint").alias("gold_hits"),
        gold_cited().alias("hit"),
        "retrieval",
    )


def score(rows: DataFrame, *by: str) -> DataFrame:
    """Recall and citation density of answerable rows, in all or by columns; a question without gold counts in n."""
    real = rows.where("not is_abstention")
    sums = [
        F.count("*").alias("n"), F.count_if("hit").alias("hits"), F.coalesce(F.sum("cited"), F.lit(0)).alias("cited_total"),
        F.coalesce(F.sum("gold_hits"), F.lit(0)).alias("gold_total"), F.count_if(F.col("cited") == 0).alias("no_evidence"),
    ]
    out = (real.groupBy(*by) if by else real.groupBy()).agg(*sums)
    return out.withColumn("recall", report.ratio("hits", "n")).withColumn("density", report.ratio("gold_total", "cited_total"))


def drops(rows: DataFrame) -> DataFrame:
    """One row of what retrieval dropped, over all rows, and how abstention questions ended."""
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return rows.agg(
        zero("retrieval.dropped_future").alias("dropped_future"),
        zero("retrieval.hits").alias("gate_hits"),
        zero("retrieval.kept").alias("kept"),
        F.count_if("is_abstention").alias("abstention"),
        F.count_if(F.col("is_abstention") & (F.col("status") == report.ABSENT)).alias("refused"),
    ).withColumn("rate", report.ratio("refused", "abstention"))


def recall_by_type(rows: DataFrame) -> DataFrame:
    """As score() by type, but a question without gold is left out."""
    return rows.where("not is_abstention and gold_n > 0").groupBy("question_type").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits")).withColumn("recall", report.ratio("hits", "n"))


def judge(rows: DataFrame, verdict: Column | None = None) -> DataFrame:
    """Rows with verdict and kind, by rules where no model is needed.

    Abstention questions are correct exactly if refused. A refusal is wrong: a retrieval miss if
    there is gold and none of it was cited, else a false refusal. An answer takes ``verdict``, an
    expression of correct, incorrect or unjudged from an injected judge; unjudged without one, or
    where answer or gold is empty.
    """
    blank = lambda c: F.coalesce(F.trim(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")) == "", F.lit(True))
    absent, answered, abst = F.col("status") == report.ABSENT, F.col("status") == report.ANSWERED, F.col("is_abstention")
    graded = F.when(blank("answer") | blank("gold"), "unjudged").otherwise(F.lit("unjudged") if verdict is None else F.coalesce(verdict, F.lit("unjudged")))
    missed = (F.col("gold_n") > 0) & ~F.col("hit")
    out = rows.withColumn(
        "verdict",
        F.when(abst & absent, "correct").when(abst & answered, "incorrect").when(abst, "unjudged")
        .when(absent, "incorrect").when(answered, graded).otherwise("unjudged"),
    )
    kind = (
        F.when(abst & absent, "refused").when(abst & answered, "hallucinated")
        .when(~abst & absent & missed, "retrieval_miss").when(~abst & absent, "false_refusal")
        .when(F.col("verdict") == "unjudged", report.UNMEASURED).otherwise(F.col("verdict"))
    )
    return out.withColumn("kind", kind)


def says_gold() -> Column:
    """An offline stand-in for a judge: correct if the gold text occurs in the answer, apart from case."""
    return F.when(F.contains(F.lower("answer"), F.lower(F.trim("gold"))), "correct").otherwise("incorrect")


def tally(judged: DataFrame, *by: str) -> DataFrame:
    """Counts and rates of answerable rows, in all or by columns; accuracy is null if nothing was graded."""
    real = judged.where("not is_abstention")
    is_ = lambda c, v: F.count_if(F.col(c) == v)
    sums = [
        F.count("*").alias("n"), is_("verdict", "correct").alias("correct"), is_("verdict", "incorrect").alias("incorrect"), is_("verdict", "unjudged").alias("unjudged"),
        is_("kind", "false_refusal").alias("false_refusals"), is_("kind", "retrieval_miss").alias("retrieval_misses"),
    ]
    out = (real.groupBy(*by) if by else real.groupBy()).agg(*sums)
    graded = F.col("correct") + F.col("incorrect")
    return out.withColumn("accuracy", report.ratio("correct", graded)).withColumn("false_refusal_rate", report.ratio("false_refusals", graded - F.col("retrieval_misses")))


def abstention(judged: DataFrame) -> DataFrame:
    """One row on abstention questions, never mixed with the others."""
    rows = judged.where("is_abstention")
    out = rows.agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "refused").alias("refused"), F.count_if(F.col("kind") == "hallucinated").alias("hallucinated"))
    return out.withColumn("unjudged", F.col("n") - F.col("refused") - F.col("hallucinated")).withColumn("refusal_rate", report.ratio("refused", F.col("refused") + F.col("hallucinated")))


def headline(judged: DataFrame) -> DataFrame:
    """One row: answered, wrong answers, precision and the headroom if false refusals were answered as precisely."""
    t = tally(judged)
    graded = F.col("correct") + F.col("incorrect")
    answered = graded - F.col("false_refusals") - F.col("retrieval_misses")
    precision = F.try_divide(F.col("correct").cast("double"), answered.cast("double"))
    est = F.when(
        (F.col("false_refusals") > 0) & (answered > 0),
        F.round((F.col("correct") + F.col("false_refusals") * precision) / graded, 3),
    )
    return t.select(
        graded.alias("graded"), "correct", answered.alias("answered"), (answered - F.col("correct")).alias("answered_wrong"),
        "false_refusals", "retrieval_misses", "accuracy", report.ratio("correct", answered).alias("precision"), est.alias("headroom"),
    )


def regimes(rows: DataFrame, judged: DataFrame) -> DataFrame:
    """Per type: recall joined to accuracy, and conversion, the share of found evidence that was answered right."""
    r = recall_by_type(rows).select("question_type", "recall")
    t = tally(judged, "question_type").select("question_type", "n", "accuracy", "false_refusals", "retrieval_misses")
    return t.join(r, "question_type", "left").withColumn("conversion", report.conversion("accuracy", "recall"))


def offsets(slots: DataFrame, instances: DataFrame) -> DataFrame:
    """(question_id, gold, late): seconds from question to session, of instances with at least one gold session."""
    asked = instances.where("asked_at is not null").select("question_id", "asked_at", F.coalesce("answer_session_ids", F.array().cast("array<string>")).alias("gold_ids")).distinct()
    rows = slots.join(asked, "question_id").select(
        "question_id", F.coalesce(F.array_contains("gold_ids", F.col("sid")), F.lit(False)).alias("gold"), (F.col("ts") - F.col("asked_at")).alias("late")
    )
    has = rows.where("gold").select("question_id").distinct()
    return rows.join(has, "question_id", "left_semi")


def date_audit(offs: DataFrame) -> DataFrame:
    """(tolerance, label, fitting, pct, others_admitted): instances whose latest gold session fits a tolerance."""
    table = F.explode(F.array(*[F.lit(t).cast("bigint") for t in TOLERANCES])).alias("tolerance")
    worst = offs.where("gold").groupBy("question_id").agg(F.max("late").alias("worst"))
    fits = worst.select("worst", table).groupBy("tolerance").agg(F.count_if(F.col("worst") <= F.col("tolerance")).alias("fitting"), F.count("*").alias("n"))
    others = offs.where("not gold").select("late", table).groupBy("tolerance").agg(F.count_if((F.col("late") > 0) & (F.col("late") <= F.col("tolerance"))).alias("others_admitted"))
    return fits.join(others, "tolerance", "left").select(
        "tolerance", timeparse.tolerance_label("tolerance").alias("label"), "fitting",
        F.round(F.col("fitting") / F.col("n") * 100, 1).alias("pct"), F.coalesce("others_admitted", F.lit(0)).alias("others_admitted"),
    )


def offset_bucket(late: Column | str) -> Column:
    late = F.col(late) if isinstance(late, str) else late
    out = F.when(late <= 0, "<=0 (before the question)")
    for most, name in ((HOUR, "0-1h"), (6 * HOUR, "1-6h"), (DAY, "6-24h"), (2 * DAY, "1-2d"), (7 * DAY, "2-7d")):
        out = out.when(late <= most, name)
    return out.otherwise(">7d")


def offset_buckets(offs: DataFrame) -> DataFrame:
    return offs.groupBy("gold", offset_bucket("late").alias("bucket")).agg(F.count("*").alias("n"))


def miss_verdict() -> Column:
    """EXTRACTION, RANKING or FILTER from gold_claims, best_rank, candidates and dropped_future."""
    ranked = F.col("best_rank").isNotNull()
    cut = F.coalesce("candidates", F.lit(0))
    return (
        F.when(F.coalesce("gold_claims", F.lit(0)) == 0, "EXTRACTION")
        .when(ranked & (cut > 0) & (F.col("best_rank") > cut), "RANKING")
        .when(ranked & (F.coalesce("dropped_future", F.lit(0)) > 0), "FILTER")
        .when(ranked, "RANKING")
        .otherwise("EXTRACTION")
    )


def diagnose_misses(misses: DataFrame, claims: DataFrame, hits: DataFrame) -> DataFrame:
    """(q, gold_claims, best_rank, gold_in_depth, verdict) of answerable rows without gold in their evidence.

    ``misses`` has q, gold_sessions, candidates, dropped_future; ``claims`` key and sid; ``hits``
    a deep search (q, key, rank).
    """
    gold = misses.select("q", F.explode(F.array_distinct("gold_sessions")).alias("sid"))
    sizes = claims.where("sid is not null").groupBy("sid").agg(F.count("*").alias("c"))
    n = gold.join(sizes, "sid").groupBy("q").agg(F.sum("c").alias("gold_claims"))
    ranks = hits.join(claims.select("key", "sid"), "key").join(gold, ["q", "sid"]).groupBy("q").agg(F.min("rank").alias("best_rank"), F.count("*").alias("gold_in_depth"))
    out = misses.join(n, "q", "left").join(ranks, "q", "left").withColumn("verdict", miss_verdict())
    return out.select("q", F.coalesce("gold_claims", F.lit(0)).alias("gold_claims"), "best_rank", F.coalesce("gold_in_depth", F.lit(0)).alias("gold_in_depth"), "verdict")


def diagnose_refusals(judged: DataFrame) -> DataFrame:
    """(question_type, refusals, gold_present, gold_absent) of refusals of answerable questions."""
    rows = judged.where(F.col("kind").isin("false_refusal", "retrieval_miss"))
    out = rows.groupBy("question_type").agg(F.count("*").alias("refusals"), F.count_if("hit").alias("gold_present"))
    return out.withColumn("gold_absent", F.col("refusals") - F.col("gold_present"))


def allocate(sizes: dict[str, int], sample: int, floor: int = 0, special: str = "abstention") -> dict[str, int]:
    """How many of each stratum: up to ``floor`` of the special one beforehand, the others by largest remainder.

    In whole numbers: every stratum gets its share rounded down, and the places left go one each to
    the largest remainders, ties by name. There are fewer places left than strata with a
    remainder, and a stratum with a remainder is never full, so nothing is left to hand out.
    """
    if sample >= sum(sizes.values()):
        return dict(sizes)
    first = min(floor, sizes.get(special, 0), sample)
    pool = {k: n - first * (k == special) for k, n in sizes.items()}
    whole, room = sum(pool.values()), sample - first
    shares = {k: divmod(room * n, whole) for k, n in pool.items() if n}
    left = room - sum(share for share, _ in shares.values())
    ranked = sorted(shares, key=lambda k: (-shares[k][1], k))
    take = {k: shares[k][0] + (k in ranked[:left]) for k in shares}
    return take | ({special: take.get(special, 0) + first} if first else {})


#: Rows of a stratum that one task ranks.
RANKED = 50_000


def stratified_sample(instances: DataFrame, sample: int, seed: int = 0, floor: int = 0) -> DataFrame:
    """(question_id, stratum): a slice in which every kind of question keeps its share. Sampling is the feature.

    Only the sizes of strata reach the driver, at most 1,000 of them; more is an error. Within a
    stratum the order is a hash of id and seed. A stratum is ranked in chunks by that hash, and only
    the first of each chunk, no more than the largest share, are ranked among each other.
    """
    stratum = F.when(F.coalesce("is_abstention", F.lit(False)), "abstention").otherwise(F.coalesce("question_type", F.lit("unknown")))
    rows = instances.where("question_id is not null").groupBy("question_id").agg(F.min(stratum).alias("stratum"))
    sizes = {r.stratum: r.n for r in rows.groupBy("stratum").agg(F.count("*").alias("n")).orderBy("stratum").limit(1001).collect()}
    if len(sizes) > 1000:
        raise ValueError("more than 1000 strata")
    take = {k: n for k, n in allocate(sizes, sample, floor).items() if n}
    if not take:
        return rows.limit(0)
    chunks = -(-max(sizes.values()) // RANKED)
    order = [F.sha2(F.concat_ws("|", "question_id", F.lit(str(seed))), 256), F.col("question_id")]
    chunk = F.pmod(F.xxhash64("question_id"), F.lit(chunks))
    ahead = rows.withColumn("__r", F.row_number().over(Window.partitionBy("stratum", chunk).orderBy(*order))).where(F.col("__r") <= max(take.values()))
    most = F.create_map(*[F.lit(x) for kv in take.items() for x in kv])[F.col("stratum")]
    final = ahead.withColumn("__r", F.row_number().over(Window.partitionBy("stratum").orderBy(*order)))
    return final.where(F.col("__r") <= F.coalesce(most, F.lit(0))).drop("__r")


def done_ids(rows: DataFrame, retry_unmeasured: bool) -> DataFrame:
    """(question_id) that need no further work: any logged id, or with retry those whose last row is measured."""
    from memq.operators.memory import last_rows

    if not retry_unmeasured:
        return rows.where("question_id is not null").select("question_id").distinct()
    last = last_rows(rows, ["question_id"], "line_no")
    return last.where(F.coalesce(report.status("status") != report.UNMEASURED, F.lit(True))).select("question_id")
