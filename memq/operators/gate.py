"""Candidate claims for a question: BM25 whose every score shows its terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memq.functions import terms
from memq.operators.skew import may_hold, salted_join
from memq.session import materialize, once

K1, B = 1.2, 0.75
#: Hits from which sessions are chosen.
POOL = 200


class EmbeddingGate:
    """There is no embedding backend; naming one must fail rather than fall back to something else."""

    def __init__(self, *_: object, **__: object) -> None:
        raise NotImplementedError("no embedding backend is installed; use index() and search()")


def index(docs: DataFrame, key: str, text: Column, stemming: bool = True) -> tuple[DataFrame, DataFrame, int, float]:
    """(postings, frequencies, n, avg_len) of documents with unique keys.

    postings (term, key, len, tf), where len counts all terms of the document; frequencies (term,
    df). A document without terms has no posting but counts in n and avg_len. Statistics are over
    all documents. Documents and postings are written out once and read by every search.
    """
    base = materialize(docs.select(F.col(key).alias("key"), text.alias("text")))
    tokens = base.select("key", terms.kept_tokens("text").alias("tokens"))
    each = tokens.select("key", F.size("tokens").alias("len"), F.explode("tokens").alias("term"))
    stemmed = each.withColumn("term", F.expr(terms.stem_sql("term"))) if stemming else each
    postings = materialize(stemmed.groupBy("term", "key", "len").agg(F.count("*").alias("tf")))
    n, total = base.count(), postings.agg(F.coalesce(F.sum("tf"), F.lit(0))).first()[0]
    return postings, postings.groupBy("term").agg(F.count("*").alias("df")), n, total / n if n else 0.0


def idf(n: int) -> Column:
    """The weight of a term from its number of documents, in column df."""
    df = F.col("df")
    return F.greatest(F.lit(0.0), F.log(F.lit(1.0) + (F.lit(float(n)) - df + 0.5) / (df + 0.5)))


def contribution(avg: float) -> Column:
    """What a term adds to a document's score, from columns idf, tf and len, rounded to 9 places."""
    tf = F.col("tf").cast("double")
    norm = F.greatest(F.col("len"), F.lit(1)) / F.lit(float(avg or 1.0))
    return F.round(F.col("idf") * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * norm)), 9)


def contributions(questions: DataFrame, parts: tuple[DataFrame, DataFrame, int, float], qkey: str, qtext: Column, stemming: bool = True) -> DataFrame:
    """(q, key, term, contrib): what each term of a question adds to a document's score, rounded to 9 places.

    A question's terms are a set. Only postings of terms that some question has are scored. Questions
    meet the weights of their terms first; the join with postings is salted by the pairs a term
    makes, so a term that most documents hold and most questions ask for is spread over many tasks.
    """
    postings, frequencies, n, avg = parts
    asked = terms.explode_terms(questions.select(F.col(qkey).alias("q"), qtext.alias("__text")), "__text", stemming=stemming).select("q", "term").distinct()
    asked = once(asked)
    uses = asked.groupBy("term").agg(F.count("*").alias("__uses"))
    wanted = frequencies.join(uses, "term").select("term", idf(n).alias("idf"), (F.col("df") * F.col("__uses")).alias("pairs"))
    wanted = asked.join(wanted, "term").where("idf > 0")
    scored = salted_join(postings, wanted, ["term"], "pairs").select("q", "key", "term", contribution(avg).alias("contrib"))
    return scored.where("contrib > 0")


def search(contribs: DataFrame, limit: int = 20, least: float = 0.0) -> DataFrame:
    """(q, key, score, rank): the best ``limit`` documents of each question with a score above ``least``; ties by key."""
    scores = contribs.groupBy("q", "key").agg(F.round(F.sum("contrib"), 6).alias("score")).where(F.col("score") > least)
    best = Window.partitionBy("q").orderBy(F.col("score").desc(), "key")
    return scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)


def matched_terms(contribs: DataFrame, hits: DataFrame) -> DataFrame:
    """(q, key, terms): of each hit the terms with what they added to 4 places, largest first, ties by term."""
    pairs = contribs.join(hits.select("q", "key"), ["q", "key"])
    return pairs.groupBy("q", "key").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct((-F.col("contrib")).alias("minus"), "term"))),
            lambda x: F.struct(x["term"].alias("term"), F.round(-x["minus"], 4).alias("contrib")),
        ).alias("terms")
    )


def search_sessions(contribs: DataFrame, docs: DataFrame, sessions: int = 3, pool: int = POOL, per_session: int = 40) -> DataFrame:
    """(q, key, sid, score): the claims of each question's best sessions, by its hits in a pool of ``pool``; see best_sessions()."""
    return best_sessions(search(contribs, pool), docs, sessions, per_session)


def best_sessions(hits: DataFrame, docs: DataFrame, sessions: int = 3, per_session: int = 40) -> DataFrame:
    """(q, key, sid, score): the claims of each question's best sessions, from hits (q, key, score).

    A session scores the sum of its rounded hits. All its first ``per_session`` documents by key
    come back, with score 0 if they did not match; a match past that place is lost. ``docs`` has key
    and sid; a null sid belongs to no session. Only documents of sessions that are chosen are ranked.
    """
    hits = materialize(hits.select("q", "key", "score"))
    own = materialize(docs.where("sid is not null").select("key", "sid"))
    totals = hits.join(own, "key").groupBy("q", "sid").agg(F.round(F.sum("score"), 6).alias("total"))
    best = totals.withColumn("__r", F.row_number().over(Window.partitionBy("q").orderBy(F.col("total").desc(), "sid"))).where(F.col("__r") <= sessions)
    best = materialize(best.select("q", "sid"))
    chosen = may_hold(own, best.select("sid"), ["sid"]).join(best.select("sid").distinct(), "sid", "left_semi")
    shelf = chosen.withColumn("__r", F.row_number().over(Window.partitionBy("sid").orderBy("key"))).where(F.col("__r") <= per_session).drop("__r")
    out = best.join(shelf, "sid").join(hits, ["q", "key"], "left")
    return out.select("q", "key", "sid", F.coalesce("score", F.lit(0.0)).alias("score"))
