"""Search terms: tokens without stopwords, with plural and verb endings stripped.

The expressions are SQL text that Spark and other engines read alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that carry no meaning in a question.
STOPWORDS = """
a about after again all also am an and any are as at be because been before being between both but by can could
did do does doing done during each else ever every few for from further get got had has have having he her here hers
him his how i if in into is it its just know let like make many may me might more most much must my no nor not now
of off on once only or other our out over own please remember said same say see should since so some still such tell
than that the their them then there these they thing things this those through to told too type under until up us use
used very want was way we were what when where whether which while who whom whose why will with would you your
""".split()
# Endings in the order in which they are tried, and what must remain.
ENDINGS = "ational iveness fulness ousness ization ations ically ingly edly ment ness tion sion ing ers ies ed es s".split()
LEAST, LEAST_PLURAL, DOUBLED = 4, 3, "bdgmnprt"


def stem_sql(w: str) -> str:
    """CASE expression that strips the first ending of the list that leaves enough of the word."""
    cases = []
    for end in ENDINGS:
        n = len(end)
        least = LEAST_PLURAL if end == "s" else LEAST
        base = f"substr({w}, 1, length({w}) - {n})"
        if end == "ies":
            result = f"concat({base}, 'y')"
        elif end in ("ing", "ed"):
            last, before = f"substr({w}, length({w}) - {n}, 1)", f"substr({w}, length({w}) - {n + 1}, 1)"
            doubled = ", ".join(f"'{c}'" for c in DOUBLED)
            shorter = f"substr({w}, 1, length({w}) - {n + 1})"
            result = f"case when {last} = {before} and {last} in ({doubled}) then {shorter} else {base} end"
        else:
            result = base
        cases.append(f"when length({w}) >= {n + least} and right({w}, {n}) = '{end}' then {result}")
    return "case " + " ".join(cases) + f" else {w} end"


def stem(w: str) -> str:
    """What stem_sql() gives, for a single word."""
    for end in ENDINGS:
        n = len(end)
        if len(w) >= n + (LEAST_PLURAL if end == "s" else LEAST) and w.endswith(end):
            base = w[:-n]
            if end == "ies":
                return base + "y"
            return base[:-1] if end in ("ing", "ed") and base[-1] == base[-2] and base[-1] in DOUBLED else base
    return w


def raw_tokens(c: Column | str) -> Column:
    """ASCII letters and digits, lower-cased; null gives an empty array."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def explode_terms(df: DataFrame, c: Column | str, name: str = "term", stemming: bool = True) -> DataFrame:
    """One row per token that is no stopword, the term in column ``name``; rows without terms vanish."""
    t = df.withColumn(name, F.explode(raw_tokens(c))).where(~F.col(name).isin(STOPWORDS))
    return t.withColumn(name, F.expr(stem_sql(f"`{name}`"))) if stemming else t


def kept_tokens(c: Column | str) -> Column:
    """The tokens that are no stopwords, as an array, not stemmed."""
    return F.filter(raw_tokens(c), lambda w: ~w.isin(STOPWORDS))


def terms(column: str, stemming: bool = True) -> Column:
    """The terms of a text column as an array."""
    words = ", ".join(f"'{w}'" for w in STOPWORDS)
    kept = f"filter(regexp_extract_all(lower(coalesce(`{column}`, '')), '[a-z0-9]+', 0), w -> w not in ({words}))"
    return F.expr(f"transform({kept}, w -> {stem_sql('w')})" if stemming else kept)


def claim_document() -> Column:
    """The text by which a claim is found."""
    return F.concat_ws(" ", "subj", "pred", "obj", "kind")


def coded(docs: DataFrame, key: str, text: Column, vocabulary: set[str] | None, stemming: bool = True, memo: int = 500_000) -> DataFrame:
    """(key, code): of each document the number of its terms, then those in the vocabulary, sorted, with repetitions.

    All terms where there is no vocabulary. Each distinct token is stemmed and looked up once as long as ``memo`` hold them.
    """
    spark, kind = docs.sparkSession, docs.select(key).dtypes[0][1]
    known, stop = spark.sparkContext.broadcast(vocabulary), frozenset(STOPWORDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, seen, tokens = known.value, {}, re.compile("[a-z0-9]+").findall

        def look(w: str) -> str | None:
            """None for a stopword, nothing for a term that nobody asks for."""
            t = None if w in stop else stem(w) if stemming else w
            if len(seen) >= memo:
                seen.clear()
            seen[w] = t = "" if t and wanted is not None and t not in wanted else t
            return t

        for b in batches:
            codes = []
            for x in b.column(1).to_pylist():
                found = [t for t in [seen[w] if w in seen else look(w) for w in tokens(x)] if t is not None]
                codes.append(" ".join([str(len(found)), *sorted(filter(None, found))]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(codes, pa.string())], ["key", "code"])

    rows = docs.select(F.col(key).alias("key"), F.lower(F.coalesce(text, F.lit(""))).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, code string")
