"""Small expressions of reports and of model replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from memq.functions import text

ANSWERED, ABSENT, UNMEASURED = "answered", "absent", "unmeasured"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def status(c: Column | str) -> Column:
    """A status apart from case and outer blanks."""
    return F.lower(F.regexp_replace(_c(c), r"(?U)^\s+|\s+$", ""))


def ratio(n: Column | str, d: Column | str, places: int = 4) -> Column:
    """Rounded share; null if there is nothing to divide by."""
    return F.round(F.try_divide(_c(n).cast("double"), _c(d).cast("double")), places)


def conversion(accuracy: Column | str, recall: Column | str) -> Column:
    """Accuracy over recall, both already rounded; null if either is null or zero."""
    a, r = _c(accuracy), _c(recall)
    return F.when((a != 0) & (r != 0), F.round(a / r, 3))


def is_abstention(question_id: Column | str) -> Column:
    return _c(question_id).endswith("_abs")


def says_not_in_memory(answer: Column | str) -> Column:
    """An empty reply or the agreed words, whatever the case and blanks."""
    a = text.strip(F.coalesce(_c(answer), F.lit("")))
    return (a == "") | (F.replace(F.upper(a), F.lit(" "), F.lit("_")) == "NOT_IN_MEMORY")


def read_verdict(correct: Column | str) -> Column:
    """A model's ``correct`` as text: correct, incorrect, or unjudged for anything unreadable."""
    v = F.lower(F.trim(_c(correct)))
    return F.when(v.isin("true", "yes", "correct"), "correct").when(v.isin("false", "no", "incorrect"), "incorrect").otherwise("unjudged")


def strip_fences(reply: Column | str) -> Column:
    """A reply without the code fence around it."""
    return F.trim(F.regexp_replace(F.trim(_c(reply)), r"^```[A-Za-z]*\s*|\s*```$", ""))


def one_line(c: Column | str, width: int) -> Column:
    """Blanks squeezed, cut to the width."""
    return F.substring(F.trim(F.regexp_replace(_c(c), r"\s+", " ")), 1, width)


def approx_tokens(c: Column | str) -> Column:
    return F.floor(F.length(_c(c)) / 4).cast("bigint")


def chunks(c: Column | str, size: int = 12_000) -> Column:
    """Text cut into parts of ``size`` characters; an empty text is one empty part."""
    c = _c(c)
    last = F.greatest(F.lit(0), F.ceil(F.length(c) / size).cast("int") - 1)
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substr(c, i * size + 1, F.lit(size)))


def join_chunks(parts: Column | str, n: Column | str) -> Column:
    """The text of its parts; fails if a part is missing rather than skip it."""
    p = _c(parts)
    whole = (F.size(p) == _c(n)) & ~F.exists(p, lambda x: x.isNull())
    return F.when(F.coalesce(whole, F.lit(False)), F.array_join(p, "")).otherwise(F.raise_error(F.lit("a chunk is missing")).cast("string"))
