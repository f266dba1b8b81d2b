"""Long exact spans shared between records: winnowed anchors, extended both ways."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memq.operators.skew import PER_TASK, may_hold, salted_join
from memq.session import materialize, written

#: Characters of the shortest span, and of an anchor.
SPAN, ANCHOR = 300, 100
_B = 0x9E3779B97F4A7C15
_B_INVERSE = pow(_B, -1, 1 << 64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, b in enumerate((_B, _B_INVERSE)):
            steps = np.full(max(n, 2 * len(_POWERS[i]), 65_536), np.uint64(b), np.uint64)
            steps[0] = 1
            _POWERS[i] = np.cumprod(steps)
    return _POWERS


class Prints:
    """Karp-Rabin fingerprints of all windows of a text's code points, modulo 2 to the 64th."""

    def __init__(self, text: str) -> None:
        self.chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.n = len(self.chars)
        up, self.down = _powers(self.n + 1)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(_mix(self.chars.astype(np.uint64) + np.uint64(_B)) * up[: self.n], out=self.sums[1:])

    def windows(self, size: int) -> np.ndarray:
        end = self.n - size + 1
        return _mix((self.sums[size:] - self.sums[:end]) * self.down[:end])


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, by running minima of blocks of w from both sides."""
    n = len(x)
    whole = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    whole[:n] = x
    rows = whole.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def blocks(prints: Prints, span: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, block, first window, last window) of a text: runs of windows of ``span`` characters with one anchor.

    The anchor of a window is its least fingerprint of ``anchor`` characters, so equal windows have
    equal anchors. A run's block is a hash, unlike the fingerprints, of the text its windows cover.
    """
    least = _sliding_min(prints.windows(anchor), span - anchor + 1)
    first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    last = np.append(first[1:], len(least)) - 1
    covered = [xxhash.xxh3_64_intdigest(prints.chars[f:e]) for f, e in zip(first.tolist(), (last + span).tolist())]
    return least[first], np.array(covered, np.uint64), first, last


def _batch(columns: dict[str, list[np.ndarray]], schema: pa.Schema) -> pa.RecordBatch:
    parts = [np.concatenate(v) if v else np.empty(0, np.int64) for v in columns.values()]
    return pa.RecordBatch.from_arrays([pa.array(p.view(np.int64) if p.dtype == np.uint64 else p) for p in parts], schema=schema)


def anchors(docs: DataFrame, key: str, text: str, span: int, anchor: int) -> DataFrame:
    """(anchor, block, doc, span): span holds the first and last window, 32 bits each."""
    schema = pa.schema([(n, pa.int64()) for n in ("anchor", "block", "doc", "span")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {n: [] for n in schema.names}
            for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                a, block, first, last = blocks(Prints(t), span, anchor)
                for n, v in zip(schema.names, (a, block, np.full(len(a), doc, np.int64), (first << 32) | last)):
                    out[n].append(v)
            yield _batch(out, schema)

    long = docs.select(F.col(key).cast("bigint"), text).where(F.col(key).isNotNull() & (F.length(text) >= span))
    return long.mapInArrow(run, "anchor bigint, block bigint, doc bigint, span bigint")


def contexts(docs: DataFrame, key: str, text: str, wanted: DataFrame, span: int) -> DataFrame:
    """(anchor, doc, first, asks, around): the text that the windows of each wanted (anchor, doc, span, asks) cover.

    Only texts of documents with a wanted block are shuffled; a bounded bitmap keeps out the others.
    """
    lists = materialize(wanted.groupBy("doc").agg(F.collect_list(F.struct("anchor", "span", "asks")).alias("blocks")))
    rows = may_hold(docs.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text")), lists, ["doc"])
    each = rows.join(lists.hint("merge"), "doc").select("doc", "text", F.inline("blocks"))
    first = F.shiftright("span", 32)
    size = F.col("span").bitwiseAND(0xFFFFFFFF) - first + span
    around = F.substr("text", (first + 1).cast("int"), size.cast("int"))
    return materialize(each.select("anchor", "doc", first.alias("first"), "asks", around.alias("around")))


def edges(around: DataFrame, span: int) -> DataFrame:
    """(doc, from_at, to_at) of blocks that ask: what other documents share of the text around an anchor, verified.

    A window of ``span`` characters that holds the anchor extends it by so many characters to the
    left and the rest to the right. Windows of one anchor are grouped by two hashes; a window is
    shared if the group has another document, and the first or last member of the group is its
    witness. Windows of one block with the same witness at the same distance are one match; its
    text is compared with that of the witness, and it is kept only if the two are equal. As all
    windows of a block hold its anchor, what is kept of a block is one range.
    """
    cut = around.select("anchor", "doc", F.shiftleft("first", 32).alias("first"), "asks", "around", F.explode(F.sequence(F.lit(0), F.length("around") - span)).alias("at"))
    window = F.substr("around", F.col("at") + 1, F.lit(span))
    found = materialize(
        cut.select("anchor", F.xxhash64(window).alias("h1"), F.xxhash64(F.lit(1), window).alias("h2"), "doc", "asks", F.col("first").bitwiseOR(F.col("at").cast("bigint")).alias("place"))
    )
    group = ["anchor", "h1", "h2"]
    holds = F.when(F.col("asks") == 0, F.col("doc"))
    again = (
        found.groupBy(*group)
        .agg(
            F.min("doc").alias("d0"), F.min_by("place", "doc").alias("p0"), F.max("doc").alias("d1"), F.max_by("place", "doc").alias("p1"),
            F.max(holds).alias("holder"), F.max_by("place", holds).alias("held"), F.count("*").alias("n"),
        )
        .where("d0 != d1 or holder is not null")  # a window that need not ask lies in two documents, one of which may be the asking one
    )
    other = F.when(F.col("d0") != F.col("doc"), F.struct(F.col("d0").alias("doc"), F.col("p0").alias("place"))).otherwise(F.struct(F.col("d1").alias("doc"), F.col("p1").alias("place")))
    witness = F.when(F.col("holder").isNotNull(), F.struct(F.col("holder").alias("doc"), F.col("held").alias("place"))).otherwise(other)
    hits = salted_join(found.where("asks = 1"), again, group, "n", per_task=PER_TASK).select("doc", "place", witness.alias("w"))
    first, at = (lambda c: F.shiftright(c, 32)), (lambda c: F.col(c).bitwiseAND(0xFFFFFFFF).cast("int"))
    match = ["doc", "first", "wdoc", "wfirst", "shift"]
    matches = materialize(
        hits.select("doc", first("place").alias("first"), at("place").alias("at"), F.col("w.doc").alias("wdoc"), first("w.place").alias("wfirst"), (at("w.place") - at("place")).alias("shift"))
        .groupBy(*match)
        .agg(F.min("at").alias("low"), F.max("at").alias("high"))
    )
    texts = around.select("doc", "first", "around")
    uses = matches.groupBy("wdoc", "wfirst").agg(F.count("*").alias("n"))
    other = uses.join(texts.select(F.col("doc").alias("wdoc"), F.col("first").alias("wfirst"), F.col("around").alias("waround")), ["wdoc", "wfirst"])
    both = salted_join(matches.join(texts, ["doc", "first"]), other, ["wdoc", "wfirst"], "n", per_task=PER_TASK)
    size = F.col("high") - F.col("low") + span
    same = F.substr("around", F.col("low") + 1, size) == F.substr("waround", F.col("low") + F.col("shift") + 1, size)
    kept = both.where(same).groupBy("doc", "first").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return kept.select("doc", (F.col("first") + F.col("low")).alias("from_at"), (F.col("first") + F.col("high") + span).alias("to_at"))


def shared_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, anchor: int = ANCHOR) -> DataFrame:
    """(doc, from_at, to_at): ranges of at least ``span`` characters of a document that lie in such spans of other ones.

    Ranges of one document may overlap and touch; together they cover every maximal repeat.
    Every window of ``span`` characters has a winnowed anchor that depends on its text alone, so
    documents sharing a window share the anchor. Documents are joined on anchors without making
    pairs: an anchor's occurrences are grouped by their whole block, the text of all windows with
    that anchor. A block found in two documents is shared as far as the anchor reaches, which
    extends a match from anchor to anchor. Where blocks of a shared anchor differ, a match begins
    or ends, and there edges() extends it to both sides, of one occurrence for each differing
    block. Work is linear in the occurrences of a repeat. Keys must be unique integers; null keys
    and null, empty or short texts share nothing.
    """
    occurrences = materialize(anchors(docs, key, text, span, anchor))
    shared = materialize(
        occurrences.groupBy("anchor").agg(F.min("doc").alias("d0"), F.max("doc").alias("d1"), F.count("*").alias("n")).where("d0 != d1").select("anchor", "n")
    )
    hits = materialize(salted_join(may_hold(occurrences, shared, ["anchor"]), shared, ["anchor"], "n", per_task=PER_TASK))
    keys = ["anchor", "block"]
    by_block = materialize(
        hits.groupBy(*keys)
        .agg(F.min("doc").alias("d0"), F.max("doc").alias("d1"), F.min_by("span", F.struct("doc", "span")).alias("held"), F.count("*").alias("n"))
        .select(*keys, (F.col("d0") != F.col("d1")).alias("whole"), F.col("d0").alias("holder"), "held", "n")
    )
    told = materialize(salted_join(hits, written(by_block.select(*keys, "whole", "n")), keys, "n", per_task=PER_TASK).select("anchor", "doc", "span", "whole"))
    ranges = told.where("whole").select("doc", F.shiftright("span", 32).alias("from_at"), (F.col("span").bitwiseAND(0xFFFFFFFF) + span).alias("to_at"))
    # a block of one document asks; one occurrence of a block of several is there to be compared with
    asking = by_block.where("not whole").groupBy("anchor").agg(F.count("*").alias("asking"))
    compared = by_block.where("whole").join(asking, "anchor", "left_semi").select("anchor", F.col("holder").alias("doc"), F.col("held").alias("span"), F.lit(0).alias("asks"))
    wanted = told.where("not whole").select("anchor", "doc", "span", F.lit(1).alias("asks")).unionByName(compared)
    return ranges.unionByName(edges(contexts(docs, key, text, wanted, span), span))


def shared_chars(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, anchor: int = ANCHOR) -> DataFrame:
    """(key, shared_chars): documents with a shared span, and how many characters lie in any, each once."""
    ranges = shared_spans(docs, key, text, span, anchor).groupBy("doc").agg(F.array_sort(F.collect_set(F.struct("from_at", "to_at"))).alias("ranges"))
    none = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("upto"))
    total = F.aggregate(
        "ranges",
        none,
        lambda acc, r: F.struct(
            (acc["n"] + F.greatest(F.lit(0), r["to_at"] - F.greatest(acc["upto"], r["from_at"]))).alias("n"),
            F.greatest(acc["upto"], r["to_at"]).alias("upto"),
        ),
        lambda acc: acc["n"],
    )
    return ranges.select(F.col("doc").alias(key), total.alias("shared_chars"))
