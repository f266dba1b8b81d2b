"""Filling fixed-capacity containers with texts: minimum bin slack over the multiset of lengths."""

from __future__ import annotations

import base64
import bisect
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memq.session import materialize

CAPACITY = 2_048
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-tokenisation pattern of the byte-level vocabulary (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Items of one length that one task ranks.
CHUNK = 50_000
#: Largest vocabulary file.
MOST_BYTES = 32 << 20
_ENCODERS: dict = {}


def vocabulary(path: str) -> bytes:
    """A file of ranks as it is on the driver; more than MOST_BYTES is an error, since it is broadcast."""
    data = Path(path).read_bytes()
    if len(data) > MOST_BYTES:
        raise ValueError(f"{path} has more than {MOST_BYTES} bytes")
    return data


def encoder(path: str, data: bytes):
    """A tiktoken encoder for the contents of a file of ranks; one per worker and path."""
    if path not in _ENCODERS:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        _ENCODERS[path] = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def token_counts(docs: DataFrame, key: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, n_tokens): whole texts; null counts as empty. The vocabulary is read on the driver, so workers need not have the file."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(tokenizer))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer, shared.value)
        for b in batches:
            yield pd.DataFrame({key: b[key], "n_tokens": [len(enc.encode_ordinary(t)) if t else 0 for t in b[text]]})

    return docs.select(key, text).mapInPandas(run, f"`{key}` {dict(docs.dtypes)[key]}, n_tokens int")


def fill(lengths: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, dict[int, int]]]:
    """(first container, containers, {length: items in each}) for a multiset of lengths.

    Each step takes the longest length left and fills the rest of the window as closely as
    possible: a subset-sum table over bounded counts, one bitset per length, gives the largest
    reachable sum, and going back through the bitsets gives the counts. The same filling is used
    as often as the counts allow, so the steps depend on the number of lengths, not of items: each
    step leaves some length with fewer items than one window holds of it.
    """
    left = {k: n for k, n in lengths.items() if n > 0}
    if any(not 0 < k <= capacity for k in left):
        raise ValueError("lengths must be from 1 to the capacity")
    order = sorted(left)
    out, first = [], 0
    while order:
        longest = order[-1]
        target = capacity - longest
        mask = (1 << (target + 1)) - 1
        reach, steps = 1, []
        for i in range(bisect.bisect_right(order, target) - 1, -1, -1):
            k = order[i]
            most = min(left[k] - (k == longest), target // k)
            if most <= 0:
                continue
            steps.append((k, most, reach))
            part, rest = 1, most
            while rest:
                part = min(part, rest)
                reach |= (reach << (part * k)) & mask
                rest -= part
                part *= 2
            if reach >> target & 1:
                break
        at = reach.bit_length() - 1
        take = {longest: 1}
        for k, most, before in reversed(steps):
            j = next(j for j in range(most + 1) if at - j * k >= 0 and before >> (at - j * k) & 1)
            if j:
                take[k] = take.get(k, 0) + j
                at -= j * k
        times = min(left[k] // n for k, n in take.items())
        out.append((first, times, take))
        first += times
        for k, n in take.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
                order.pop(bisect.bisect_left(order, k))
    return out


def assign(docs: DataFrame, key: str, text: str, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, piece_no, token_from, n_tokens, container): each text in a container, split only above the capacity.

    A text above the capacity is cut into pieces of the capacity and a rest. A text without tokens
    (null or empty) takes no room and has container -1. ``key`` must be unique. What reaches the
    driver is the histogram of lengths, at most ``capacity`` rows; items are ranked within their
    length in chunks, and a container is looked up from the rank.
    """
    sized = materialize(token_counts(docs, key, text, tokenizer))
    per = F.greatest(F.ceil(F.col("n_tokens") / capacity), F.lit(1)).cast("int")
    items = sized.select(key, "n_tokens", F.explode(F.sequence(F.lit(0), per - 1)).alias("piece_no")).select(
        key,
        "piece_no",
        (F.col("piece_no") * capacity).alias("token_from"),
        F.least(F.lit(capacity), F.col("n_tokens") - F.col("piece_no") * capacity).alias("n_tokens"),
    )
    histogram = {r.n_tokens: r.n for r in items.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}
    none = histogram.pop(0, 0)
    slots: dict[int, tuple[list, list, list]] = {}
    used: dict[int, int] = {}
    for first, times, take in fill(histogram, capacity):
        for k, n in take.items():
            begins, firsts, each = slots.setdefault(k, ([], [], []))
            begins.append(used.get(k, 0))
            firsts.append(first)
            each.append(n)
            used[k] = used.get(k, 0) + n * times
    chunks = max(1, -(-(sum(histogram.values()) + none) // CHUNK))
    items = items.withColumn("chunk", F.pmod(F.xxhash64(key, "piece_no"), F.lit(chunks)))
    sizes = items.groupBy("n_tokens", "chunk").agg(F.count("*").alias("n"))
    offsets = sizes.select(
        "n_tokens",
        "chunk",
        F.coalesce(F.sum("n").over(Window.partitionBy("n_tokens").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"),
    )
    ranked = (
        items.withColumn("rank", F.row_number().over(Window.partitionBy("n_tokens", "chunk").orderBy(key, "piece_no")) - 1)
        .join(offsets.hint("merge"), ["n_tokens", "chunk"])
        .select(key, "piece_no", "token_from", "n_tokens", (F.col("rank") + F.col("offset")).alias("rank"))
    )
    tables = docs.sparkSession.sparkContext.broadcast(slots)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lookup = tables.value
        for b in batches:
            where = []
            for k, rank in zip(b["n_tokens"].tolist(), b["rank"].tolist()):
                if not k:
                    where.append(-1)
                    continue
                begins, firsts, each = lookup[k]
                i = bisect.bisect_right(begins, rank) - 1
                where.append(firsts[i] + (rank - begins[i]) // each[i])
            yield b.drop(columns="rank").assign(container=where)

    kind = dict(docs.dtypes)[key]
    return ranked.mapInPandas(run, f"`{key}` {kind}, piece_no int, token_from int, n_tokens int, container bigint")
