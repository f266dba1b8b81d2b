"""Evaluation texts leaking into a corpus: greedy string tiling over shared word seeds."""

from __future__ import annotations

import heapq
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of the shortest tile, words of one broadcast block of items, share of an item that counts as leaked.
MIN_WORDS, BLOCK_WORDS, COVERAGE = 13, 2_000_000, 0.5
WORD = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, np.uint64)
_SEEDS: dict[str, Seeds] = {}


def words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits after lower-casing."""
    return WORD.findall(text.lower()) if text else []


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        steps = np.full(max(n, 4096), _BASE, np.uint64)
        steps[0] = 1
        _POWERS = np.cumprod(steps)
    return _POWERS


def rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """Running Karp-Rabin fingerprints of all windows of n word numbers."""
    if len(ids) < n:
        return np.empty(0, np.uint64)
    size, base = len(ids) - n + 1, _powers(n)
    out = np.zeros(size, np.uint64)
    for i in range(n):
        out += ids[i : i + size] * base[n - 1 - i]
    return out


class Seeds:
    """The items of one block: word numbers, and where each fingerprint of min_words words occurs."""

    def __init__(self, items: list[tuple[int, str]], min_words: int) -> None:
        self.n, self.vocabulary, self.items = min_words, {}, []
        prints, owners = [], []
        for key, text in items:
            own = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            ids = np.array(own, np.uint64)
            found = rolling(ids, min_words)
            prints.append(found)
            owners += [(len(self.items), p) for p in range(len(found))]
            self.items.append((key, own))
        every = np.concatenate(prints) if prints else np.empty(0, np.uint64)
        self.sorted = np.unique(every)
        self.where: dict[int, list] = {}
        for f, o in zip(every.tolist(), owners):
            self.where.setdefault(f, []).append(o)

    def number(self, text: str | None) -> list[int]:
        get = self.vocabulary.get
        return [get(w, 0) for w in words(text)]

    def matches(self, doc: list[int]) -> dict[int, list[tuple[int, int, int]]]:
        """{item: maximal common runs as (length, start in doc, start in item)} of at least min_words words."""
        ids = np.array(doc, np.uint64)
        prints = rolling(ids, self.n)
        if not len(prints) or not len(self.sorted):
            return {}
        at = np.searchsorted(self.sorted, prints)
        at[at == len(self.sorted)] = 0
        hits = np.flatnonzero(self.sorted[at] == prints)
        done: dict[tuple[int, int], int] = {}
        out: dict[int, list] = {}
        for d in hits.tolist():
            for item, p in self.where[int(prints[d])]:
                own = self.items[item][1]
                if done.get((item, d - p), -1) > d or doc[d : d + self.n] != own[p : p + self.n]:
                    continue
                n = self.n
                while d + n < len(doc) and p + n < len(own) and doc[d + n] == own[p + n]:
                    n += 1
                done[item, d - p] = d + n - self.n + 1
                out.setdefault(item, []).append((n, d, p))
        return out


def tile(matches: list[tuple[int, int, int]], min_words: int) -> list[tuple[int, int, int]]:
    """Greedy tiling: again and again the longest match of unmarked words on both sides is marked.

    A match that reaches into marked words is put back with what is left of it, as long as that
    has min_words words. Ties go to the earlier place in the document, then in the item.
    """
    heap = [(-n, d, p) for n, d, p in matches]
    heapq.heapify(heap)
    seen_d: set[int] = set()
    seen_p: set[int] = set()
    out = []
    while heap:
        n, d, p = heapq.heappop(heap)
        free = [d + i not in seen_d and p + i not in seen_p for i in range(-n)]
        if all(free):
            out.append((-n, d, p))
            seen_d.update(range(d, d - n))
            seen_p.update(range(p, p - n))
            continue
        start = None
        for i, ok in enumerate([*free, False]):
            if ok and start is None:
                start = i
            elif not ok and start is not None:
                if i - start >= min_words:
                    heapq.heappush(heap, (start - i, d + start, p + start))
                start = None
    return out


def _blocks(items: DataFrame, key: str, text: str, most: int) -> Iterator[list]:
    block, size = [], 0
    for row in items.select(key, text).where(F.col(key).isNotNull() & F.col(text).isNotNull()).distinct().toLocalIterator():
        n = len(row[1]) // 2 + 1  # at least the words
        if block and size + n > most:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += n
    if block:
        yield block


def leaks(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", min_words: int = MIN_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_key, item_key, tiles, longest, covered, item_words, coverage): documents holding runs of an item.

    A row for each document and item with at least ``min_words`` consecutive words in common; the
    tiles do not overlap, so passages put in another order count in full. Items are a stated query
    set taken in blocks of at most ``block_words`` words, which bounds what is broadcast; every
    block is held against all documents, whole texts. Documents are never shuffled. Null and empty
    texts match nothing; several rows with one key are separate documents or items, so keys may repeat.
    """
    spark = docs.sparkSession
    kinds = dict(docs.dtypes)[doc_key], dict(items.dtypes)[item_key]
    schema = f"`{doc_key}` {kinds[0]}, `{item_key}` {kinds[1]}, tiles int, longest int, covered int, item_words int, coverage double"
    names = [doc_key, item_key, "tiles", "longest", "covered", "item_words", "coverage"]

    def search(block: list) -> DataFrame:
        shared = spark.sparkContext.broadcast(block)
        name = uuid.uuid4().hex

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            if name not in _SEEDS:  # once a worker; only those of one block are kept
                _SEEDS.clear()
                _SEEDS[name] = Seeds(shared.value, min_words)
            seeds = _SEEDS[name]
            for b in batches:
                out = []
                for key, t in zip(b[doc_key].tolist(), b[text].tolist()):
                    for item, found in seeds.matches(seeds.number(t)).items():
                        tiles = tile(found, min_words)
                        item_id, own = seeds.items[item]
                        covered = sum(n for n, _, _ in tiles)
                        out.append((key, item_id, len(tiles), max(n for n, _, _ in tiles), covered, len(own), covered / len(own)))
                yield pd.DataFrame(out, columns=names)

        return docs.select(doc_key, text).where(F.col(text).isNotNull()).mapInPandas(run, schema)

    found = None
    for block in _blocks(items, item_key, text, block_words):
        found = search(block) if found is None else found.unionByName(search(block))
    return found if found is not None else spark.createDataFrame([], schema)
