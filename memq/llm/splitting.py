"""Splitting oversized texts at natural boundaries, with overlap."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 12_000, 200

#: The separator hierarchy, from the coarsest; a cut lies at the end of a match.
LEVELS = (
    ("section", re.compile(r"\n[ \t]*\n(?=[ \t]*(?:#{1,6}\s|={3,}|-{3,}|\*{3,}))|\n(?=#{1,6}\s)|\n[ \t]*\n[ \t]*\n\s*")),
    ("paragraph", re.compile(r"(?:\r?\n[ \t]*){2,}")),
    ("line", re.compile(r"[\r\n\x0b\x0c\x85  ]+")),
    ("sentence", re.compile(r"[.!?;][\"'”’»)\]]*\s+|[。！？]+[”’」』]*\s*")),
    ("word", re.compile(r"\s+")),
    ("mark", re.compile(r"[.!?;。！？]+")),
)
_MARKS = ".!?;。！？"


def _atoms(text: str, start: int, end: int, level: int, limit: int, most: int, out: list) -> None:
    """Append (end, level name, hard) of atoms of at most ``most`` characters that cover text[start:end]."""
    if end - start <= most:
        out.append((end, None, False))
        return
    if level == len(LEVELS):
        run = end
        while run > start and (text[run - 1] in _MARKS or text[run - 1].isspace()):
            run -= 1
        hard = run - start > limit
        while end - start > most:
            cut = start + most
            for _ in range(16):  # not inside a character with its marks and joiners
                if start + most // 2 < cut < end and (unicodedata.combining(text[cut]) or text[cut] in "‍️" or text[cut - 1] == "‍"):
                    cut -= 1
            out.append((cut, "character", hard))
            start = cut
        out.append((end, "character", hard))
        return
    name, pattern = LEVELS[level]
    at = start
    for m in pattern.finditer(text, start, end):
        if at < m.end() < end:
            _atoms(text, at, m.end(), level + 1, limit, most, out)
            out[-1] = (out[-1][0], name, out[-1][2])
            at = m.end()
    _atoms(text, at, end, level + 1, limit, most, out)


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, str, bool]]:
    """(start, end, level of the cut at end, hard) of each piece; one whole piece for a text within the limit.

    Greedy: each piece takes as many atoms as fit beside the overlap. ``hard`` marks pieces of a run
    longer than the limit without any separator. Pieces cover the text; each next one begins
    ``overlap`` characters before the end of the one before. An empty text gives one empty piece.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be less than limit")
    if len(text) <= limit:
        return [(0, len(text), "end", False)]
    atoms: list = []
    _atoms(text, 0, len(text), 0, limit, limit - overlap, atoms)
    pieces, start, cut, hard = [], 0, 0, False
    last = "end"
    for end, level, h in atoms:
        if end - start > limit:
            pieces.append((start, cut, last, hard))
            start, hard = cut - overlap, False
        cut, last, hard = end, level or "word", hard or h
    pieces.append((start, cut, "end", hard))
    return pieces


def split_oversized(rows: DataFrame, keys: list[str], text: str, limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True) -> DataFrame:
    """(keys, piece_no, start_at, end_at, cut, hard_cut[, piece]) for each distinct row longer than the limit.

    Lengths are code points. Repeated rows count once; rows within the limit, null and empty texts
    have no pieces here. Only oversized texts leave the JVM; other columns are not read.
    """
    big = rows.select(*keys, F.col(text).alias("__text")).where(F.length("__text") > limit).dropDuplicates()
    kinds = dict(big.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", piece_no int, start_at int, end_at int, cut string, hard_cut int"
    schema += ", piece string" if with_text else ""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [*keys, "piece_no", "start_at", "end_at", "cut", "hard_cut", *(["piece"] if with_text else [])]
        for b in batches:
            out = []
            for row in b.itertuples(index=False, name=None):
                *k, t = row
                for i, (s, e, cut, hard) in enumerate(split_text(t, limit, overlap)):
                    out.append((*k, i, s, e, cut, int(hard), *([t[s:e]] if with_text else [])))
            yield pd.DataFrame(out, columns=names)

    return big.mapInPandas(run, schema)


def hard_cuts(rows: DataFrame, keys: list[str], text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(keys, hard_cut): for each distinct oversized row, whether any piece had to be cut inside a separatorless run."""
    return split_oversized(rows, keys, text, limit, overlap, with_text=False).groupBy(*keys).agg(F.max("hard_cut").cast("int").alias("hard_cut"))
