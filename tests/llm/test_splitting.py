import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from memq.llm import splitting

ALPHABET = "ab .!?;。\n\t #é👍‍️-"


def check(text, limit, overlap):
    pieces = splitting.split_text(text, limit, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for a, b in zip(pieces, pieces[1:]):
        assert b[0] == a[1] - overlap and b[1] > a[1]
    assert all(e - s <= limit for s, e, _, _ in pieces)
    assert "".join([text[: pieces[0][1]], *(text[a[1] : b[1]] for a, b in zip(pieces, pieces[1:]))]) == text
    return pieces


@settings(max_examples=300, deadline=None)
@given(st.text(ALPHABET, max_size=400), st.integers(12, 60), st.integers(0, 10))
def test_pieces_cover_the_text(text, limit, overlap):
    pieces = check(text, limit, overlap)
    longest, run = 0, 0
    for c in text:
        run = 0 if c.isspace() or c in splitting._MARKS else run + 1
        longest = max(longest, run)
    assert any(h for *_, h in pieces) == (longest > limit)


def test_cuts_at_the_coarsest_place():
    para = "One two three. " * 20
    text = "\n\n".join([para] * 10)
    assert {c for _, _, c, _ in check(text, 700, 20)} == {"paragraph", "end"}
    assert {c for _, _, c, _ in check(para * 5, 100, 10)} == {"sentence", "end"}
    assert {c for _, _, c, _ in check("word " * 100, 60, 10)} == {"word", "end"}
    assert {c for _, _, c, _ in check("a.b" * 100, 60, 10)} == {"mark", "end"}
    assert {c for _, _, c, _ in check("x" * 200, 60, 10)} == {"character", "end"}
    assert {c for _, _, c, _ in check("一二三。" * 100, 60, 10)} == {"sentence", "end"}
    assert "section" in {c for _, _, c, _ in check("\n# A\n" + "x y " * 10 + "\n# B\n" + "x y " * 10, 60, 5)}


def test_limits():
    assert splitting.split_text("", 10, 2) == [(0, 0, "end", False)]
    assert splitting.split_text("x" * 10, 10, 2) == [(0, 10, "end", False)]
    assert any(h for *_, h in splitting.split_text("x" * 11, 10, 2))
    assert not any(h for *_, h in splitting.split_text("x" * 10 + ".", 10, 2))
    with pytest.raises(ValueError):
        splitting.split_text("x", 10, 10)


def test_a_very_long_text_without_blanks():
    assert len(check("x" * 3_000_000, 12_000, 200)) > 250


def test_frame(spark):
    long = "word " * 5_000
    rows = [("s", 0, long, "x"), ("s", 0, long, "y"), ("s", 1, "short", "x"), (None, 2, "z" * 13_000, "x"), ("s", 3, None, "x"), ("s", 4, "", "x"), ("t", 0, "👍" * 12_000, "x")]
    df = spark.createDataFrame(rows, "session_id string, idx int, content string, cut string")
    out = splitting.split_oversized(df, ["session_id", "idx"], "content")
    pieces = out.where("session_id = 's'").orderBy("piece_no").collect()
    assert pieces[0].piece + "".join(p.piece[200:] for p in pieces[1:]) == long
    assert sorted(map(tuple, splitting.hard_cuts(df, ["session_id", "idx"], "content").collect()), key=str) == [("s", 0, 0), (None, 2, 1)]
    assert splitting.hard_cuts(df.limit(0), ["session_id", "idx"], "content").count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_no_forced_cut_where_a_blank_is_in_reach(seed):
    rng = random.Random(seed)
    text = " ".join("x" * rng.randrange(1, 30) for _ in range(2_000))
    assert all(c in ("word", "end") for _, _, c, _ in check(text, 200, 20))
