"""Broken prompt and response pairs: empty, copied, refused, foreign and truncated answers."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memq.llm import lexicon

#: Words of a shingle, and the similarity from which texts count as the same.
SHINGLE, SAME = 5, 0.8
WORD = re.compile(r"[^\W_]+")

#: Words between two neighbours of a template, score from which a language is told, share of it below which another one is foreign.
GAP, TOLD, FOREIGN = 5, 1.5, 0.5

_PHRASE = {lang: set(t.split("|")[0].split()) for lang, t in lexicon.FUNCTION_WORDS.items()}
_CLAUSE = {lang: set(t.split("|")[1].split()) for lang, t in lexicon.FUNCTION_WORDS.items()}
#: Words of phrases after which something must follow: all but those that may end one.
_LINKS = {lang: p - set("no all both each some any more most other later ago now again her before after since through over about in on by".split()) for lang, p in _PHRASE.items()}
_ANY_PHRASE = set().union(*_PHRASE.values())


def _owners(lists: dict[str, set[str]]) -> dict[str, list[tuple[str, float]]]:
    """Of each item its languages with the weight of one of them: an item of several counts in part."""
    by: dict[str, list[str]] = {}
    for lang, items in lists.items():
        for x in items:
            by.setdefault(x, []).append(lang)
    return {x: [(lang, 1 / len(langs)) for lang in langs] for x, langs in by.items()}


_WORDS = _owners({lang: _PHRASE[lang] | _CLAUSE[lang] for lang in _PHRASE})
_MARKS = _owners({lang: set(t.split()) for lang, t in lexicon.MARKS.items()})
_MARK = re.compile("(?=(" + "|".join(sorted(map(re.escape, _MARKS), key=len, reverse=True)) + "))")
_SCRIPTS = {name: re.compile(f"[{r}]") for name, r in lexicon.SCRIPTS.items()}
_UNSPACED = {"han", "kana", "hangul", "thai"}
_TEMPLATES = [(t[0] == "!", tuple(x for x in t.split() if x != "!")) for t in lexicon.TEMPLATES.strip().splitlines()]
#: Every template has one of these.
_TURNS = frozenset(("NOT", "DECLINE", "LACK", "UNAVAIL"))
_EXACT: dict[str, dict[str, set[str]]] = {}
_STEMS: dict[str, list[tuple[str, str]]] = {}
for _lang, _classes in lexicon.CLASSES.items():
    _EXACT[_lang], _STEMS[_lang] = {}, []
    for _name, _list in _classes.items():
        for _w in _list.split():
            if _w.endswith("*"):
                _STEMS[_lang].append((_w[:-1], _name))
            else:
                _EXACT[_lang].setdefault(_w, set()).add(_name)

_END = re.compile(r"[.!?…。！？][\"'”’»)\]*_]*\s*$")
_OPEN_ITEM = re.compile(r"(?:^|\n)[ \t]*(?:\d+[.)]|[-*•])[ \t]*$")
_ITEM = re.compile(r"^[ \t]*(?:\d+[.)]|[-*•])[ \t]+\S")
_OPEN_END = re.compile(r"[,;:(\[–—/&+]\s*$")
_SENTENCE = re.compile(r"(?<=[.!?;…。！？])\s+|\n+")
_PIECE = re.compile(r"[,;:\n–—]|(?<=[.!?…])\s|\b(?:but|however|aber|doch|mais|pero)\b", re.I)
_INTRO = re.compile(r"^\W*(?:\w+\W+){1,4}?[:\"“«„]\s*")


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by one bit vector over b."""
    places: dict[str, int] = {}
    for i, w in enumerate(b):
        places[w] = places.get(w, 0) | 1 << i
    row = full = (1 << len(b)) - 1
    for w in a:
        at = row & places.get(w, 0)
        row = (row + at | row - at) & full
    return len(b) - row.bit_count()


def script(text: str, known: set[str] = frozenset()) -> tuple[str, int]:
    """The script of most letters of a text, apart from known words, and how many letters of it there are."""
    if text.isascii():
        return "latin", len(text)
    letters = "".join(w for w in WORD.findall(text) if w.lower() not in known)
    found = {name: len(p.findall(letters)) for name, p in _SCRIPTS.items()}
    if found["kana"]:
        found["kana"] += found.pop("han")
    best = max(found, key=found.get)
    return (best, found[best]) if found[best] > 0.5 * sum(c.isalpha() for c in letters) else ("latin", len(letters))


@functools.lru_cache(100_000)
def _weights(w: str) -> tuple[tuple[str, float], ...]:
    """What a word speaks for: its languages as a function word, else those of its typical letters at a third."""
    if w in _WORDS:
        return tuple(_WORDS[w])
    return tuple((lang, weight / 3) for m in set(_MARK.findall(w + "_")) for lang, weight in _MARKS[m])


@functools.lru_cache(100_000)
def _strange(w: str, own: str) -> bool:
    """Whether a word has letters or endings of other languages that ``own`` does not have."""
    return any(own not in dict(_MARKS[m]) for m in _MARK.findall(w + "_"))


def languages(tokens: list[str]) -> dict[str, float]:
    """How much speaks for each language: function words, and typical letters and endings at a third of their weight."""
    score = dict.fromkeys(_PHRASE, 0.0)
    for w in tokens:
        for lang, weight in _weights(w):
            score[lang] += weight
    return score


def foreign(tokens: list[str], own: str, other: str) -> tuple[float, float]:
    """(against, for) a language: words that others have and it has not, with letters of others at half; and its own words.

    A word that several other languages share speaks against the asked one all the same, so kin do
    not weaken each other; a word of both ``own`` and ``other`` hardly speaks for either.
    """
    against = same = 0.0
    for w in tokens:
        if w in _PHRASE[own] or w in _CLAUSE[own]:
            same += 0.25 if w in _PHRASE[other] or w in _CLAUSE[other] else 1
        elif w in _WORDS:
            against += 1
        elif _strange(w, own):
            against += 0.5
    return against, same


def is_copy(question: list[str], answer: list[str], asks: bool = False) -> bool:
    """The answer is the question again, once or repeatedly, at most slightly changed, and nothing else.

    Either SAME of the answer's words lie in shingles of the question and the rest of it holds no
    digit, or the longest common subsequence has SAME of both. Where the answer is itself a question, words
    that only link others count for nothing in the comparison.
    """
    if not question or not answer or len(answer) < (SAME - 0.2 * asks) * len(question):
        return False
    known, said = set(question), set(answer)
    if sum(w in said for w in question) < 0.5 * len(question):
        return False  # neither shingles nor a subsequence can reach what is asked below
    size = min(SHINGLE, len(question))
    own = {tuple(question[i : i + size]) for i in range(len(question) - size + 1)}
    covered = [False] * len(answer)
    for i in range(len(answer) - size + 1):
        if tuple(answer[i : i + size]) in own:
            covered[i : i + size] = [True] * size
    new = [w for w, c in zip(answer, covered) if not c and w not in known]
    if any(ch.isdigit() for w in new for ch in w) or len(new) > max(2 if asks else 1, len(question) * (1 - SAME)):
        return False
    if sum(covered) >= SAME * len(answer) and sum(covered) >= SAME * len(question):
        return True
    if lcs(question, answer) >= SAME * max(len(question), len(answer)):
        return True
    if not asks:
        return False
    q, a = ([w for w in x if w not in _WORDS] for x in (question, answer))
    return len(q) > 1 and lcs(q, a) >= len(q) - (len(q) > 3) and lcs(question, answer) >= 0.6 * len(question)


@functools.lru_cache(100_000)
def _classes(lang: str, w: str) -> frozenset[str]:
    return frozenset(_EXACT[lang].get(w, set()) | {name for stem, name in _STEMS[lang] if w.startswith(stem)})


@functools.lru_cache(100_000)
def _turns(w: str) -> frozenset[str]:
    """The languages in which a word can turn a sentence into a refusal."""
    return frozenset(lang for lang in lexicon.CLASSES if _classes(lang, w) & _TURNS)


def align(template: tuple[str, ...], slots: list[set[str]]) -> int | None:
    """Where a template's classes end in a sentence if they occur in order, at most GAP words between neighbours; else None."""
    ends = [i for i, s in enumerate(slots) if template[0] in s]
    for name in template[1:]:
        ends = [i for i, s in enumerate(slots) if name in s and any(0 < i - e <= GAP + 1 for e in ends)]
    return ends[0] if ends else None


def gives_value(piece: str, question: set[str], lang: str, leads: bool) -> bool:
    """Whether a part of a refusal beside its template states something: a number, a name, or several words of its own."""
    raw = WORD.findall(piece)
    tokens = [w.lower() for w in raw]
    if any(ch.isdigit() for w in tokens if w not in question for ch in w):
        return True
    kinds = [_classes(lang, w) for w in tokens]
    own = [r for r, w, k in zip(raw, tokens, kinds) if not k and w not in question and w not in _PHRASE[lang] and w not in _CLAUSE[lang]]
    if any("COURTESY" in k for k in kinds) or piece.rstrip().endswith("?"):
        return False
    if lang != "de" and any(r[0].isupper() and not (leads and r == raw[0]) for r in own):
        return True
    if any("SELF" in k for k in kinds[:2]) or any("NOT" in k for k in kinds):
        return len(own) > 3
    return len(own) >= 2


def is_refusal(question: list[str], rest: str) -> bool:
    """A template of a refusal can be aligned with a sentence of the answer, and nothing beside it gives a value."""
    known = set(question)
    sentences = [words(s) for s in _SENTENCE.split(rest)]
    turned = set().union(*(_turns(w) for tokens in sentences for w in tokens))
    for lang in turned:
        for tokens in sentences:
            slots = [_classes(lang, w) for w in tokens]
            if len(tokens) < 2 or not any(s & _TURNS for s in slots):
                continue
            for i, s in enumerate(slots):
                if "ME" in s and i and tokens[i - 1] in ("for", "to"):
                    slots[i] = s | {"SELF"}
            if any(align(t, slots) is not None for short, t in _TEMPLATES if not short or len(tokens) <= 5):
                pieces = [p for p in _PIECE.split(rest) if p and WORD.search(p)]
                values = []
                for p in pieces:
                    own = [_classes(lang, w) for w in words(p)]
                    if not any(align(t, own) is not None for _, t in _TEMPLATES):
                        values.append(gives_value(p, known, lang, rest.lstrip().startswith(p.strip())))
                if not any(values):
                    return True
                break
    return False


def is_bare(raw: list[str], starts: set[int], lang: str, ended: bool) -> bool:
    """A value such as a name, a number, an address or a list of these, which has no language and needs no end.

    So are words that are capitalised or link others, and phrases without any word that only sentences have.
    """
    low = [w for w in raw if w[0].islower() and w not in _PHRASE[lang] and w not in _ANY_PHRASE]
    if not low:
        return True
    if any((w[0].islower() or i in starts) and w.lower() in _CLAUSE[lang] for i, w in enumerate(raw)):
        return False
    return not ended or len(low) < 2


def _spoken(raw: list[str], starts: set[int], known: set[str]) -> list[str]:
    """The words by which a language is judged: without the question's, numbers, and names inside sentences."""
    low = [w if w[0].islower() else w.lower() if i in starts or not w[0].isupper() else "0" for i, w in enumerate(raw)]
    return [w for w in low if w not in known and not w[0].isdigit()]


def defect(question: str | None, answer: str | None) -> str | None:
    """The kind of defect, or None for a sound answer. A pair has at most one; the first that holds is given.

    empty, copied, refusal, other_language, truncated. A null question is taken as one without
    words: the answer can then be neither a copy nor in another language.
    """
    answer, question = (t if not t or t.isascii() else unicodedata.normalize("NFC", t) for t in (answer, question))
    a, q = words(answer), words(question)
    if not a:
        return "empty"
    asks = answer.rstrip(" \t\r\n\"'”»").endswith("?")
    intro = _INTRO.match(answer)
    if is_copy(q, a, asks) or intro and is_copy(q, words(answer[intro.end() :]), asks):
        return "copied"
    found = list(WORD.finditer(answer))
    echoed = len(q) if q and a[: len(q)] == q and len(found) == len(a) else 0  # what follows a question that is given back first
    rest = answer[found[echoed - 1].end() :] if echoed else answer
    if is_refusal(q, rest):
        return "refusal"
    raw = [m.group() for m in found[echoed:]]
    heads = {0} | {i for i in range(1, len(found)) if re.search(r"[.!?…:\n\"“«„]", answer[found[i - 1].end() : found[i].start()])}
    starts = {i - echoed for i in heads if i >= echoed}
    tail = answer.rstrip()
    ended = bool(_END.search(tail))
    known = set(q)
    own = best = None
    if q:
        asked, (written, n) = languages(_spoken(WORD.findall(question), {0}, set())), script(rest, known)
        asked["es"] += 2 * ("¿" in question)
        own = max(asked, key=asked.get)
        if written != "latin" and script(question)[0] != written:
            if n >= 6 if written in _UNSPACED else len(raw) >= 4 or ended and len(raw) >= 3:
                return "other_language"
        elif written == "latin":
            said = languages(_spoken(raw, starts, known))
            best = max(said, key=said.get)
            other, same = foreign(_spoken(raw, starts, known), own, best)
            if asked[own] > 0 and best != own and other >= TOLD and same < FOREIGN * other and not is_bare(raw, starts, best, ended):
                return "other_language"
    if len(raw) > 1 and (_OPEN_ITEM.search(tail) or _OPEN_END.search(tail)):
        return "truncated"
    if ended:
        return None
    lines = [x for x in tail.splitlines() if x.strip()]
    if len(lines) > 1 and _ITEM.match(lines[-1]):
        return None  # a list whose last item is there
    if own is None:
        said = languages([w.lower() for w in raw])
        own = max(said, key=said.get)
    if len(raw) > 1 and raw[-1].islower() and raw[-1] in _PHRASE[own] and raw[-1] in _LINKS[own] or tail.count("(") > tail.count(")"):
        return "truncated"
    return None if len(raw) == 1 or is_bare(raw, starts, own, False) else "truncated"


def answered(status: Column | str) -> Column:
    """Whether the status is ``answered``, apart from case and outer blanks."""
    s = F.col(status) if isinstance(status, str) else status
    return F.coalesce(F.lower(F.regexp_replace(s, r"(?U)^\s+|\s+$", "")) == "answered", F.lit(False))


def defective(answers: DataFrame, key: str = "line_no", question: str = "question", answer: str = "answer", status: str = "status") -> DataFrame:
    """(key, defect): rows with status ``answered`` whose answer is defective.

    Only answered rows leave the JVM, with question and answer; nothing is shuffled. Repeated
    rows are judged one by one; whether an answer is right does not matter.
    """
    kind = dict(answers.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [defect(q, a) for q, a in zip(b["q"], b["a"])]
            yield pd.DataFrame({key: b[key], "defect": found}).dropna(subset=["defect"])

    rows = answers.where(answered(status)).select(key, F.col(question).alias("q"), F.col(answer).alias("a"))
    return rows.mapInPandas(run, f"`{key}` {kind}, defect string")
