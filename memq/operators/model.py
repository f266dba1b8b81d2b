"""The one boundary to a model: prompts out, JSON back, nothing guessed in between."""

from __future__ import annotations

import json
import random
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from memq.operators import memory

_DECODER = json.JSONDecoder()


def first_json(text: str | None) -> tuple[object, str]:
    """(value, rest): the first complete JSON array or object in a reply and what follows it.

    A preamble and a code fence are passed over; a bracket that starts no complete value is skipped. Raises
    ValueError if there is none, as for a reply that was cut off.
    """
    for m in re.finditer(r"[\[{]", text or ""):
        try:
            value, end = _DECODER.raw_decode(text, m.start())
        except ValueError:
            continue
        return value, re.sub(r"^\s*```", "", text[end:]).strip()
    raise ValueError("no complete JSON value")


def with_retries(call: Callable[[str], object], attempts: int = 5, base: float = 1.0, longest: float = 30.0, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], object]:
    """A model that is asked again after a ConnectionError or TimeoutError, waiting longer each time; the last failure is raised."""

    def asked(prompt: str) -> object:
        for i in range(attempts):
            try:
                return call(prompt)
            except (ConnectionError, TimeoutError):
                if i + 1 == attempts:
                    raise
                sleep(min(longest, base * 2**i) * random.uniform(0.5, 1.0))
        raise ValueError("attempts must be positive")

    return asked


def parse_replies(replies: DataFrame, key: str, reply: str) -> DataFrame:
    """(key, value, rest, error): value as JSON text, or why there is none; a null reply has an error too."""
    kind = dict(replies.dtypes)[key]

    def one(text: str | None) -> tuple:
        try:
            value, rest = first_json(text)
            return json.dumps(value), rest, None
        except ValueError as e:
            return None, None, str(e)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(k, *one(t)) for k, t in zip(b[key], b[reply])], columns=[key, "value", "rest", "error"])

    return replies.select(key, reply).mapInPandas(run, f"`{key}` {kind}, value string, rest string, error string")


def extract(sessions: DataFrame, model: Callable[[str], str]) -> tuple[DataFrame, DataFrame]:
    """(claims with their drop reason, status per session) for sessions (sid, turns, prompt).

    A session whose reply cannot be read is unmeasured with the reason; one in which the model
    found nothing is measured with no claims. The two are never merged. The model is called once
    for each row: write the statuses out before using both frames.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for sid, turns, prompt in zip(b["sid"], b["turns"], b["prompt"]):
                try:
                    value, _ = first_json(model(prompt))
                    if not isinstance(value, list):
                        raise ValueError("expected a JSON array")
                    rows.append((sid, int(turns), json.dumps(value), "measured", None))
                except Exception as e:  # the model's failure is data here
                    rows.append((sid, int(turns), None, "unmeasured", str(e)))
            yield pd.DataFrame(rows, columns=["sid", "turns", "claims", "status", "reason"])

    from memq.session import materialize

    read = materialize(sessions.select("sid", "turns", "prompt").mapInPandas(run, "sid string, turns int, claims string, status string, reason string"))
    return memory.claims_from_json(read.where("status = 'measured'")), read.select("sid", "status", "reason")
