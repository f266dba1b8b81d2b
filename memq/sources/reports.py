"""Sinks that people read: Markdown, a single HTML page, JSON summaries, JSON logs.

Every report is made from frames that are already aggregated; the inspector takes the record
frame of its caller, who decides how many records a page can hold.
"""

from __future__ import annotations

import html
import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_log(df: DataFrame, path: str) -> None:
    """Append rows as JSON lines; each write adds files, so a log can be resumed after any of them."""
    df.write.mode("append").json(path)


def summary(df: DataFrame) -> dict:
    """The single row of a summary frame."""
    rows = df.take(2)
    if len(rows) != 1:
        raise ValueError("a summary has exactly one row")
    return rows[0].asDict(recursive=True)


def markdown_table(df: DataFrame, most: int = 1_000) -> str:
    """A frame of at most ``most`` rows as a Markdown table; a larger one is an error."""
    rows = df.take(most + 1)
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [df.columns, ["---"] * len(df.columns), *[[cell(v) for v in r] for r in rows]]
    return "\n".join("| " + " | ".join(r) + " |" for r in lines)


def results(headline: DataFrame, regimes: DataFrame, abstention: DataFrame) -> str:
    """The results page of a run."""
    h, a = summary(headline), summary(abstention)
    parts = [
        "# Results", "",
        f"Accuracy {h['accuracy']} ({h['correct']}/{h['graded']}), precision when it answers {h['precision']} ({h['correct']}/{h['answered']}).",
        f"Abstention refused {a['refused']} of {a['n']}, hallucinated {a['hallucinated']}.", "",
        "## Where the wrong answers go", "",
        f"- {h['answered_wrong']} answered and wrong", f"- {h['false_refusals']} refused with gold in the evidence", f"- {h['retrieval_misses']} refused, gold never retrieved", "",
        "## By category", "", markdown_table(regimes.orderBy("question_type")),
    ]
    if h.get("headroom") is not None:
        parts += ["", f"Headroom, an estimate and not a result: {h['headroom']}."]
    return "\n".join(parts) + "\n"


def capability_page(checks: DataFrame, latest: DataFrame, overturned: DataFrame, most: int = 10_000) -> str:
    """What probes found: counts, verdicts that a later probe reversed, what works, what does not, and what was never reached.

    Frames as sources.logs makes them; of each name the newest verdict that was reached counts, and
    a name that no probe reached is unknown, not unsupported. More than ``most`` names are an error.
    """
    rows = {r.name: r for r in latest.take(most + 1)}
    if len(rows) > most:
        raise ValueError(f"more than {most} names")
    counts = {r.verdict: r.n for r in checks.groupBy("verdict").agg(F.count("*").alias("n")).collect()}
    probes = checks.select("probe").distinct().count()
    texts = checks.join(latest.select("name", "probe", "verdict"), ["name", "probe", "verdict"]).groupBy("name").agg(F.max("query").alias("query"), F.max("detail").alias("detail"))
    said = {r.name: r for r in texts.collect()}
    skipped = sorted(r.name for r in checks.where("verdict = 'SKIPPED'").join(latest.select("name"), "name", "left_anti").select("name").distinct().take(most))
    short = lambda t, n: " ".join((t or "").split())[:n]
    lines = ["# Capabilities", "", f"{sum(counts.values())} checks in {probes} probes: {counts.get('WORKS', 0)} worked, {counts.get('FAILS', 0)} did not, {counts.get('SKIPPED', 0)} were not reached.", ""]
    lines += ["## Reversed by a later probe", "", markdown_table(overturned.orderBy("name")), ""]
    for verdict, title, text, width in (("WORKS", "Works", "query", 110), ("FAILS", "Does not work", "detail", 130)):
        lines += [f"## {title}", ""]
        for name in sorted(n for n, r in rows.items() if r.verdict == verdict):
            more = short(said[name][text], width) if name in said else ""
            lines.append(f"- **{name}** ({rows[name].probe})" + (f": `{more}`" if more else ""))
        lines.append("")
    return "\n".join([*lines, "## Not reached", "", ", ".join(f"`{n}`" for n in skipped) or "none", ""])


def inspector(records: DataFrame, title: str = "Inspector", most: int = 100_000) -> str:
    """One HTML page over at most ``most`` records, with filters by kind and category; a larger frame is an error."""
    rows = records.take(most + 1)
    if len(rows) > most:
        raise ValueError(f"more than {most} records")
    data = json.dumps([r.asDict(recursive=True) for r in rows], default=str, ensure_ascii=False).replace("</", "<\\/")
    return f"""<!doctype html><meta charset="utf-8"><title>{html.escape(title)}</title>
<h1>{html.escape(title)}</h1><select id="kind"></select> <select id="type"></select><table id="rows"></table>
<script>const data = {data};
const pick = (id, key) => {{ const s = document.getElementById(id); s.innerHTML = "<option></option>";
  [...new Set(data.map(r => r[key]))].sort().forEach(v => s.add(new Option(v, v))); s.onchange = draw; return s; }};
const kind = pick("kind", "kind"), type = pick("type", "question_type");
function draw() {{ const t = document.getElementById("rows"); t.textContent = "";
  data.filter(r => (!kind.value || r.kind === kind.value) && (!type.value || r.question_type === type.value))
    .forEach(r => {{ const tr = t.insertRow(); Object.values(r).forEach(v => tr.insertCell().textContent = v); }}); }}
draw();</script>
"""


def write_text(text: str, path: str) -> None:
    Path(path).write_text(text, encoding="utf-8")
