import pytest
from pyspark.sql import functions as F

from memq.operators import answering, evaluate


def frames(spark, hits, claims, asked):
    return (
        spark.createDataFrame(hits, "q int, key string, score double"),
        spark.createDataFrame(claims, "key string, sid string, turn int, ts bigint"),
        spark.createDataFrame(asked, "q int, asked_at bigint"),
    )


@pytest.mark.parametrize(("tolerance", "late", "outcome"), [(86_400, 3_600, "tolerated"), (86_400, 90_000, "future"), (0, 60, "future"), (86_400, 0, "kept"), (86_400, -5, "kept")])
def test_tolerance(spark, tolerance, late, outcome):
    h, c, a = frames(spark, [(1, "k", 1.0), (1, "gone", 1.0), (1, "null", 0.5)], [("k", "s", 0, 1000 + late), ("null", "s", 1, None)], [(1, 1000)])
    out = {r.key: r.outcome for r in answering.as_of(h, c, a, tolerance).collect()}
    assert out == {"k": outcome, "gone": "missing", "null": "kept"}


def test_relevance_picks_and_recency_orders(spark):
    hits = [(1, "old", 99.0), *[(1, f"n{i}", 1.0) for i in range(10)]]
    claims = [("old", "s", 0, 5), *[(f"n{i}", "s", i, 100 + i) for i in range(10)]]
    judged = answering.as_of(*frames(spark, hits, claims, [(1, 1000), (2, 1000)]))
    assert [r.key for r in answering.gather(judged, 2).orderBy("n").collect()] == ["n9", "old"]
    report = {r.q: (r.hits, r.kept) for r in answering.gather_report(spark.createDataFrame([(1,), (2,)], "q int"), judged).collect()}
    assert report == {1: (11, 11), 2: (0, 0)}


def test_outcomes_with_and_without_a_model(spark):
    r = spark.createDataFrame([(1, 3, 0), (2, 0, 0), (3, 3, 2)], "q int, hits bigint, kept bigint")
    assert {x.q: (x.status, x.reason) for x in answering.free_outcome(r).collect()} == {
        1: ("absent", answering.NOTHING_AS_OF), 2: ("absent", answering.NO_MATCH), 3: ("unmeasured", answering.NO_MODEL),
    }
    prompts = spark.createDataFrame([("a", 1, "good"), ("b", 1, "fails"), ("c", 1, "list"), ("d", 1, "none"), ("e", 0, None), ("f", 2, None)], "q string, hits int, prompt string")

    def model(p):
        if p == "fails":
            raise RuntimeError("timeout")
        return {"good": {"answer": " Berlin ", "used": [2]}, "list": [1], "none": {"answer": "not in memory"}}[p]

    out = {x.q: x for x in answering.answer(prompts, model).collect()}
    assert {k: v.status for k, v in out.items()} == {"a": "answered", "b": "unmeasured", "c": "unmeasured", "d": "absent", "e": "absent", "f": "absent"}
    assert (out["a"].answer, out["a"].used) == ("Berlin", [2])
    assert (out["e"].reason, out["f"].reason) == (answering.NO_MATCH, answering.NOTHING_AS_OF)
    assert {x.status for x in answering.answer(prompts.where("prompt is not null"), None).collect()} == {"unmeasured"}


def test_rendered_evidence(spark):
    item = "struct<subj:string,pred:string,obj:string,kind:string,ts:bigint,text:string,replaced:array<struct<obj:string,ts:bigint>>>"
    df = spark.createDataFrame([([("user", "lives_in", "Rome", "fact", 1681138020, "x" * 701, [("Oslo", None)]), ("user", "owns", "car", None, None, None, None)],)], f"items array<{item}>")
    text = df.select(answering.render_evidence(F.col("items"))).first()[0].split("\n")
    assert text == [
        "[1] user lives_in Rome  (kind=fact, said 2023-04-10 (Mon))", "    said: " + "x" * 700 + "...", "    replaced an earlier value: Oslo (said unknown)",
        "[2] user owns car  (kind=None, said unknown)",
    ]


def test_cited_is_null_when_nothing_was(spark):
    df = spark.createDataFrame([(1, [1]), (2, [1]), (1, []), (1, None)], "n int, used array<int>")
    assert [r[0] for r in df.select(answering.cited(F.col("n"), F.col("used"))).collect()] == [True, False, None, None]


EVIDENCE = "array<struct<n:int,used:boolean,session:string,turn:int,said_at:bigint,triple:array<string>>>"
ANSWERS = f"line_no bigint, question_id string, question_type string, is_abstention boolean, status string, answer string, gold string, gold_sessions array<string>, reason string, evidence {EVIDENCE}, retrieval struct<gate:string,hits:int,dropped_future:int,candidates:int,mode:string,kept:int>"


def row(i, status, gold, cited, abst=False, answer="a", gold_text="a", kind="t"):
    return (i, f"q{i}", kind, abst, status, answer, gold_text, gold, None, None if cited is None else [(n, None, s, 0, 0, None) for n, s in enumerate(cited)], None)


def runs(spark, *rows):
    return evaluate.runs(spark.createDataFrame(list(rows), ANSWERS))


def test_recall_and_density(spark):
    r = runs(spark, row(1, "answered", ["s1"], ["s1", "s1", "s9"]), row(2, "answered", ["s1"], ["s7"]), row(3, "absent", [], [], abst=True), row(4, "answered", None, [None], kind=None))
    s = evaluate.score(r).first()
    assert (s.n, s.recall, s.density, s.no_evidence) == (3, 0.3333, 0.4, 0)
    assert evaluate.score(r, "question_type").where("question_type = 'unknown'").first().n == 1
    assert evaluate.recall_by_type(r).select("n", "hits").collect() == [(2, 1)]
    assert evaluate.drops(r).first().rate == 1.0


def test_judging(spark):
    rows = [
        row(1, "absent", ["s"], ["x"]), row(2, "absent", ["s"], ["s"]), row(3, "absent", [], []), row(4, " Answered", ["s"], ["s"]), row(5, "answered", ["s"], None, answer="b"),
        row(6, "answered", ["s"], [], gold_text=" "), row(7, "unmeasured", ["s"], []), row(8, "absent", [], [], abst=True), row(9, "answered", [], [], abst=True), row(10, "unmeasured", [], [], abst=True),
        row(11, "answered", ["s"], [], answer=None),
    ]
    judged = evaluate.judge(runs(spark, *rows), evaluate.says_gold())
    assert {int(r.question_id[1:]): (r.verdict, r.kind) for r in judged.collect()} == {
        1: ("incorrect", "retrieval_miss"), 2: ("incorrect", "false_refusal"), 3: ("incorrect", "false_refusal"), 4: ("correct", "correct"), 5: ("incorrect", "incorrect"),
        6: ("unjudged", "unmeasured"), 7: ("unjudged", "unmeasured"), 8: ("correct", "refused"), 9: ("incorrect", "hallucinated"), 10: ("unjudged", "unmeasured"), 11: ("unjudged", "unmeasured"),
    }
    t = evaluate.tally(judged).first()
    assert (t.n, t.correct, t.incorrect, t.unjudged, t.accuracy, t.false_refusal_rate) == (8, 1, 4, 3, 0.2, 0.5)
    h = evaluate.headline(judged).first()
    assert (h.answered, h.answered_wrong, h.precision, h.headroom) == (2, 1, 0.5, 0.4)
    a = evaluate.abstention(judged).first()
    assert (a.n, a.refused, a.hallucinated, a.unjudged, a.refusal_rate) == (3, 1, 1, 1, 0.5)
    assert [tuple(r) for r in evaluate.diagnose_refusals(judged).collect()] == [("t", 3, 1, 2)]


def test_all_unjudged_has_no_accuracy(spark):
    t = evaluate.tally(evaluate.judge(runs(spark, row(1, "answered", ["s"], ["s"])))).first()
    assert (t.unjudged, t.accuracy, t.false_refusal_rate) == (1, None, None)


def test_miss_verdicts(spark):
    misses = spark.createDataFrame([("a", ["s"], 12, 0), ("b", ["s"], 12, 3), ("c", ["none"], 12, 0), ("d", ["s"], 12, 8), ("e", ["s"], 12, 0)], "q string, gold_sessions array<string>, candidates int, dropped_future int")
    claims = spark.createDataFrame([("k", "s"), ("x", "other")], "key string, sid string")
    hits = spark.createDataFrame([("a", "k", 31), ("b", "k", 3), ("d", "k", 31), ("e", "x", 1)], "q string, key string, rank int")
    assert {r.q: r.verdict for r in evaluate.diagnose_misses(misses, claims, hits).collect()} == {"a": "RANKING", "b": "FILTER", "c": "EXTRACTION", "d": "RANKING", "e": "EXTRACTION"}


def test_date_audit(spark):
    slots = spark.createDataFrame([("q", "g", 1900), ("q", "o", 1000 + 5 * 3600), ("n", "x", 5), ("r", "g2", 500)], "question_id string, sid string, ts bigint")
    inst = spark.createDataFrame([("q", 1000, ["g"]), ("n", 1000, []), ("r", 1000, ["g2"])], "question_id string, asked_at bigint, answer_session_ids array<string>")
    offs = evaluate.offsets(slots, inst)
    table = {r.label: (r.fitting, r.pct, r.others_admitted) for r in evaluate.date_audit(offs).collect()}
    assert (table["strict"], table["+1h"], table["+6h"], table["+30d"]) == ((1, 50.0, 0), (2, 100.0, 0), (2, 100.0, 1), (2, 100.0, 1))
    assert {(r.gold, r.bucket): r.n for r in evaluate.offset_buckets(offs).collect()} == {(True, "0-1h"): 1, (False, "1-6h"): 1, (True, "<=0 (before the question)"): 1}


def test_allocation():
    mix = {"a": 133, "b": 133, "c": 78, "d": 70, "e": 56, "f": 30, "abstention": 30}
    for n in (1, 25, 60, 100, 529):
        take = evaluate.allocate(mix, n, 5)
        assert sum(take.values()) == n
        assert all(take.get(k, 0) <= v for k, v in mix.items())
        assert take.get("abstention", 0) >= min(5, n)
    assert evaluate.allocate(mix, 1000) == mix


def test_stratified_sample_is_stable(spark):
    df = spark.createDataFrame([(f"q{i}", "xy"[i % 2], i % 10 == 0) for i in range(200)] + [("q1", "y", False)], "question_id string, question_type string, is_abstention boolean")
    a = sorted(map(tuple, evaluate.stratified_sample(df, 40, 1, 8).collect()))
    assert a == sorted(map(tuple, evaluate.stratified_sample(df.repartition(7), 40, 1, 8).collect()))
    assert len(a) == 40 and sum(s == "abstention" for _, s in a) >= 8


def test_done_ids(spark):
    df = spark.createDataFrame([(1, "a", "unmeasured"), (2, "a", "answered"), (3, "b", "answered"), (4, "b", " Unmeasured"), (5, None, "absent")], "line_no bigint, question_id string, status string")
    assert sorted(r[0] for r in evaluate.done_ids(df, False).collect()) == ["a", "b"]
    assert [r[0] for r in evaluate.done_ids(df, True).collect()] == ["a"]


def test_evidence_items_with_text_chain_and_unknown_key(spark):
    claims = spark.createDataFrame(
        [(f"k{i}", i, "user", "lives_in", o, "fact", "s", i, 100 * i) for i, o in enumerate(["Rome", "Oslo", "Bern", "Kyiv"])],
        "key string, line_no bigint, subj string, pred string, obj string, kind string, sid string, turn int, ts bigint",
    )
    turns = spark.createDataFrame([("s", 3, "user", "I moved to Kyiv.", True), ("s", 3, "user", None, None), ("s", 2, "system", "x", None)], "session_id string, idx int, role string, content string, has_answer boolean")
    links = spark.createDataFrame([(3, 2), (2, 1), (1, 0)], "later bigint, earlier bigint")
    wanted = spark.createDataFrame([("k3",), ("k2",), ("gone",)], "key string")
    out = {r.key: r for r in answering.evidence_items(wanted, claims, turns, links).collect()}
    assert (out["gone"].found, out["gone"].obj) == (False, None)
    assert (out["k3"].text, out["k3"].statement) == ("I moved to Kyiv.", "s|3")
    assert [r.obj for r in out["k3"].replaced] == ["Bern", "Oslo", "Rome"]
    assert (out["k2"].found, out["k2"].text) == (True, None)
    short = {r.key: r for r in answering.evidence_items(wanted, claims, turns, links, hops=1).collect()}
    assert [r.obj for r in short["k3"].replaced] == ["Bern"]
    assert answering.evidence_items(wanted, claims.limit(0), turns.limit(0), links.limit(0)).where("found").count() == 0


@pytest.mark.parametrize(
    ("reply", "status", "said"),
    [
        ({"answer": "0", "used": [1]}, "answered", "0"), ({"answer": 0}, "absent", None), ({"answer": False}, "absent", None), ({"answer": None}, "absent", None), ({"answer": []}, "absent", None),
        ({"answer": 42}, "answered", "42"), ({"answer": " \n"}, "absent", None), ({"used": [1]}, "unmeasured", None), ("text", "unmeasured", None), ({"answer": "x", "used": "all"}, "answered", "x"),
    ],
)
def test_replies_are_settled(spark, reply, status, said):
    p = spark.createDataFrame([("a", 1, "p")], "q string, hits int, prompt string")
    out = answering.answer(p, lambda _: reply).first()
    assert (out.status, out.answer) == (status, said)


def test_allocation_is_whole_and_in_proportion():
    import random

    rng = random.Random(1)
    for _ in range(300):
        sizes = {f"s{i}": rng.randrange(0, 50) for i in range(rng.randrange(1, 8))} | {"abstention": rng.randrange(0, 20)}
        n, floor = rng.randrange(0, 120), rng.randrange(0, 12)
        take = evaluate.allocate(sizes, n, floor)
        assert sum(take.values()) == min(n, sum(sizes.values()))
        assert all(0 <= take[k] <= sizes[k] for k in take)
        if n < sum(sizes.values()):
            assert take.get("abstention", 0) >= min(floor, sizes["abstention"], n)


def test_sample_does_not_depend_on_chunks(spark, monkeypatch):
    df = spark.range(400).select(F.concat(F.lit("q"), "id").alias("question_id"), F.when(F.col("id") < 300, "a").otherwise("b").alias("question_type"), (F.col("id") % 10 == 0).alias("is_abstention"))
    whole = {r.question_id for r in evaluate.stratified_sample(df, 40, 3, 5).collect()}
    monkeypatch.setattr(evaluate, "RANKED", 7)
    assert {r.question_id for r in evaluate.stratified_sample(df, 40, 3, 5).collect()} == whole
    assert len(whole) == 40
