import json

import pytest
from pyspark.errors import PySparkException

from memq.operators import answering, evaluate
from memq.sources import dataset, graph, logs, reports


def test_log_skips_broken_lines_and_the_last_wins(spark, tmp_path):
    p = tmp_path / "log.jsonl"
    rows = [{"event": "start", "sid": "a"}, {"event": "done", "sid": "a"}, {"event": "start", "sid": "b"}]
    p.write_text("\n".join(map(json.dumps, rows)) + "\n\n" + '{"event": "done", "sid": "b')
    log = logs.read_log(spark, str(p), logs.CHECKPOINT)
    assert log.count() == 3
    assert {r.sid: (r.done, r.interrupted) for r in logs.checkpoint(log).collect()} == {"a": (True, False), "b": (False, True)}
    last = logs.read_log(spark, str(p), logs.CHECKPOINT, key="sid")
    assert {r.sid: r.event for r in last.collect()} == {"a": "done", "b": "start"}
    with pytest.raises(Exception, match="(?i)read"):
        logs.read_strict(spark, str(p), logs.CHECKPOINT).collect()
    sessions = spark.createDataFrame([("c", 1), ("b", 3), ("a", 2)], "sid string, ts bigint")
    assert [r.sid for r in logs.to_ingest(sessions, logs.checkpoint(log)).collect()] == ["c", "b"]


def test_claim_cache(spark, tmp_path):
    p = tmp_path / "claims.jsonl"
    claim = {"turn": 0, "subject": "u", "predicate": "p", "object": "o", "kind": "fact"}
    rows = [
        {"sid": "a", "status": "unmeasured", "claims": []}, {"sid": "a", "status": "measured", "claims": [claim], "drops": {"bad_kind": 2}, "prompt_version": 2},
        {"sid": "b", "status": "measured", "claims": [claim]}, {"sid": "c", "status": "unmeasured", "reason": "x"},
    ]
    p.write_text("\n".join(map(json.dumps, rows)))
    cache = logs.read_log(spark, str(p), logs.CACHE, key="sid")
    assert [r.sid for r in logs.stale(cache, 2).collect()] == ["b"]
    assert [r.sid for r in logs.unmeasured(cache).collect()] == ["c"]
    out = logs.cached_claims(cache, spark.createDataFrame([("a", 77)], "sid string, ts bigint")).collect()
    assert [(r.sid, r.ts, r.card) for r in out] == [("a", 77, "many")]
    assert [tuple(r) for r in logs.drop_totals(cache).collect()] == [("bad_kind", 2)]


def test_probe_reports(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps({"report": [{"check": "a", "ok": True}, {"check": "b", "ok": False, "error": " no "}]}))
    (tmp_path / "two.json").write_text(json.dumps({"checks": [{"name": "a", "verdict": "no"}, {"name": "b", "verdict": "skip"}, {"name": "c", "verdict": "yes"}]}))
    checks = logs.probe_checks(spark, {"first": str(tmp_path / "one.json"), "second": str(tmp_path / "two.json")})
    assert {r.name: (r.probe, r.verdict) for r in logs.latest_verdicts(checks).collect()} == {"a": ("second", "FAILS"), "b": ("first", "FAILS"), "c": ("second", "WORKS")}
    assert [tuple(r) for r in logs.overturned(checks, "first").collect()] == [("a", "WORKS", "FAILS")]
    assert logs.capability_tally(checks).count() == 5


def instance(qid="q", ids=("s2", "s1"), **more):
    turn = lambda c: [{"role": "user", "content": c}]
    raw = {
        "question_id": qid, "question_type": "t", "question": "?", "answer": "a", "question_date": "2023/04/10 (Mon) 23:07", "haystack_session_ids": list(ids),
        "haystack_dates": ["2023/04/10 (Mon) 17:50", "2023/04/10 (Mon) 14:47"], "haystack_sessions": [turn("x"), turn("y")], "answer_session_ids": ["s1"],
    }
    return raw | more


def write(tmp_path, data):
    p = tmp_path / "data.json"
    p.write_text(json.dumps(data))
    return str(p)


def test_dataset(spark, tmp_path):
    raw = dataset.read(spark, write(tmp_path, [instance(), instance("q2_abs", haystack_sessions=[[{"role": "user", "content": "changed"}], [{"role": "user", "content": "y"}]])]))
    inst = dataset.instances(raw)
    rows = inst.orderBy("file_order").collect()
    assert [s.sid for s in rows[0].sessions] == ["s1", "s2"]
    assert [r.is_abstention for r in rows] == [False, True]
    unique, collisions = dataset.unique_sessions(dataset.session_texts(inst))
    assert unique.count() == 2
    assert [r.sid for r in collisions.collect()] == ["s2"]
    assert dataset.read(spark, write(tmp_path, [instance(), instance("z")]), limit=1).count() == 1
    assert unique.orderBy("sid").select(dataset.rendered(), dataset.plain()).first() == ("[0] user: y", "user: y")


@pytest.mark.parametrize("bad", [{"haystack_sessions": [[{"role": "user", "content": "x"}]]}, {"haystack_sessions": [[{"role": "user"}], []]}, {"question_date": "2023/04/10 (Tue) 23:07"}])
def test_dataset_raises(spark, tmp_path, bad):
    with pytest.raises(PySparkException):
        dataset.instances(dataset.read(spark, write(tmp_path, [instance(**bad)]))).collect()


def test_dataset_must_be_a_list(spark, tmp_path):
    with pytest.raises(ValueError):
        dataset.read(spark, write(tmp_path, {"a": 1}))


def test_graph_writes(spark):
    w = spark.createDataFrame([(1, "k", "a", None), (2, "k", None, "x"), (3, "k", "b", None), (4, None, "z", "z")], "n int, key string, p string, q string")
    assert [tuple(r) for r in graph.merge_nodes(w, "key", "n").collect()] == [("k", "b", "x")]
    edges = spark.createDataFrame([("a", "R", "b"), ("a", "R", "c"), ("a", "S", "b")], "src string, rel string, dst string")
    new = spark.createDataFrame([("a", "R", "d"), ("a", "R", "d")], "src string, rel string, dst string")
    assert graph.add_edges(edges, new).count() == 5
    assert graph.delete_edges(edges, new).collect() == [("a", "S", "b")]
    assert sorted(map(tuple, graph.exactly_once(edges, new).collect())) == [("a", "R", "d"), ("a", "S", "b")]
    nodes = spark.createDataFrame([("k", "a"), ("l", "b")], "key string, p string")
    out = graph.set_property(nodes, "key", spark.createDataFrame([("k", "z")], "key string, p string"), "p")
    assert sorted(map(tuple, out.collect())) == [("k", "z"), ("l", "b")]
    with pytest.raises(ValueError):
        graph.check_names(["1x"])


def test_reports(spark, tmp_path):
    from test_answering import row, runs

    r = runs(spark, row(1, "answered", ["s"], ["s"]), row(2, "absent", ["s"], ["s"]), row(3, "absent", [], [], abst=True))
    judged = evaluate.judge(r, evaluate.says_gold())
    text = reports.results(evaluate.headline(judged), evaluate.regimes(r, judged), evaluate.abstention(judged))
    assert "Accuracy 0.5 (1/2)" in text and "| t |" in text
    page = reports.inspector(spark.createDataFrame([("a</script>", "k", "t")], "id string, kind string, question_type string"))
    assert "a<\\/script>" in page and page.count("</script>") == 1
    with pytest.raises(ValueError):
        reports.markdown_table(spark.range(3), most=2)
    reports.append_log(spark.range(2), str(tmp_path / "log"))
    reports.append_log(spark.range(3), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 5
    assert answering.NO_MODEL


def test_capability_page(spark):
    rows = [
        (0, "one", "create", "FAILS", "no id", "", ""), (0, "one", "union", "WORKS", "", "", ""), (1, "two", "create", "WORKS", "", "CREATE  (a {id: 1})", ""),
        (1, "two", "ssp", "SKIPPED", "", "", ""), (1, "two", "in", "FAILS", "rejected\nhere", "", ""),
    ]
    checks = spark.createDataFrame(rows, "place int, probe string, name string, verdict string, detail string, query string, note string")
    page = reports.capability_page(checks, logs.latest_verdicts(checks), logs.overturned(checks, "one"))
    assert "5 checks in 2 probes: 2 worked, 2 did not, 1 were not reached." in page
    assert "| create | FAILS | WORKS |" in page
    assert "- **create** (two): `CREATE (a {id: 1})`" in page
    assert "- **in** (two): `rejected here`" in page
    assert page.rstrip().endswith("`ssp`")


def test_a_folder_of_arrays_and_a_file_that_is_none(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for i in range(2):
        (tmp_path / "d" / f"{i}.json").write_text('\n [{"question_id": "q%d"}]' % i)
    assert dataset.read(spark, str(tmp_path / "d")).count() == 2
    (tmp_path / "x.json").write_text('{"a": 1}')
    with pytest.raises(ValueError):
        dataset.read(spark, str(tmp_path / "x.json"))
