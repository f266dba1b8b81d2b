import datetime

from memq.streaming import logs

T0 = datetime.datetime(2024, 1, 1)
SCHEMA = "id string, at timestamp, pred string, obj string, ts bigint"


def stored(spark, path, *batches):
    for b in batches:
        spark.createDataFrame([(i, T0 + datetime.timedelta(minutes=m), p, o, m) for i, m, p, o in b], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return spark.read.parquet(path).schema


def run(spark, stream, mode, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return [tuple(r) for r in spark.table(name).collect()]


def test_once_per_id_and_resume(spark, tmp_path):
    src, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    schema = stored(spark, src, [("a", 0, "p", "x"), ("b", 1, "p", "x"), ("a", 2, "p", "x")])
    logs.sink(logs.once_per_id(logs.read_stream(spark, src, schema), "id", "at"), out, ck).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == ["a", "b"]
    stored(spark, src, [("a", 3, "p", "x"), ("c", 4, "p", "x")])
    logs.sink(logs.once_per_id(logs.read_stream(spark, src, schema), "id", "at"), out, ck).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_latest_value_goes_by_time_not_arrival(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = stored(spark, src, [("1", 5, "p", "new")], [("2", 1, "p", "old")], [("3", 9, "p", "newest"), ("4", 2, "q", "other")])
    out = run(spark, logs.latest_values(logs.read_stream(spark, src, schema, files=1), ["pred"], "obj", "ts"), "update", "latest")
    last = {}
    for pred, ts, value in out:
        last[pred] = max(last.get(pred, (-1, "")), (ts, value))
    assert last == {"p": (9, "newest"), "q": (2, "other")}
    assert "old" not in {v for p, _, v in out if p == "p"} or ("p", 1, "old") == out[0]


def test_windows_and_sessions(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = stored(spark, src, [("1", 0, "p", "x"), ("2", 10, "p", "x"), ("3", 70, "p", "x")], [("4", 600, "p", "x")], [("5", 1200, "p", "x")])
    stream = logs.read_stream(spark, src, schema, files=1)
    counts = run(spark, logs.windowed_counts(stream, "at", ["pred"]), "append", "counts")
    assert [r[-1] for r in sorted(counts)][:2] == [2, 1]
    found = run(spark, logs.sessions(stream, "at", ["pred"]), "append", "found")
    assert [r[-1] for r in sorted(found)][:2] == [2, 1]


def test_batch_sink_is_idempotent(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = stored(spark, src, [("1", 0, "p", "x"), ("2", 1, "p", "x")])
    for ck in ("one", "two"):  # the same batch once more, as after a lost checkpoint
        logs.batch_sink(logs.read_stream(spark, src, schema), out, str(tmp_path / ck)).awaitTermination()
    assert spark.read.parquet(out).count() == 2


def test_upserted_keeps_the_newest_row_of_a_key(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = stored(spark, src, [("1", 5, "p", "new"), ("2", 1, "q", "only")], [("1", 3, "p", "late")])
    logs.batch_sink(logs.read_stream(spark, src, schema, files=1), out, str(tmp_path / "ck")).awaitTermination()
    assert {(r.id, r.obj) for r in logs.upserted(spark, out, ["id"], "ts").collect()} == {("1", "new"), ("2", "only")}


def test_latest_values_of_another_type(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = stored(spark, src, [("1", 5, "p", "a"), ("2", 7, "p", "b")])
    stream = logs.read_stream(spark, src, schema).selectExpr("pred", "cast(ts * 2 as bigint) as v", "ts")
    assert run(spark, logs.latest_values(stream, ["pred"], "v", "ts"), "update", "numbers") == [("p", 7, 14)]
