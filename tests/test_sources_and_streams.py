import gzip
import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recordloom.operators import clients, records
from recordloom.sources import jsonl, sinks, tasks
from recordloom.streaming import pipeline


def lines(path, rows, end="\n"):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in rows) + end, encoding="utf-8")
    return str(path)


def test_scans(spark, tmp_path):
    path = lines(tmp_path / "a.jsonl", [{"id": "1", "x": {"y": 2}}, "", {"id": "2"}])
    assert [(r.id, r.x and r.x.y) for r in jsonl.scan(spark, path, "id string, x struct<y:int>").collect()] == [("1", 2), ("2", None)]
    assert jsonl.count(spark, path) == 2
    assert jsonl.optional_scan(spark, str(tmp_path / "none.jsonl"), "id string").count() == 0
    bad = lines(tmp_path / "b.jsonl", [{"id": "1"}, "[1", "{\"id\": 3"])
    with pytest.raises(Exception):
        jsonl.scan(spark, bad, "id string").collect()
    assert [r._corrupt_record for r in jsonl.scan(spark, bad, "id string", strict=False).collect()] == [None, "[1", "{\"id\": 3"]
    torn = lines(tmp_path / "c.jsonl", [{"id": "1"}], end="")
    found = jsonl.torn_tails(spark, str(tmp_path)).collect()
    assert [r.path.rsplit("/", 1)[1] for r in found] == ["c.jsonl"] and torn


def test_dispatch_by_version(spark, tmp_path):
    path = lines(tmp_path / "v.jsonl", [{"schema_version": "a.v1", "n": 1}, {"schema_version": "b.v1", "t": "x"}, {"schema_version": "c"}, {"q": 1}])
    parts = jsonl.dispatched(spark, path, {"a.v1": "n int", "b.v1": "t string"})
    assert [r.n for r in parts["a.v1"].collect()] == [1] and [r.t for r in parts["b.v1"].collect()] == ["x"]
    assert {r.version for r in parts[None].collect()} == {"c", None}


def test_offsets_read_in_ranges_reach_every_line_once(spark, tmp_path):
    rows = [{"id": i, "t": "é" * (i % 17)} for i in range(200)]
    path = lines(tmp_path / "o.jsonl", rows)
    got = jsonl.with_offsets(spark, path, split=97).collect()
    assert sorted(json.loads(r.line)["id"] for r in got) == list(range(200))
    assert all(jsonl.record_at(path, r.offset) == json.loads(r.line) for r in got[::23])


def test_arrow_files_and_logs(spark, tmp_path):
    paths = []
    for k in range(2):
        table = pa.table({"a": [k, k + 10], "b": ["x", None]})
        paths.append(str(tmp_path / f"s{k}.arrow"))
        with pa.OSFile(paths[-1], "wb") as f, pa.ipc.new_file(f, table.schema) as w:
            w.write_table(table)
    assert sorted((r.a, r.b, r.shard) for r in jsonl.arrow_files(spark, paths).collect() if r.b) == [(0, "x", 0), (1, "x", 1)]
    log = lines(tmp_path / "run.log", ['12:00 start {"lr": 0.5}', "noise", "12:01 other {}"])
    assert [r.lr for r in jsonl.log_events(spark, log, "start", "lr double").collect()] == [0.5]


def test_task_importers(spark):
    a = spark.createDataFrame([
        (1, "q1", json.dumps({"inputs": ["1", "2"], "outputs": ["3", "4"]})), (2, "q2", json.dumps({"inputs": ["1"], "outputs": ["3"], "fn_name": "f"})),
        (3, "q3", json.dumps({"inputs": ["1"], "outputs": []})), (4, " ", json.dumps({"inputs": [], "outputs": []})), (5, "q5", "not json"),
    ], "i int, question string, input_output string")
    got = {r.source_row: r for r in tasks.from_json_columns(a, "i").collect()}
    assert [(t.test_input, t.test_output) for t in got["1"].tests] == [("1", "3"), ("2", "4")] and got["2"].interface_type == "function"
    assert {(r.source_row, r.reason) for r in tasks.rejected(tasks.from_json_columns(a, "i")).collect()} == {
        ("3", "tests do not pair"), ("4", "no text"), ("5", "tests do not pair")}
    b = spark.createDataFrame([("n", "d", (["1"], ["2"]), ([], []))], "name string, d string, p struct<input:array<string>,output:array<string>>, g struct<input:array<string>,output:array<string>>")
    r = tasks.from_test_groups(b, "name", "d", ["p", "g"]).first()
    assert len(r.tests) == 1 and json.loads(r.extra) == {"p": 1, "g": 0}
    c = spark.createDataFrame([("n", "Body", "", [("1", "2"), ("3", "4")])], "id string, s string, note string, ex array<struct<input:string,output:string>>")
    r = tasks.from_statements(c, "id", {"": "s", "Note": "note"}, "ex", "ex").first()
    assert r.problem_text == "Body\n\nExample 1\nInput:\n1\nOutput:\n2\n\nExample 2\nInput:\n3\nOutput:\n4" and len(r.tests) == 2
    d = spark.createDataFrame([("u1", [("in", '["a", "b"]'), ("in2", '"c"')])], "uid string, tests array<struct<input:string,output:string>>")
    e = spark.createDataFrame([("x", "text", "u1"), ("y", "text", "u2")], "id string, t string, uid string")
    r = tasks.with_dictionary(e, "id", "t", d, "uid").collect()
    assert [[(t.test_input, t.test_output) for t in x.tests] for x in r] == [[("in", "a"), ("in", "b"), ("in2", "c")]]
    f = spark.createDataFrame([(7, "p", ["assert f()"], "f")], "i int, t string, tests array<string>, e string")
    assert tasks.from_functions(f, "i", "t", "tests", "e").first().tests[0].test_input == "assert f()"
    with pytest.raises(ValueError):
        tasks.union_in_order([("a", e)], {"a": 3})


def test_publish(spark, tmp_path):
    df = spark.createDataFrame([("1", 2.5, None), ("2", None, "x")], "id string, v double, t string")
    path = str(tmp_path / "out")
    assert sinks.publish_once(df, path) == "published"
    assert sinks.publish_once(df.orderBy(F.desc("id")), path) == "unchanged"
    with pytest.raises(FileExistsError):
        sinks.publish_once(df.union(df), path)
    assert sinks.publish_report({"a": 1}, str(tmp_path / "r.json")) == "published"
    assert sinks.publish_report({"a": 1}, str(tmp_path / "r.json")) == "unchanged"
    with pytest.raises(FileExistsError):
        sinks.publish_report({"a": 2}, str(tmp_path / "r.json"))
    assert sinks.publish_split(df, {"some": "v is not null", "none": "v is null"}, str(tmp_path / "split")) == {"some": 1, "none": 1}
    with pytest.raises(FileExistsError):
        sinks.publish_together({"a": df}, str(tmp_path / "split"))
    assert sinks.seal(df, str(tmp_path / "sealed"))["rows"] == 2
    assert sinks.markdown_table(df.orderBy("id"), 1).endswith("More rows are left out.\n")


def test_gzip_shards_are_deterministic_and_audited(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(25)], "i int, t string")
    made = [sinks.gzip_shards(df.repartition(k + 2), ["i"], str(tmp_path / f"g{k}"), 10) for k in range(2)]
    rows = [sorted(tuple(r) for r in m.collect()) for m in made]
    assert rows[0] == rows[1] and [r[:2] for r in rows[0]] == [(f"train-0000{k}-of-00003.jsonl.gz", n) for k, n in enumerate((10, 10, 5))]
    with gzip.open(tmp_path / "g0" / rows[0][2][0], "rt") as f:
        assert [json.loads(x)["i"] for x in f] == [20, 21, 22, 23, 24]
    assert sinks.audit_shards(spark, str(tmp_path / "g0"), made[1]).count() == 0
    (tmp_path / "g0" / rows[0][0][0]).write_bytes(b"")
    assert [r.name for r in sinks.audit_shards(spark, str(tmp_path / "g0"), made[1]).collect()] == [rows[0][0][0]]
    assert sinks.file_digests(spark, str(tmp_path / "g1")).count() == 3


def raw(i, status="ok", tokens=True):
    content = [{"token": "a", "bytes": [97], "logprob": -0.1, "top_logprobs": []}] if tokens else None
    choice = {"finish_reason": "stop", "message": {"role": "assistant", "content": "a"}, "logprobs": {"content": content}}
    return {"schema_version": "v1", "id": i, "status": status, "response": {"id": "r", "model": "m", "choices": [choice], "usage": {"t": 2}}}


def test_streams_equal_the_batch_and_go_on_after_a_stop(spark, tmp_path):
    queue, normal, errors, state = (str(tmp_path / n) for n in ("raw", "normal", "errors", "checkpoint"))
    pipeline.land([raw("a"), raw("b", tokens=False), raw("c", status="error")], queue)
    pipeline.normalise_stream(spark, queue, normal, errors, state)
    pipeline.land([raw("d"), raw("e")], queue)
    pipeline.normalise_stream(spark, queue, normal, errors, state)
    pipeline.normalise_stream(spark, queue, normal, errors, state)
    good, bad = records.split_errors(records.normalise(jsonl.scan(spark, queue, records.RAW)))
    assert sorted(r.id for r in spark.read.parquet(normal).collect()) == sorted(r.id for r in good.collect()) == ["a", "d", "e"]
    assert [r.id for r in spark.read.parquet(errors).collect()] == [r.id for r in bad.collect()] == ["b"]
    read = lambda p: spark.read.parquet(p)
    verdicts = spark.createDataFrame([("a",), ("d",)], "id string")
    rows = jsonl.scan(spark, queue, records.RAW)
    assert tuple(pipeline.lags(rows, read(normal), read(errors), verdicts).first()) == (0, 1)
    assert not pipeline.finished(rows, read(normal), read(errors), verdicts)
    assert pipeline.finished(rows, read(normal), read(errors), read(normal))


def test_distinct_stream_over_restarts(spark, tmp_path):
    queue, out, state = (str(tmp_path / n) for n in ("q", "out", "checkpoint"))
    report = pipeline.StateReport(str(tmp_path / "state.json"))
    spark.streams.addListener(report)
    for part in ([("a", 1), ("a", 1)], [("b", 2), ("a", 1)]):
        pipeline.land([{"id": i, "n": n} for i, n in part], queue)
        pipeline.distinct_stream(spark, queue, "id string, n int", "id", out, state)
    spark.streams.removeListener(report)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == ["a", "b"]
    assert [r.id for r in pipeline.repeated(spark.read.json(queue), "id").collect()] == ["a"]


def test_clients_and_programs(spark):
    def make():
        def call(text):
            if text == "bad":
                raise ValueError("no")
            return text.upper()

        return call

    df = spark.createDataFrame([(1, "x"), (2, "bad")], "i int, t string")
    assert sorted((r.i, r.status, r.response, r.error) for r in clients.call_each(df, "i", "t", make).collect()) == [
        (1, "ok", "X", None), (2, "error", None, "ValueError: no")]
    programs = spark.createDataFrame([
        ("pass", "def f():\n    return 1", "assert f() == 1"), ("assert", "def f():\n    return 2", "assert f() == 1"), ("syntax", "def f(", ""),
        ("import", "import not_there_at_all", ""), ("runtime", "f()", ""), ("slow", "while True:\n    pass", ""), ("null", None, ""),
    ], "i string, s string, t string")
    got = {r.i: r.failure_category for r in clients.verify(programs, "i", "s", "t", timeout=1.5).collect()}
    assert got == {"pass": "passed", "assert": "assertion_failure", "syntax": "syntax_error", "import": "import_error",
                   "runtime": "runtime_error", "slow": "timeout", "null": "extraction_error"}
