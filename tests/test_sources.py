import json

import pytest
from pyspark.sql import functions as F

from inkwell.operators import context, merge, prompt, window
from inkwell.registry import ContextProvider, Registry, deep_merge
from inkwell.sources import log, responses, shared, tables


def test_log_round_trip(spark, tmp_path):
    path = str(tmp_path / "log")
    r = spark.createDataFrame([("a", 1, "p", "q")], "request_id string, timestamp long, lines_before string, lines_after string")
    log.append_log(log.requests(r), path)
    log.append_log(log.responses(spark.createDataFrame([("a", 2, ["x", "y"], 0.5)], "request_id string, timestamp long, completions array<string>, response_time_ms double")), path)
    log.append_log(log.acceptances(spark.createDataFrame([("a", 3, True, "full")], "request_id string, timestamp long, accepted boolean, acceptance_type string")), path)
    (tmp_path / "log" / "bad.json").write_text('{"event_type": "response", "request_id": "b", "response_raw": {}}\n{"event_type": \n')
    rows = {(x.event_type, x.request_id): x for x in log.read_log(spark, path).collect()}
    assert rows["response", "a"].responses == ["x", "y"] and rows["response", "b"].responses is None
    assert rows["acceptance", "a"].accepted is True and rows["request", "a"].lines_before == "p"
    assert [x._corrupt for x in rows.values() if x._corrupt] == ['{"event_type": ']


def test_redaction():
    got = log.redacted({"url": "u", "headers": {"Authorization": "k"}, "n": {"api_key": "s", "x": [1, {"token": 2}]}, "f": print})
    assert got == {"url": "u", "headers": "***", "n": {"api_key": "***", "x": [1, {"token": "***"}]}, "f": {"__type": "function"}}
    json.dumps(got)


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("l1\nl2\nl3")
    d = tables.files(spark, str(tmp_path)).withColumn("start_line", F.lit(2))
    assert tables.file_lines(d).first().code == "l2\nl3"
    assert tables.file_lines(d.withColumn("start_line", F.lit(9))).first().code is None


def test_bodies(spark):
    x = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert x(responses.from_choices(F.lit('{"choices":[{"message":{"content":"a"}},{"text":"b"},{}]}'))) == ["a", "b"]
    assert x(responses.from_choices(F.lit("not json"))) is None
    assert x(responses.from_blocks(F.lit('{"content":[{"type":"text","text":"a"},{"type":"tool"}]}'))) == ["a"]
    assert x(responses.from_generate(F.lit('{"response":"a<EOT>b<EOT>"}'))) == ["ab"] and x(responses.from_generate(F.lit("{}"))) is None
    p = prompt.chat(F.lit("pre"), F.lit("suf"), F.lit("lua"), F.lit(""), F.array(F.lit("bad")))
    got = x(p)
    assert got.mode == "chat" and [m.role for m in got.messages] == ["system", "user", "assistant", "user"]
    assert "lua" in got.messages[0].content and "<code_prefix>pre</code_prefix><code_suffix>suf</code_suffix><code_middle>" == got.messages[1].content
    body = json.loads(x(responses.blocks_body(p.cast(prompt.PROMPT), F.lit("m"), 9)))
    assert body["system"] == got.messages[0].content and len(body["messages"]) == 3
    body = json.loads(x(responses.chat_body(prompt.fim(F.lit("a"), F.lit("b"), F.lit("")).cast(prompt.PROMPT), F.lit("m"), 0.5, 2, 7)))
    assert body == {"model": "m", "temperature": 0.5, "n": 2, "stream": False, "max_tokens": 7, "prompt": "\na", "suffix": "b"}
    body = json.loads(x(responses.generate_body(prompt.formatted(F.lit("chat"), F.lit("a"), F.lit("b"), F.lit("c"), F.lit("ctx"), F.lit(None).cast("array<string>")).cast(prompt.PROMPT), F.lit("m"))))
    assert len(body["messages"]) == 2 and "prompt" not in body


def test_registry(spark):
    class Upper(ContextProvider):
        defaults = {"n": 1}

        def contexts(self, requests):
            return requests.select("request", F.upper("text").alias("content"))

    r = Registry()
    r.provider("upper", Upper(n=2), priority=5)
    r.provider("plain", lambda d: d.select("request", F.col("text").alias("content")), priority=1)
    r.provider("off", Upper(), enabled=False)
    d = spark.createDataFrame([(1, "a"), (2, None), (3, "")], "request int, text string")
    got = {x.request: x.content for x in merge.weighted(r.gather(d), "request").collect()}
    assert got == {1: "a\n\nA"} and Registry().gather(d).count() == 0
    assert deep_merge({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    assert deep_merge({"a": 1}, {"a": 2, "b": 3}, force=False) == {"a": 1, "b": 3}


def test_reserved_and_windows(spark):
    t = spark.createDataFrame([("python", "self"), ("python", "x"), ("lua", "self"), ("go", "self"), ("go", "nil")], "filetype string, name string")
    assert sorted(tuple(r) for r in context.without_reserved(t, context.reserved_names(spark)).select("filetype", "name").collect()) == [("go", "self"), ("python", "x")]
    w = spark.range(1).select(window.line_window(F.lit("a\nbc\nd"), F.lit(1), F.lit(1), 1).alias("w")).first().w
    assert tuple(w) == ("a\nb", "c\nd")


def test_shared_folder_is_required_off_local_masters():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_folder(Session())
    Context.master = "local-cluster[2,1,1024]"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_folder(Session())


def test_written_tables_can_be_forgotten(spark):
    import os

    kept, gone = (shared.written(spark.range(3), "t") for _ in range(2))
    shared.forget(gone, spark.range(1))
    assert kept.count() == 3 and not os.path.exists(gone.written_to.removeprefix("file://"))
    shared.clean(spark)
    assert not os.path.exists(kept.written_to.removeprefix("file://"))
