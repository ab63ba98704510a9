import datetime as dt
import os
import random
import subprocess
import sys

import pytest
from conftest import ROOT
from pyspark.sql import functions as F

from inkwell.sources import log
from inkwell.streaming import events, machine

START = dt.datetime(2024, 1, 1)
TEXTS = ["local function_name()", "this.call(arg)", "ab cde fg"]


def random_events(seed, buffers=6, n=60):
    rnd = random.Random(seed)
    rows = []
    for b in range(buffers):
        t, text = 0, TEXTS[b % 3]
        for i in range(n):
            t += rnd.choice([100, 300, 700, 1500])
            kind = rnd.choices(["response", "move", "leave"], [3, 10, 1])[0]
            text = rnd.choice(TEXTS) if kind == "response" else text
            line = text if rnd.random() < 0.9 else "zz" + text
            rows.append((b, START + dt.timedelta(milliseconds=t), kind, f"{b}-{i}", 1 if rnd.random() < 0.95 else 2, 0 if kind == "response" else rnd.randint(0, 9), line, [text, text.upper()]))
    return rows


def told(b, g):
    return (b, g["request_id"], g["outcome"], g["reason"], g["typed"] or "", tuple(g["shown"] or ()), g["ms"])


def rows_of(df):
    ms = F.unix_millis("ts") - int((START - dt.datetime(1970, 1, 1)).total_seconds() * 1000)
    return sorted(told(r.buffer_id, r.asDict()) for r in df.withColumn("ms", ms).collect())


def plainly(rows, idle_ms, spec="1+1"):
    out = []
    for b in sorted({r[0] for r in rows}):
        p = None
        for r in sorted((r for r in rows if r[0] == b), key=lambda r: r[1]):
            e = dict(zip(("buffer_id", "ts", "kind", "request_id", "row", "col", "line", "candidates"), r)) | {"ms": round((r[1] - START).total_seconds() * 1000)}
            p, got = machine.step(p, e, spec, idle_ms)
            out += [told(b, g) for g in got]
        _, got = machine.step(p, {"ms": 2**62, "kind": "end"}, spec, idle_ms)
        out += [told(b, g) for g in got]
    return sorted(out)


def test_states():
    r = {"kind": "response", "ms": 0, "request_id": "r", "row": 1, "col": 0, "line": "", "candidates": ["ab cd", "xy"]}
    move = lambda line, col, ms=10, row=1: {"kind": "move", "ms": ms, "row": row, "col": col, "line": line}
    p, out = machine.step(None, r)
    assert p and not out
    assert machine.step(p, move("a", 1))[1] == [] and machine.step(p, move("a", 1))[0]["typed"] == "a"
    assert machine.step(p, move("ab c", 4))[1][0]["shown"] == ["d"]
    assert machine.step(p, move("q", 1))[1][0]["reason"] == "mismatch"
    assert machine.step(p, move("a", 1, row=2))[1][0]["reason"] == "cursor_moved"
    # the threshold is that of the first candidate, whichever matches
    assert machine.step(p, move("xy", 2))[1] == []
    assert machine.step(p, move("a", 1, ms=5000))[1][0]["reason"] == "idle"
    assert machine.step(p, {"kind": "leave", "ms": 10}) == (None, [])
    assert machine.step(None, r, idle_ms=0)[1][0]["reason"] == "at once"
    assert machine.step(p, move("a", 1, ms=5000), idle_ms=-1)[1] == []


def test_batch_and_stream_agree_with_a_loop(spark, tmp_path):
    rows = random_events(1)
    d = spark.createDataFrame(rows, machine.EVENTS)
    want = plainly(rows, 1000)
    got = rows_of(machine.validated(d))
    assert got == want and len(want) > 20
    # one file a second of events, then two late ones that move the watermark past all timers
    ordered = sorted(rows, key=lambda r: r[1])
    for i in range(0, len(ordered), 60):
        spark.createDataFrame(ordered[i : i + 60], machine.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for i in range(2):
        spark.createDataFrame([(99, START + dt.timedelta(days=1 + i), "leave", None, 1, 0, "", None)], machine.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = machine.validated_stream(stream).writeStream.format("memory").queryName("shown").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert rows_of(spark.table("shown")) == want


@pytest.mark.parametrize("spec, idle_ms", [("1+1", 1000), ("1+1", 0), ("1+1", -1), ("+3", 700), ("2", 1500), ("1+0.5", 300), ("none", 1000)])
def test_windows_agree_with_a_loop(spark, spec, idle_ms):
    rows = random_events(hash_of(spec) + idle_ms + 7, buffers=5, n=80)
    # without candidates, without a line, and with a candidate that is typed whole
    rows = [r[:6] + (None if i % 17 == 0 else r[6], None if i % 23 == 0 else r[7] + ["th", "t"]) for i, r in enumerate(rows)]
    d = spark.createDataFrame(rows, machine.EVENTS)
    want = plainly(rows, idle_ms, spec)
    assert rows_of(machine.validated(d, spec, idle_ms)) == want and want
    assert machine.validated(d.limit(0), spec, idle_ms).count() == 0


def hash_of(text):
    return sum(map(ord, text))


def test_workers_import_the_package_from_any_folder(tmp_path):
    """Python workers find it in a session that was started elsewhere."""
    code = f"""import sys; sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession, functions as F
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
from inkwell.streaming import machine
d = s.createDataFrame([(1, 0, "a", "b")], "id int, arrival int, content string, kind string")
assert machine.scan(d, "id", ["arrival"], dict, lambda state, r: iter([{{"n": len(machine.rests(["ab"], "a"))}}] if r else []), "id int, n int").collect()[0].n == 1
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=300)


def test_debounce_stream_equals_batch(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(i % 3, i, START + dt.timedelta(seconds=rnd.randint(0, 2000))) for i in range(200)]
    last = [(0, 999, START + dt.timedelta(days=1))]
    schema = "user_id int, id int, ts timestamp"
    spark.createDataFrame(sorted(rows, key=lambda r: r[2]), schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame(last, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("ts", "1 hour")
    q = events.debounced(stream, "user_id", "30 seconds").writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    key = lambda d: sorted((r.user_id, r.first_ts, r.n) for r in d.collect())
    assert key(spark.table("bursts")) == key(events.debounced(spark.createDataFrame(rows, schema), "user_id", "30 seconds"))


def test_cache_and_memory(spark):
    rnd = random.Random(4)
    rows = [(i % 2, i, START + dt.timedelta(seconds=i), rnd.randint(0, 9), rnd.randint(0, 1)) for i in range(300)]
    got = {(r.client, r.id): r.hit for r in machine.cache_hits(spark.createDataFrame(rows, "client int, id long, ts timestamp, key int, version int"), 4).collect()}
    caches = {0: [], 1: []}
    for c, i, _, k, v in rows:
        cache = caches[c]
        assert got[c, i] == ((k, v) in cache)
        caches[c] = ([x for x in cache if x[0] != k] + [(k, v)])[-4:]
    ev = [(1, i, START + dt.timedelta(seconds=i), k, str(i)) for i, k in enumerate(["reject", "reject", "request", "request", "reject"])]
    m = machine.rejected_memory(spark.createDataFrame(ev, "client int, id long, ts timestamp, kind string, completion string")).orderBy("id").collect()
    assert [r.rejected for r in m] == [["0", "1"], []]


def test_latest_wins(spark):
    rows = [(1, i, START + dt.timedelta(seconds=s), START + dt.timedelta(seconds=s + 5)) for i, s in enumerate([0, 3, 20])]
    d = events.latest_wins(spark.createDataFrame(rows, "user int, id int, ts timestamp, done_ts timestamp"), "user").orderBy("id")
    assert [r.stale for r in d.collect()] == [True, False, False]
    assert events.latest_wins(spark.createDataFrame([], d.drop("stale").schema), "user").count() == 0
    assert d.select(F.max("id")).first()[0] == 2


def test_latest_wins_stream(spark, tmp_path):
    rows = [(1, i, START + dt.timedelta(seconds=s)) for i, s in enumerate([0, 3, 8, 20])] + [(2, 9, START), (1, 99, START + dt.timedelta(days=1))]
    spark.createDataFrame(rows, "user int, id int, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user int, id int, ts timestamp").parquet(str(tmp_path / "in"))
    out = events.latest_wins_stream(stream, "user", "1 minute", "10 seconds")
    q = out.writeStream.format("memory").queryName("newest").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    events.finish(q)
    assert sorted((r.user, r.id) for r in spark.table("newest").collect()) == [(1, 2), (1, 3), (2, 9)]


def test_answered_stream_equals_batch(spark, tmp_path):
    at = lambda s: START + dt.timedelta(seconds=s)
    asked = [(i, at(10 * i)) for i in range(20)]
    told = [(i, at(10 * i + i * 30)) for i in range(0, 20, 2)] + [(777, at(5))]
    schema = "request_id int, ts timestamp"
    for name, rows in (("asked", asked), ("told", told)):
        for part in (rows, [(1000, at(86_400))], [(1001, at(2 * 86_400))]):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    read = lambda name: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    q = events.answered(read("asked"), read("told")).writeStream.format("memory").queryName("answered").option("checkpointLocation", str(tmp_path / "c")).start()
    events.finish(q)
    want = sorted((i, str(at(10 * i + i * 30)) if i % 2 == 0 and i * 30 <= 300 else "None") for i, _ in asked)
    key = lambda d: sorted((r.request_id, str(r.response_ts)) for r in d.where("request_id < 1000").collect())
    assert key(events.answered(spark.createDataFrame(asked, schema), spark.createDataFrame(told, schema))) == want
    assert key(spark.table("answered")) == want


def test_log_of_a_stream(spark, tmp_path):
    rows = [("request", f"r{i}") for i in range(5)]
    spark.createDataFrame(rows, "event_type string, request_id string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_type string, request_id string").parquet(str(tmp_path / "in"))
    q = events.append_stream(stream, str(tmp_path / "log"), str(tmp_path / "c"))
    events.finish(q)
    assert not q.isActive
    assert sorted(r.request_id for r in log.read_log(spark, str(tmp_path / "log")).collect()) == [f"r{i}" for i in range(5)]


def test_written_lines(spark, tmp_path):
    for part in (["a", "b"], ["c"]):
        log.write_lines(spark.createDataFrame([(x,) for x in part], "line string"), str(tmp_path / "text"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "text")).collect()) == ["a", "b", "c"]
