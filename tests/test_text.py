import random
import re

import pytest
from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.streaming import machine

VECTORS = [
    ("local function_name()", "1+1", 7), ("this.call()", "1+1", 5), ("this.call(arg)", "3+1", 10), ("local function my_func()", "2+3", 18),
    ("local function_name()", "1", 6), ("this.call", "1", 4), ("local function_name()", "+8", 8), ("local function_name()", "1+0.5", 13),
    ("local function my_func()", "2+1", 16), ("a b c", "1+100", 3), ("hello", "2+1", None), ("hello", "1", None), ("ab cd", "1+0.5", 4),
    ("ab cde fg", "1+0.5", 5), ("local x = 1", "1+1", 7), ("anything", "+0", 0), ("== true", "1+1", 4), ("this.call(arg)", "5+1", 14),
    ("a b", "0+1", None), ("a b", "", None), ("a b", "x", None),
]


def test_overlap_threshold(spark):
    d = spark.createDataFrame(VECTORS, "t string, s string, e int").select("t", "s", "e", T.overlap_threshold(F.col("t"), F.col("s")).alias("g"))
    assert [(r.t, r.s) for r in d.collect() if r.e != r.g] == []
    assert [(t, s) for t, s, e in VECTORS if machine.threshold(t, s) != e] == []


def fences(t):
    ls = t.split("\n")
    if len(ls) < 2:
        return t
    if ls[0].startswith("```"):
        ls = ls[1:]
        ls[0] = ls[0].lstrip(" \t\n\x0b\f\r")
    if ls and ls[-1].startswith("```"):
        ls = ls[:-1]
    return "\n".join(ls)


def overlap(t, before, after):
    ls, trim = t.split("\n"), lambda x: x.strip(" \t\n\x0b\f\r")
    b, a = ({trim(x) for x in s.split("\n")} - {""} for s in (before, after))
    start = 0
    while start < len(ls) and trim(ls[start]) in b:
        start += 1
    rest = [trim(x) for x in ls[start:]][::-1]
    skip = 0
    while skip < len(rest) and skip < 3 and rest[skip] and rest[skip] not in a and len(rest[skip].encode()) <= 2:
        skip += 1
    if skip > 2:
        skip = 0
    run = 0
    while skip + run < len(rest) and (not rest[skip + run] or rest[skip + run] in a):
        run += 1
    if skip and (skip == len(rest) or not run):
        skip = run = 0
        while run < len(rest) and (not rest[run] or rest[run] in a):
            run += 1
    end = skip + run if run else 0
    kept = ls[start : len(ls) - end]
    return t if not start and not end or not kept else "\n".join(kept)


def test_clean_up_on_random_texts(spark):
    rnd = random.Random(5)
    alphabet = ["", " ", "a", "b", "}", "é", "end;", "  a ", "```", "```x", "\tx = 1"]
    text = lambda n: "\n".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, n)))
    rows = [(text(7), text(3), text(3)) for _ in range(1500)]
    d = spark.createDataFrame(rows, "t string, b string, a string")
    d = d.select("*", T.strip_fences(F.col("t")).alias("f"), T.strip_overlap(F.col("t"), F.col("b"), F.col("a")).alias("o"), T.postprocessed(F.array("t"), F.col("b"), F.col("a"))[0].alias("p"))
    for r in d.collect():
        assert r.f == fences(r.t)
        assert r.o == overlap(r.t, r.b, r.a)
        assert r.p == overlap(fences(r.t), r.b, r.a)


def test_prefix_trim_on_random_candidates(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("ab") for _ in range(rnd.randint(0, 4)))
    rows = [([word() for _ in range(4)], word()) for _ in range(500)]
    d = spark.createDataFrame(rows, "c array<string>, t string").select("*", T.prefix_trimmed(F.col("c"), F.col("t")).alias("r"))
    assert all(r.r == machine.rests(r.c, r.t) for r in d.collect())


def test_words(spark):
    texts = ["", "  ", "foo_bar.baz(1)", "é à\tß", "== x"]
    d = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.word_spans(F.col("t")).alias("s"), T.words(F.col("t")).alias("w"))
    for r in d.collect():
        want = [(m.start() + 1, m.end()) for m in re.finditer(r"[A-Za-z0-9_À-ÿ]+|[^A-Za-z0-9_À-ÿ \t\n\x0b\f\r]+", r.t)]
        assert [tuple(x) for x in r.s] == want and r.w == [r.t[a - 1 : b] for a, b in want]


@pytest.mark.parametrize(
    ("text", "n", "want"),
    [("a\n  b\nc", 1, ("partial", "<a\n  >", "b\nc")), ("a", 1, ("full", "<a>", "")), ("a\nb", 5, ("full", "<a\nb>", "")), ("a\n\nb", 2, ("partial", "<a\n\n>", "b"))],
)
def test_accept(spark, text, n, want):
    row = spark.range(1).select(T.accepted(F.lit(text), F.lit(n), F.lit("<"), F.lit(">")).alias("a")).first().a
    assert tuple(row) == want


def test_small_ones(spark):
    x = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert x(T.hover_text(F.lit('"abc"'))) == "abc" and x(T.hover_text(F.lit('{"value": "v"}'))) == "v" and x(T.hover_text(F.lit("{"))) is None
    assert x(T.utf16_offset(F.lit("a\U0001F600b"), F.lit(2))) == 3
    assert x(T.relative_path(F.lit("/w/a.py"), F.lit("/w"))) == "a.py" and x(T.relative_path(F.lit("/x/a.py"), F.lit("/w"))) == "/x/a.py"
    assert x(T.previous_index(F.lit(1), F.lit(3))) == 3 and x(T.next_index(F.lit(3), F.lit(3))) == 1
    assert x(T.formatter_name(F.lit(None).cast("string"), F.lit("chat"))) == "chat" and x(T.formatter_alias(F.lit("codestral"))) == "fim"
