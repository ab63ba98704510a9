"""Registered queries over the supplied tables, each with the same thing in DuckDB SQL.

The tables have no buffers, cursors or syntax trees, so queries state an analogue: a document is a buffer, its
language the filetype, its middle line the cursor's; an event is a diagnostic (user = buffer) or an edit; a
conversation's messages are contexts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import fixed
from inkwell.functions import text as T
from inkwell.operators import context, merge, prompt, window
from inkwell.plans import suggest
from inkwell.registry import Registry
from inkwell.sources import log, responses
from inkwell.sources.tables import table
from inkwell.streaming import events, machine

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def q(text: str) -> str:
    """A SQL literal."""
    return "'" + text.replace("'", "''") + "'"


def md5(c: Column) -> Column:
    return F.md5(c.cast("binary"))


NL = "chr(10)"
WS = r"[ \t\n\x0B\f\r]"
KEY, OTHER = r"[A-Za-z0-9_\x{C0}-\x{FF}]", r"[^A-Za-z0-9_\x{C0}-\x{FF} \t\n\x0B\f\r]"
TRIM = "regexp_replace({}, '^" + WS + "+|" + WS + "+$', '', 'g')"

# ---------------------------------------------------------------- windows

MIDDLE = f"""
d AS (SELECT doc_id, lang, text, string_split(text, {NL}) ls FROM documents),
m AS (SELECT *, len(ls) // 2 AS line, length(ls[len(ls) // 2 + 1]) // 2 AS col FROM d),
w AS (SELECT *,
  array_to_string(list_concat(list_slice(ls, greatest(line - 50, 0) + 1, line), [substring(ls[line + 1], 1, col)]), {NL}) AS before,
  array_to_string(list_concat([substring(ls[line + 1], col + 1)], list_slice(ls, line + 2, line + 51)), {NL}) AS after,
  array_to_string(list_concat([substring(ls[line + 1], col + 1)], list_slice(ls, line + 2, line + 50)), {NL}) AS popup_after
FROM m)"""


def middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "text", T.lines(F.col("text")).alias("ls"))
    d = d.withColumn("line", F.floor(F.size("ls") / 2).cast("int"))
    return d.withColumn("col", F.floor(F.length(F.get("ls", "line")) / 2).cast("int"))


@query(f"SELECT doc_id, CAST(i - 1 AS INT) AS line_no, ls[i] AS line FROM (SELECT doc_id, string_split(text, {NL}) ls FROM documents) d, LATERAL (SELECT unnest(range(1, len(d.ls) + 1)) AS i) t")
def line_scan(spark, sf_dir):
    return window.exploded(table(spark, sf_dir, "documents"))


@query(f"WITH {MIDDLE} SELECT doc_id, before AS lines_before, after AS lines_after FROM w")
def context_window(spark, sf_dir):
    return middle(spark, sf_dir).select("doc_id", window.line_window(F.col("text"), F.col("line"), F.col("col")).alias("w")).select("doc_id", "w.*")


@query(f"WITH {MIDDLE} SELECT doc_id, before AS lines_before, popup_after AS lines_after FROM w")
def popup_window(spark, sf_dir):
    return middle(spark, sf_dir).select("doc_id", window.popup_window(F.col("text"), F.col("line"), F.col("col")).alias("w")).select("doc_id", "w.*")


@query(
    f"""WITH l AS (SELECT doc_id, CAST(i - 1 AS INT) AS line_no, ls[i] AS line FROM (SELECT doc_id, string_split(text, {NL}) ls FROM documents) d, LATERAL (SELECT unnest(range(1, len(d.ls) + 1)) AS i) t)
SELECT doc_id, line_no, md5(coalesce(string_agg(line, {NL}) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '')) AS before,
  md5(coalesce(string_agg(line, {NL}) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), '')) AS after FROM l"""
)
def row_frame_window(spark, sf_dir):
    rows = window.line_frames(window.exploded(table(spark, sf_dir, "documents")), "doc_id", 2, 2)
    return rows.select("doc_id", "line_no", md5(F.col("before")).alias("before"), md5(F.col("after")).alias("after"))


@query(
    f"""WITH {MIDDLE}, s AS (SELECT *, CASE doc_id % 4 WHEN 0 THEN 'init' WHEN 1 THEN 'impl' WHEN 2 THEN 'comment_func' ELSE 'unknown' END AS kind,
  line - CAST(doc_id % 13 AS INT) AS a0, line + 6 AS b FROM m), r AS (SELECT *, greatest(a0, 0) AS a FROM s),
x AS (SELECT *, CASE WHEN kind = 'init' THEN 0 WHEN kind = 'comment_func' OR kind = 'impl' AND line - a >= 5 AND b - line >= 5 THEN a ELSE greatest(line - 50, 0) END AS f,
  CASE WHEN kind = 'init' THEN len(ls) WHEN kind = 'comment_func' OR kind = 'impl' AND line - a >= 5 AND b - line >= 5 THEN b + 1 ELSE line + 51 END AS t FROM r)
SELECT doc_id, kind, md5(array_to_string(list_concat(list_slice(ls, f + 1, line), [substring(ls[line + 1], 1, col)]), {NL})) AS before,
  md5(array_to_string(list_concat([substring(ls[line + 1], col + 1)], list_slice(ls, line + 2, t)), {NL})) AS after FROM x"""
)
def smart_window(spark, sf_dir):
    d = middle(spark, sf_dir).withColumn("kind", F.element_at(F.array(*map(F.lit, ("init", "impl", "comment_func", "unknown"))), (F.col("doc_id") % 4 + 1).cast("int")))
    first = F.greatest(F.col("line") - (F.col("doc_id") % 13).cast("int"), F.lit(0))
    d = d.withColumn("inner", F.struct(first.alias("first"), (F.col("line") + 6).alias("last")))
    w = window.smart_window(F.col("text"), F.col("line"), F.col("col"), F.col("kind"), F.col("inner"))
    return d.select("doc_id", "kind", w.alias("w")).select("doc_id", "kind", md5(F.col("w.lines_before")).alias("before"), md5(F.col("w.lines_after")).alias("after"))


@query(
    f"""WITH l AS (SELECT doc_id, CAST(i - 1 AS INT) AS line_no, ls[i] AS line FROM (SELECT doc_id, string_split(text, {NL}) ls FROM documents) d, LATERAL (SELECT unnest(range(1, len(d.ls) + 1)) AS i) t)
SELECT doc_id, line_no, last_value(CASE WHEN regexp_matches(line, '^(The|De|La|Und) ') THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 10 PRECEDING AND CURRENT ROW) AS declaration FROM l"""
)
def declaration_lookback(spark, sf_dir):
    rows = window.declarations(window.exploded(table(spark, sf_dir, "documents")), "doc_id", "^(The|De|La|Und) ")
    return rows.select("doc_id", "line_no", "declaration")


@query(
    """WITH r AS (SELECT user_id, min(CASE WHEN event_type = 'click' THEN k END) AS a1, max(CASE WHEN event_type = 'click' THEN k END) AS a2,
  min(CASE WHEN event_type = 'error' THEN k END) AS b1, max(CASE WHEN event_type = 'error' THEN k END) AS b2
  FROM (SELECT user_id, event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events) GROUP BY user_id)
SELECT user_id, CASE WHEN a1 IS NULL THEN b1 WHEN b1 IS NULL THEN a1 ELSE least(a1, b1) END AS first, CASE WHEN a2 IS NULL THEN b2 WHEN b2 IS NULL THEN a2 ELSE greatest(a2, b2) END AS last FROM r"""
)
def range_union(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
    span = lambda kind: F.when(F.max(F.when(F.col("event_type") == kind, F.col("k"))).isNotNull(), F.struct(F.min(F.when(F.col("event_type") == kind, F.col("k"))).alias("first"), F.max(F.when(F.col("event_type") == kind, F.col("k"))).alias("last")))
    r = e.groupBy("user_id").agg(span("click").alias("a"), span("error").alias("b"))
    return r.select("user_id", window.range_union(F.col("a"), F.col("b")).alias("u")).select("user_id", "u.first", "u.last")


# ---------------------------------------------------------------- prompts and bodies

CONTEXT = "CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'lang: ' || lang END"


def with_context(d: DataFrame) -> DataFrame:
    ctx = F.when(F.col("doc_id") % 3 == 0, None).when(F.col("doc_id") % 3 == 1, "").otherwise(F.concat(F.lit("lang: "), F.col("lang")))
    d = d.withColumn("w", window.line_window(F.col("text"), F.col("line"), F.col("col")))
    return d.select("doc_id", "lang", "ls", ctx.alias("ctx"), F.col("w.lines_before").alias("before"), F.col("w.lines_after").alias("after"))


@query(f"WITH {MIDDLE}, c AS (SELECT *, {CONTEXT} AS ctx FROM w) SELECT doc_id, 'fim' AS mode, md5(CASE WHEN ctx IS NULL THEN before ELSE ctx || {NL} || before END) AS prefix, md5(after) AS suffix FROM c")
def fim_prompt(spark, sf_dir):
    p = prompt.fim(F.col("before"), F.col("after"), F.col("ctx"))
    return with_context(middle(spark, sf_dir)).select("doc_id", p.alias("p")).select("doc_id", "p.mode", md5(F.col("p.prefix")).alias("prefix"), md5(F.col("p.suffix")).alias("suffix"))


SYSTEM = f"{q(fixed.CHAT_SYSTEM_1)} || lang || {q(fixed.CHAT_SYSTEM_2)} || lang || {q(fixed.CHAT_SYSTEM_3)} || CASE WHEN ctx <> '' THEN {q(fixed.CHAT_CONTEXT)} || ctx ELSE '' END"


@query(
    f"""WITH {MIDDLE}, c AS (SELECT *, {CONTEXT} AS ctx FROM w)
SELECT doc_id, 'chat' AS mode, CAST(CASE WHEN doc_id % 2 = 0 THEN 4 ELSE 2 END AS BIGINT) AS n_messages, {SYSTEM} AS system,
  md5({q(fixed.PREFIX_OPEN)} || before || {q(fixed.PREFIX_CLOSE + fixed.SUFFIX_OPEN)} || after || {q(fixed.SUFFIX_CLOSE + fixed.MIDDLE_OPEN)}) AS "user",
  CASE WHEN doc_id % 2 = 0 THEN 'assistant:' || ls[1] || '|user:' || {q(fixed.REJECTED_REPLY)} ELSE '' END AS history FROM c"""
)
def chat_prompt(spark, sf_dir):
    rejected = F.when(F.col("doc_id") % 2 == 0, F.array(F.get("ls", F.lit(0))))
    d = with_context(middle(spark, sf_dir)).withColumn("p", prompt.chat(F.col("before"), F.col("after"), F.col("lang"), F.col("ctx"), rejected))
    m = F.col("p.messages")
    history = F.array_join(F.transform(F.slice(m, 3, 100), lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "|")
    return d.select("doc_id", "p.mode", F.size(m).cast("long").alias("n_messages"), F.get(m, F.lit(0))["content"].alias("system"), md5(F.get(m, F.lit(1))["content"]).alias("user"), history.alias("history"))


@query("""SELECT conv_id, arg_max(text, turn) FILTER (WHERE role = 'system') AS system, CAST(count(*) FILTER (WHERE role <> 'system') AS BIGINT) AS n_messages,
  coalesce(string_agg(role || ': ' || text, chr(10) ORDER BY turn) FILTER (WHERE role <> 'system'), '') AS messages FROM conversations GROUP BY conv_id""")
def chat_messages(spark, sf_dir):
    m = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(m.alias("m"))
    system, rest = prompt.split_system(F.col("m"))
    return c.select("conv_id", system.alias("system"), F.size(rest).cast("long").alias("n_messages"), F.array_join(F.transform(rest, lambda x: F.concat(x["role"], F.lit(": "), x["content"])), "\n").alias("messages"))


JS = "to_json({})"


@query(
    f"""WITH {MIDDLE} SELECT doc_id, CASE WHEN doc_id % 2 = 0
  THEN json_extract_string(json_object('messages', [{{'role': 'user', 'content': before}}]), '$.messages[0].content') ELSE before END AS sent,
  CASE WHEN doc_id % 2 = 0 THEN NULL ELSE after END AS suffix, 'm' AS model, CASE WHEN doc_id % 2 = 0 THEN 'be brief' ELSE {q(fixed.FIM_SYSTEM)} END AS system,
  CASE WHEN doc_id % 2 = 0 THEN before ELSE {q(fixed.FIM_USER_1)} || before || {q(fixed.FIM_USER_2)} || after END AS asked FROM w"""
)
def request_bodies(spark, sf_dir):
    d = with_context(middle(spark, sf_dir))
    chat = F.struct(F.lit("chat").alias("mode"), F.array(prompt.message("system", F.lit("be brief")), prompt.message("user", F.col("before"))).cast(prompt.MESSAGES).alias("messages"), F.lit(None).cast("string").alias("prefix"), F.lit(None).cast("string").alias("suffix"))
    d = d.withColumn("p", F.when(F.col("doc_id") % 2 == 0, chat.cast(prompt.PROMPT)).otherwise(prompt.fim(F.col("before"), F.col("after")).cast(prompt.PROMPT)))
    d = d.select("doc_id", responses.chat_body(F.col("p"), F.lit("m"), 0.1, 1).alias("c"), responses.blocks_body(F.col("p"), F.lit("m"), 512).alias("b"))
    j = lambda c, path: F.get_json_object(c, path)
    return d.select("doc_id", F.coalesce(j("c", "$.messages[1].content"), j("c", "$.prompt")).alias("sent"), j("c", "$.suffix").alias("suffix"), j("b", "$.model").alias("model"), j("b", "$.system").alias("system"), j("b", "$.messages[0].content").alias("asked"))


def conversation_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("t"))


@query("SELECT conv_id, turn, CAST(CASE WHEN turn % 4 = 3 THEN NULL WHEN turn % 4 = 2 THEN 1 ELSE 2 END AS INT) AS n, CASE turn % 4 WHEN 0 THEN text || '|x' WHEN 1 THEN 'y|' || text WHEN 2 THEN text END AS joined FROM conversations")
def decode_chat(spark, sf_dir):
    d = conversation_bodies(spark, sf_dir)
    t = F.col("t")
    msg = lambda c: F.struct(F.struct(c.alias("content")).alias("message"), F.lit(None).cast("string").alias("text"))
    plain = lambda c: F.struct(F.struct(F.lit(None).cast("string").alias("content")).alias("message"), c.alias("text"))
    body = F.when(F.col("turn") % 4 == 0, F.to_json(F.struct(F.array(msg(t), plain(F.lit("x"))).alias("choices")))).when(F.col("turn") % 4 == 1, F.to_json(F.struct(F.array(plain(F.lit("y")), msg(t)).alias("choices")))).when(F.col("turn") % 4 == 2, F.to_json(F.struct(F.array(plain(F.lit(None).cast("string")), plain(t)).alias("choices")))).otherwise(F.lit('{"error": "no"}'))
    d = d.select("conv_id", "turn", responses.from_choices(body).alias("c"))
    return d.select("conv_id", "turn", F.when(F.col("c").isNotNull(), F.size("c")).alias("n"), F.array_join("c", "|").alias("joined"))


@query("SELECT conv_id, turn, CAST(CASE WHEN turn % 2 = 0 THEN 2 ELSE 1 END AS INT) AS n, CASE WHEN turn % 2 = 0 THEN text || '|tail' ELSE text END AS joined FROM conversations")
def decode_blocks(spark, sf_dir):
    d = conversation_bodies(spark, sf_dir)
    block = lambda kind, c: F.struct(F.lit(kind).alias("type"), c.alias("text"))
    tail = F.when(F.col("turn") % 2 == 0, F.lit("tail"))
    body = F.to_json(F.struct(F.array(block("text", F.col("t")), block("tool", tail)).alias("content")))
    d = d.select("conv_id", "turn", responses.from_blocks(body).alias("c"))
    return d.select("conv_id", "turn", F.size("c").alias("n"), F.array_join("c", "|").alias("joined"))


@query("SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN 'a' || text END AS completion FROM conversations")
def decode_generate(spark, sf_dir):
    d = conversation_bodies(spark, sf_dir)
    k = F.col("turn") % 3
    body = F.when(k == 0, F.to_json(F.struct(F.struct(F.concat("t", F.lit("<EOT>")).alias("content")).alias("message")))).when(k == 1, F.to_json(F.struct(F.concat(F.lit("a<EOT>"), "t", F.lit("<EOT>")).alias("response")))).otherwise(F.lit('{"done": true}'))
    return d.select("conv_id", "turn", F.get(responses.from_generate(body), F.lit(0)).alias("completion"))


@query("SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN 'v' || text END AS hover FROM conversations")
def hover_contents(spark, sf_dir):
    d, k = conversation_bodies(spark, sf_dir), F.col("turn") % 3
    body = F.when(k == 0, F.get_json_object(F.to_json(F.struct(F.array("t").alias("a"))), "$.a")).when(k == 1, F.to_json(F.struct(F.concat(F.lit("v"), "t").alias("value"))))
    body = F.when(k == 0, F.regexp_replace(body, r"(?s)^\[(.*)\]$", "$1")).otherwise(body)
    return d.select("conv_id", "turn", T.hover_text(body).alias("hover"))


# ---------------------------------------------------------------- clean-up of completions

FENCED = "CASE doc_id % 4 WHEN 0 THEN '```lua' || chr(10) || '  ' || text || chr(10) || '```' WHEN 1 THEN '```' || chr(10) || text WHEN 2 THEN text || chr(10) || '```' || chr(10) ELSE text END"


@query(
    f"""WITH f AS (SELECT doc_id, {FENCED} AS t FROM documents), l AS (SELECT *, string_split(t, {NL}) AS ls FROM f),
o AS (SELECT *, CASE WHEN starts_with(ls[1], '```') THEN list_concat([regexp_replace(ls[2], '^{WS}+', '')], list_slice(ls, 3, len(ls))) ELSE ls END AS b FROM l)
SELECT doc_id, md5(CASE WHEN len(ls) < 2 THEN t WHEN starts_with(b[len(b)], '```') THEN array_to_string(list_slice(b, 1, len(b) - 1), {NL}) ELSE array_to_string(b, {NL}) END) AS stripped FROM o"""
)
def strip_fences(spark, sf_dir):
    k, t, nl = F.col("doc_id") % 4, F.col("text"), F.lit("\n")
    fenced = F.when(k == 0, F.concat(F.lit("```lua\n  "), t, F.lit("\n```"))).when(k == 1, F.concat(F.lit("```\n"), t)).when(k == 2, F.concat(t, nl, F.lit("```"), nl)).otherwise(t)
    d = table(spark, sf_dir, "documents").select("doc_id", fenced.alias("t"))
    return d.select("doc_id", md5(T.strip_fences(F.col("t"))).alias("stripped"))


@query(
    f"""WITH d AS (SELECT doc_id, text, string_split(text, {NL}) AS ls FROM documents),
t AS (SELECT *, list_transform(ls, lambda x: {TRIM.format("x")}) AS ts FROM d),
s AS (SELECT *, list_filter(list_slice(ts, 1, 2), lambda x: x <> '') AS b, list_filter(list_slice(ts, greatest(len(ts) - 1, 1), len(ts)), lambda x: x <> '') AS a FROM t),
k AS (SELECT *, length(regexp_extract(array_to_string(list_transform(ts, lambda x: CASE WHEN x <> '' AND list_contains(b, x) THEN 'B' ELSE '-' END), ''), '^B+')) AS st FROM s),
e AS (SELECT *, length(regexp_extract(array_to_string(list_transform(list_reverse(list_slice(ts, st + 1, len(ts))), lambda x: CASE WHEN x = '' OR list_contains(a, x) THEN 'S' WHEN strlen(x) <= 2 THEN 'T' ELSE 'L' END), ''), '^T{{0,2}}S+')) AS en FROM k)
SELECT doc_id, md5(CASE WHEN st = 0 AND en = 0 OR len(ls) - st - en <= 0 THEN text ELSE array_to_string(list_slice(ls, st + 1, len(ls) - en), {NL}) END) AS stripped FROM e"""
)
def strip_overlap(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", T.lines(F.col("text")).alias("ls"))
    d = d.select("doc_id", "text", T.joined(F.slice("ls", 1, 2)).alias("before"), T.joined(F.slice("ls", F.greatest(F.size("ls") - 1, F.lit(1)), F.lit(2))).alias("after"))
    return d.select("doc_id", md5(T.strip_overlap(F.col("text"), F.col("before"), F.col("after"))).alias("stripped"))


@query(f"SELECT doc_id, CAST(len(regexp_extract_all(text, '({KEY}+|{OTHER}+)')) AS BIGINT) AS n_words FROM documents")
def word_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.words(F.col("text"))).cast("long").alias("n_words"))


SPANS = f"""r AS (SELECT *, regexp_extract_all(text, '({KEY}+|{OTHER}+|{WS}+)') AS rs FROM b),
e AS (SELECT *, list_transform(range(1, len(rs) + 1), lambda i: CAST(list_sum(list_transform(list_slice(rs, 1, i), lambda x: length(x))) AS INT)) AS ends FROM r),
s AS (SELECT *, list_filter(list_transform(range(1, len(rs) + 1), lambda i: {{'first': ends[i] - length(rs[i]) + 1, 'last': ends[i], 'w': NOT regexp_matches(rs[i], '^{WS}')}}), lambda x: x.w) AS sp FROM e)"""


@query(f"WITH b AS (SELECT item_id, text FROM benchmark), {SPANS} SELECT item_id, CAST(i AS INT) AS word_no, CAST(sp[i].first AS INT) AS first, CAST(sp[i].last AS INT) AS last, CAST(CASE WHEN regexp_matches(substring(text, sp[i].first, 1), '^{KEY}') THEN 1 ELSE 2 END AS INT) AS class FROM s, LATERAL (SELECT unnest(range(1, len(s.sp) + 1)) AS i) t")
def word_spans(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", "text", F.posexplode(T.word_spans(F.col("text"))).alias("n", "s"))
    return b.select("item_id", (F.col("n") + 1).alias("word_no"), "s.first", "s.last", T.char_class(F.substring("text", F.col("s.first"), F.lit(1))).alias("class"))


SPECS = ("1+1", "2+3", "1", "+8", "1+0.5", "3")


@query(
    f"""WITH b AS (SELECT item_id, text, ['1+1', '2+3', '1', '+8', '1+0.5', '3'][item_id % 6 + 1] AS spec FROM benchmark), {SPANS},
p AS (SELECT *, TRY_CAST(nullif(regexp_extract(spec, '^([0-9]+)([+].*)?$', 1), '') AS INT) AS n, TRY_CAST(nullif(regexp_extract(spec, '^[0-9]*[+]([0-9]*[.]?[0-9]+)$', 1), '') AS DOUBLE) AS m FROM s),
x AS (SELECT *, sp[n + 1].first AS nf, sp[n + 1].last - sp[n + 1].first + 1 AS nl FROM p)
SELECT item_id, spec, CAST(CASE WHEN n IS NULL THEN floor(m) WHEN len(sp) < n THEN NULL
  WHEN m IS NULL THEN CASE WHEN len(sp) > n THEN nf - 1 WHEN sp[n].last < length(text) THEN length(text) END
  WHEN len(sp) > n THEN nf - 1 + CASE WHEN m > 0 AND m < 1 THEN ceil(m * nl) ELSE least(floor(m), nl) END END AS INT) AS threshold FROM x"""
)
def overlap_threshold(spark, sf_dir):
    spec = F.element_at(F.array(*map(F.lit, SPECS)), (F.col("item_id") % 6 + 1).cast("int"))
    b = table(spark, sf_dir, "benchmark").select("item_id", "text", spec.alias("spec"))
    return b.select("item_id", "spec", T.overlap_threshold(F.col("text"), F.col("spec")).alias("threshold"))


@query(
    """WITH b AS (SELECT item_id, [text, replace(text, 'e', 'E'), 'x' || text, left(text, 5)] AS c, left(text, CAST(item_id % 7 AS INT)) AS typed FROM benchmark),
k AS (SELECT *, list_filter(list_transform(list_filter(c, lambda x: starts_with(x, typed)), lambda x: substring(x, length(typed) + 1)), lambda x: x <> '') AS r FROM b)
SELECT item_id, CAST(len(r) AS INT) AS n, array_to_string(r, '|') AS left_over FROM k"""
)
def prefix_trim(spark, sf_dir):
    t = F.col("text")
    b = table(spark, sf_dir, "benchmark").select("item_id", F.array(t, F.replace(t, F.lit("e"), F.lit("E")), F.concat(F.lit("x"), t), F.substring(t, 1, 5)).alias("c"), F.substring(t, F.lit(1), (F.col("item_id") % 7).cast("int")).alias("typed"))
    b = b.select("item_id", T.prefix_trimmed(F.col("c"), F.col("typed")).alias("r"))
    return b.select("item_id", F.size("r").alias("n"), F.array_join("r", "|").alias("left_over"))


@query("SELECT item_id, CASE WHEN item_id % 3 = 0 THEN NULL ELSE substring(text, CAST(item_id % 5 AS INT) + 1) END AS rest FROM benchmark")
def type_through(spark, sf_dir):
    typed = F.concat(F.substring("text", F.lit(1), (F.col("item_id") % 5).cast("int")), F.when(F.col("item_id") % 3 == 0, F.lit("\x00")).otherwise(""))
    return table(spark, sf_dir, "benchmark").select("item_id", T.typed_through(F.col("text"), typed).alias("rest"))


@query("SELECT item_id, CASE WHEN item_id % 4 = 0 OR item_id % 9 < item_id % 5 THEN NULL ELSE substring(text, CAST(item_id % 5 AS INT) + 1, CAST(item_id % 9 - item_id % 5 AS INT)) END AS typed FROM benchmark")
def typed_since(spark, sf_dir):
    i = F.col("item_id")
    return table(spark, sf_dir, "benchmark").select("item_id", T.typed_since(i % 4 != 0, F.col("text"), (i % 5).cast("int"), (i % 9).cast("int")).alias("typed"))


ACCEPT = f"""l AS (SELECT *, string_split(c, {NL}) AS ls FROM c0), i AS (SELECT *, regexp_extract(ls[n + 1], '^{WS}*') AS ind FROM l),
o AS (SELECT *, n >= len(ls) AS allin FROM i)
SELECT doc_id, CASE WHEN allin THEN 'full' ELSE 'partial' END AS kind,
  md5(CASE WHEN allin THEN '<' || c || '>' ELSE array_to_string(list_concat(list_concat(['<' || ls[1]], list_slice(ls, 2, n)), [ind || '>']), {NL}) END) AS inserted,
  md5(CASE WHEN allin THEN '' ELSE array_to_string(list_concat([substring(ls[n + 1], length(ind) + 1)], list_slice(ls, n + 2, len(ls))), {NL}) END) AS remaining FROM o"""


def accepted(d: DataFrame) -> DataFrame:
    a = T.accepted(F.col("c"), F.col("n"), F.lit("<"), F.lit(">"))
    return d.withColumn("a", a).select("doc_id", "a.kind", md5(F.col("a.inserted")).alias("inserted"), md5(F.col("a.remaining")).alias("remaining"))


@query(f"WITH c0 AS (SELECT doc_id, replace(text, {NL}, {NL} || '  ') AS c, CAST(doc_id % 4 + 1 AS INT) AS n FROM documents), {ACCEPT}")
def accept_lines(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n  ")).alias("c"), (F.col("doc_id") % 4 + 1).cast("int").alias("n"))
    return accepted(d)


@query(
    f"""WITH t0 AS (SELECT doc_id, replace(text, '.' || {NL}, '.' || {NL} || ' ' || {NL}) AS c FROM documents), t1 AS (SELECT *, string_split(c, {NL}) AS bl FROM t0),
c0 AS (SELECT doc_id, c, CAST(coalesce(nullif(list_position(list_transform(bl, lambda x: NOT regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')), true), 0), len(bl)) AS INT) AS n FROM t1), {ACCEPT}"""
)
def accept_paragraph(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit(".\n"), F.lit(".\n \n")).alias("c"))
    return accepted(d.withColumn("n", T.paragraph_lines(F.col("c"))))


@query("SELECT conv_id, turn, (turn % 5) % 5 + 1 AS next, ((turn % 5 - 2) % 5 + 5) % 5 + 1 AS previous FROM conversations")
def cycle_index(spark, sf_dir):
    i, n = F.col("turn") % 5, F.lit(5).cast("long")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.next_index(i, n).alias("next"), T.previous_index(i, n).alias("previous"))


@query("SELECT doc_id, CAST(length(text) + len(regexp_extract_all(text, '[\\x{10000}-\\x{10FFFF}]')) AS INT) AS units, CAST(strlen(text) AS INT) AS bytes FROM documents")
def utf16_offsets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.utf16_offset(F.col("text"), F.length("text")).alias("units"), F.octet_length("text").alias("bytes"))


@query("SELECT o_orderkey, CASE WHEN coalesce(m, c, 'fim') IN ('chat', 'fim') THEN coalesce(m, c, 'fim') ELSE 'fim' END AS formatter, CASE a WHEN 'chat' THEN 'chat' WHEN 'fim' THEN 'fim' WHEN 'general_ai' THEN 'chat' WHEN 'santacoder' THEN 'fim' END AS alias FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'chat' WHEN 1 THEN 'other' END AS m, CASE o_orderkey % 2 WHEN 0 THEN 'chat' END AS c, ['chat', 'fim', 'general_ai', 'santacoder', 'unheard'][o_orderkey % 5 + 1] AS a FROM orders) t")
def formatter_choice(spark, sf_dir):
    k = F.col("o_orderkey")
    m, c = F.when(k % 3 == 0, "chat").when(k % 3 == 1, "other"), F.when(k % 2 == 0, "chat")
    a = F.element_at(F.array(*map(F.lit, ("chat", "fim", "general_ai", "santacoder", "unheard"))), (k % 5 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.formatter_name(m, c).alias("formatter"), T.formatter_alias(a).alias("alias"))


# ---------------------------------------------------------------- context sources


@query(
    f"""WITH u AS (SELECT * FROM documents WHERE text <> ''), f AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM u),
p AS (SELECT c.doc_id AS cur, f.doc_id, array_to_string(list_slice(string_split(f.text, {NL}), 1, 10), {NL}) AS head, row_number() OVER (PARTITION BY c.doc_id ORDER BY f.doc_id) AS k
  FROM documents c JOIN f ON f.lang = c.lang AND f.doc_id <> c.doc_id WHERE f.r <= 4),
g AS (SELECT cur, count(*) AS n, string_agg(head, {NL} || {NL} ORDER BY doc_id) AS t FROM p WHERE k <= 3 GROUP BY cur)
SELECT c.doc_id AS id, coalesce(n, 0) AS n_buffers, CASE WHEN n > 0 THEN {q(fixed.BUFFERS_HEADER)} || t ELSE '' END AS content FROM documents c LEFT JOIN g ON g.cur = c.doc_id"""
)
def neighbour_buffers(spark, sf_dir):
    return context.neighbours(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("filetype"), "text"), F.lit(True))


@query(
    f"""WITH b AS (SELECT doc_id, lang, text, source || '/' || doc_id AS name FROM documents WHERE doc_id % 2 = 0 AND doc_id % 3 <> 0 AND text <> '' AND source <> ''),
p AS (SELECT d.doc_id AS cur, b.doc_id, {q(fixed.BUFFER_NAME)} || name || {NL} || {NL} || array_to_string(list_slice(string_split(b.text, {NL}), 1, 10), {NL}) AS part FROM documents d JOIN
  (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM b) b ON b.lang = d.lang AND b.doc_id <> d.doc_id AND b.r <= 4),
g AS (SELECT cur, count(*) AS n, string_agg(part, {NL} || {NL} ORDER BY doc_id) AS t FROM (SELECT *, row_number() OVER (PARTITION BY cur ORDER BY doc_id) AS k FROM p) x WHERE k <= 3 GROUP BY cur)
SELECT d.doc_id AS id, coalesce(n, 0) AS n_buffers, CASE WHEN n > 0 THEN {q(fixed.BUFFERS_HEADER)} || t ELSE '' END AS content FROM documents d LEFT JOIN g ON g.cur = d.doc_id"""
)
def named_neighbours(spark, sf_dir):
    k = F.col("doc_id")
    name = T.relative_path(F.concat(F.lit("/w/"), "source", F.lit("/"), k.cast("string")), F.lit("/w"))
    b = table(spark, sf_dir, "documents").select(k.alias("id"), F.col("lang").alias("filetype"), "text", (k % 2 == 0).alias("loaded"), (k % 3 != 0).alias("listed"), F.when(F.col("source") != "", name).alias("name"))
    return context.neighbours(b, F.lit(True))


DIAG = "SELECT user_id AS buffer, event_id AS id, CAST(json_extract_string(props, '$.k') AS INT) AS lnum, CASE event_type WHEN 'error' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 3 WHEN 'signup' THEN 4 ELSE 9 END AS severity, event_type AS message FROM events"


def diagnostic_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    severity = F.when(kind == "error", 1).when(kind == "click", 2).when(kind == "view", 3).when(kind == "signup", 4).otherwise(9)
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("buffer"), F.col("event_id").alias("id"), F.get_json_object("props", "$.k").cast("int").alias("lnum"), severity.alias("severity"), kind.alias("message"))


@query(
    f"""WITH d AS ({DIAG}), n AS (SELECT *, CAST(buffer % 100 AS INT) AS cursor FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY buffer ORDER BY severity, lnum <> cursor, id) AS rank FROM n WHERE lnum BETWEEN greatest(cursor - 10, 0) AND cursor + 10)
SELECT buffer, count(*) AS n, {q(fixed.DIAGNOSTICS_HEADER)} || string_agg('[' || coalesce(['ERROR', 'WARN', 'INFO', 'HINT'][severity], 'INFO') || '] Line ' || (lnum + 1) || ': ' || message, chr(10) ORDER BY rank) AS content FROM r WHERE rank <= 3 GROUP BY buffer"""
)
def diagnostics_topk(spark, sf_dir):
    return context.diagnostics(diagnostic_rows(spark, sf_dir), (F.col("buffer") % 100).cast("int"))


@query(
    """SELECT event_id, CASE event_type WHEN 'error' THEN 'E' ELSE '' END || CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN chr(10) || chr(10) ELSE '' END || CASE WHEN event_id % 2 = 0 THEN 'H' ELSE '' END AS content,
  event_type = 'error' AS has_diagnostics, event_id % 2 = 0 AS has_hover FROM events"""
)
def diagnostics_content(spark, sf_dir):
    c = context.diagnostics_content(F.when(F.col("event_type") == "error", "E").otherwise(""), F.lit(""), F.when(F.col("event_id") % 2 == 0, "H"))
    return table(spark, sf_dir, "events").select("event_id", c.alias("c")).select("event_id", "c.*")


@query("SELECT event_id, '[' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '] [' || CASE event_type WHEN 'error' THEN 'ERROR' ELSE 'WARN' END || '] ' || event_type || ' ' || user_id AS entry FROM events WHERE event_type IN ('error', 'click')")
def log_level_filter(spark, sf_dir):
    kind = F.col("event_type")
    level = F.when(kind == "error", "ERROR").when(kind == "click", "WARN").when(kind == "view", "INFO").otherwise("DEBUG")
    e = table(spark, sf_dir, "events").withColumn("level", level).where(T.level_number(F.col("level")) >= fixed.LOG_LEVELS["WARN"])
    return e.select("event_id", T.log_line(F.col("ts"), F.col("level"), F.concat_ws(" ", "event_type", F.col("user_id").cast("string"))).alias("entry"))


TOKENS = "SELECT doc_id, lang AS filetype, i AS visit, ws[i] AS name FROM (SELECT doc_id, lang, regexp_extract_all(text, '([A-Za-z_]+)') AS ws FROM documents) d, LATERAL (SELECT unnest(range(1, len(d.ws) + 1)) AS i) t"


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = F.regexp_extract_all("text", F.lit("([A-Za-z_]+)"), F.lit(1))
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("filetype"), F.posexplode(ws).alias("visit", "name"))
    return d.withColumn("visit", (F.col("visit") + 1).cast("long"))


@query(f"WITH t AS ({TOKENS}), f AS (SELECT doc_id, name, min(visit) AS visit FROM t GROUP BY ALL) SELECT doc_id, count(*) AS n_names, CAST(sum(visit) AS BIGINT) AS sum_visit, max(name) AS last_name FROM f GROUP BY doc_id")
def identifiers_distinct(spark, sf_dir):
    f = context.first_of_each(tokens(spark, sf_dir).select("doc_id", "name", "visit"), ["doc_id", "name"], "visit")
    return f.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_names"), F.sum("visit").alias("sum_visit"), F.max("name").alias("last_name"))


RESERVED = [(None, "a"), (None, "I"), ("en", "the"), ("en", "of"), ("fr", "de"), ("fr", "la"), ("de", "der"), ("de", "die"), ("es", "de"), ("es", "que")]


@query(f"WITH t AS ({TOKENS}), r(filetype, name) AS (VALUES {', '.join(f'({q(a) if a else chr(78) + chr(85) + chr(76) + chr(76)}, {q(b)})' for a, b in RESERVED)}) SELECT doc_id, count(*) AS n FROM t WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.name = t.name AND (r.filetype IS NULL OR r.filetype = t.filetype)) GROUP BY doc_id")
def reserved_anti(spark, sf_dir):
    r = spark.createDataFrame(RESERVED, "filetype string, name string")
    return context.without_reserved(tokens(spark, sf_dir), r).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey AS id, CASE WHEN s_name IS NOT NULL THEN 'definition' WHEN c_name IS NOT NULL THEN 'type' WHEN p_name IS NOT NULL THEN 'implementation' END AS source, coalesce(s_name, c_name, p_name) AS value FROM orders LEFT JOIN supplier ON s_suppkey = o_orderkey LEFT JOIN customer ON c_custkey = o_orderkey LEFT JOIN part ON p_partkey = o_orderkey")
def definition_coalesce(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    get = lambda t, k, v: table(spark, sf_dir, t).select(F.col(k).alias("id"), F.col(v).alias("value"))
    return context.coalesced(keys, "id", [("definition", get("supplier", "s_suppkey", "s_name")), ("type", get("customer", "c_custkey", "c_name")), ("implementation", get("part", "p_partkey", "p_name"))])


RESOLVED = """SELECT o_custkey AS request, o_orderkey AS visit, o_orderpriority AS name, '/w/' || (o_custkey % 3) || '/' || o_orderstatus AS path, CAST(o_orderkey % 7 * 30 AS INT) AS start_line,
  CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'code ' || o_orderkey END AS code, '/w/0/O' AS current_path, 60 AS cursor FROM orders"""


@query(
    f"""WITH v AS ({RESOLVED}), o AS (SELECT *, row_number() OVER (PARTITION BY request, path, start_line ORDER BY visit) AS k FROM v),
w AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY visit) AS r FROM o WHERE k = 1 AND NOT (path = current_path AND start_line BETWEEN cursor - 50 AND cursor + 50) AND code <> '')
SELECT request, count(*) AS n, {q(fixed.DEFINITIONS_HEADER)} || chr(10) || string_agg('-- definition: ' || name || ' (' || CASE WHEN starts_with(path, '/w') THEN substring(path, 4) ELSE path END || ':' || start_line || ')' || chr(10) || code, chr(10) ORDER BY r) AS content FROM w WHERE r <= 5 GROUP BY request"""
)
def definitions_limited(spark, sf_dir):
    k = F.col("o_orderkey")
    v = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("request"), k.alias("visit"), F.col("o_orderpriority").alias("name"), F.concat(F.lit("/w/"), (F.col("o_custkey") % 3).cast("string"), F.lit("/"), "o_orderstatus").alias("path"),
        (k % 7 * 30).cast("int").alias("start_line"), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("code "), k.cast("string"))).alias("code"), F.lit("/w/0/O").alias("current_path"), F.lit(60).alias("cursor"), F.lit("/w").alias("cwd"),
    )
    return context.definitions(v)


LINE_SPANS = f"""SELECT doc_id, line_no, CAST(e - length(line) AS BIGINT) AS first, CAST(e AS BIGINT) AS last FROM (SELECT doc_id, line_no, line, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS e FROM
  (SELECT doc_id, CAST(i - 1 AS INT) AS line_no, ls[i] AS line FROM (SELECT doc_id, string_split(text, {NL}) ls FROM documents) d, LATERAL (SELECT unnest(range(1, len(d.ls) + 1)) AS i) t) l) x"""


def line_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = window.exploded(table(spark, sf_dir, "documents"))
    end = F.sum(F.length("line") + 1).over(Window.partitionBy("doc_id").orderBy("line_no")) - 1
    return rows.withColumn("last", end).select("doc_id", "line_no", (F.col("last") - F.length("line")).alias("first"), "last")


POINTS = "SELECT doc_id, (doc_id * 37) % (n_chars + 1) AS at FROM documents WHERE n_chars > 0"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("n_chars > 0").select("doc_id", (F.col("doc_id") * 37 % (F.col("n_chars") + 1)).alias("at"))


@query(f"WITH s AS ({LINE_SPANS}), p AS ({POINTS}) SELECT p.doc_id, p.at, arg_min(s.first, s.first) AS first, arg_min(s.last, s.first) AS last, arg_min(s.line_no, s.first) AS line_no FROM p JOIN s ON s.doc_id = p.doc_id AND p.at BETWEEN s.first AND s.last GROUP BY p.doc_id, p.at")
def enclosing_interval(spark, sf_dir):
    out = context.enclosing(points(spark, sf_dir), line_spans(spark, sf_dir), ["doc_id"])
    return out.select("doc_id", "at", "first", "last", "line_no")


@query(f"WITH s AS (SELECT doc_id, line_no AS node_id, first // (line_no % 4 + 1) AS first, last + 100 * (line_no % 4) AS last FROM ({LINE_SPANS}) z), p AS ({POINTS}) SELECT p.doc_id, p.at, arg_min(node_id, (s.last - s.first) * 100000 + node_id) AS node_id, arg_min(s.first, (s.last - s.first) * 100000 + node_id) AS first, arg_min(s.last, (s.last - s.first) * 100000 + node_id) AS last FROM p JOIN s ON s.doc_id = p.doc_id AND p.at BETWEEN s.first AND s.last GROUP BY p.doc_id, p.at")
def node_at_point(spark, sf_dir):
    s = line_spans(spark, sf_dir)
    nodes = s.select("doc_id", F.col("line_no").alias("node_id"), F.floor(F.col("first") / (F.col("line_no") % 4 + 1)).alias("first"), (F.col("last") + 100 * (F.col("line_no") % 4)).alias("last"))
    return context.node_at(points(spark, sf_dir), nodes, ["doc_id"])


@query(
    """WITH run AS (SELECT s_nationkey, s_name AS model, s_suppkey AS position FROM supplier WHERE s_acctbal > 4000), conf AS (SELECT s_nationkey, s_name AS model FROM supplier WHERE s_suppkey % 3 = 0),
def AS (SELECT s_nationkey, min(s_name) AS d FROM supplier GROUP BY 1), v AS (SELECT run.s_nationkey, arg_min(run.model, position) AS m FROM run JOIN conf USING (s_nationkey, model) GROUP BY 1)
SELECT def.s_nationkey, CASE WHEN v.m IS NULL OR EXISTS (SELECT 1 FROM run WHERE run.s_nationkey = def.s_nationkey AND run.model = def.d) THEN d ELSE v.m END AS model FROM def LEFT JOIN v USING (s_nationkey)"""
)
def model_select(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_nationkey", F.col("s_name").alias("model"), F.col("s_suppkey").alias("position"), "s_acctbal")
    defaults = s.groupBy("s_nationkey").agg(F.min("model").alias("default"))
    return context.chosen_model(s.where("s_acctbal > 4000"), s.where("position % 3 = 0"), defaults, "s_nationkey")


@query(
    f"""WITH RECURSIVE n AS (SELECT doc_id AS id, CASE WHEN doc_id > 0 THEN (doc_id - 1) // 2 END AS parent, lang AS type, string_split(text, {NL})[1] AS text FROM documents),
a AS (SELECT id AS start, parent AS at, 0 AS k, 0 AS size, CAST([] AS VARCHAR[]) AS parts, false AS done FROM n
  UNION ALL SELECT a.start, n.parent, a.k + 1, CASE WHEN a.size + length(n.text) <= 500 THEN a.size + length(n.text) ELSE a.size END,
    CASE WHEN a.size + length(n.text) <= 500 THEN list_concat(['-- [' || n.type || ']' || {NL} || n.text], a.parts) ELSE a.parts END, a.size + length(n.text) > 500 OR a.size + length(n.text) >= 500
    FROM a JOIN n ON n.id = a.at WHERE a.k < 3 AND NOT a.done)
SELECT start AS id, CAST(len(p) AS BIGINT) AS n_parents, array_to_string(p, {NL} || {NL}) AS content FROM (SELECT start, arg_max(parts, k) AS p FROM a GROUP BY start) z"""
)
def ancestor_chain(spark, sf_dir):
    k = F.col("doc_id")
    nodes = table(spark, sf_dir, "documents").select(k.alias("id"), F.when(k > 0, F.floor((k - 1) / 2)).alias("parent"), F.col("lang").alias("type"), F.get(T.lines(F.col("text")), F.lit(0)).alias("text"))
    return context.ancestors(nodes)


@query(
    f"""WITH RECURSIVE n AS (SELECT c_custkey AS id, CASE WHEN c_custkey > 1 THEN c_custkey // 2 END AS parent, c_mktsegment AS type, repeat(c_name, CAST(c_custkey % 17 + 1 AS INT)) AS text FROM customer),
a AS (SELECT id AS start, parent AS at, 0 AS k, 0 AS size, CAST([] AS VARCHAR[]) AS parts, false AS done FROM n
  UNION ALL SELECT a.start, n.parent, a.k + 1, CASE WHEN a.size + length(n.text) <= 500 THEN a.size + length(n.text) ELSE a.size END,
    CASE WHEN a.size + length(n.text) <= 500 THEN list_concat(['-- [' || n.type || ']' || {NL} || n.text], a.parts) ELSE a.parts END, a.size + length(n.text) >= 500
    FROM a JOIN n ON n.id = a.at WHERE a.k < 3 AND NOT a.done),
p AS (SELECT start AS id, array_to_string(arg_max(parts, k), {NL} || {NL}) AS up FROM a GROUP BY start),
c AS (SELECT id, '-- Current node: ' || type || CASE WHEN up <> '' THEN {NL} || '-- Parent context:' || {NL} || up ELSE '' END AS content FROM p JOIN n USING (id))
SELECT id, CASE WHEN length(content) > 500 THEN left(content, 500) || {NL} || '-- [truncated]' ELSE content END AS content FROM c"""
)
def node_context(spark, sf_dir):
    k = F.col("c_custkey")
    nodes = table(spark, sf_dir, "customer").select(k.alias("id"), F.when(k > 1, F.floor(k / 2)).alias("parent"), F.col("c_mktsegment").alias("type"), F.repeat("c_name", (k % 17 + 1).cast("int")).alias("text"))
    up = context.ancestors(nodes).select("id", F.col("content").alias("up"))
    return nodes.join(up, "id").select("id", context.node_content(F.col("type"), F.col("up")).alias("content"))


@query(
    """WITH RECURSIVE s AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 1 THEN NULL WHEN c_custkey % 10 > 1 THEN c_custkey - 1 ELSE c_custkey - 5 END AS parent, c_mktsegment AS name FROM customer),
f AS (SELECT id, 0 AS depth, name AS path FROM s WHERE parent IS NULL UNION ALL SELECT s.id, f.depth + 1, f.path || '/' || s.name FROM s JOIN f ON s.parent = f.id)
SELECT id, depth, path FROM f"""
)
def symbol_tree(spark, sf_dir):
    k = F.col("c_custkey")
    s = table(spark, sf_dir, "customer").select(k.alias("id"), F.when(k % 10 == 1, None).when(k % 10 > 1, k - 1).otherwise(k - 5).alias("parent"), F.col("c_mktsegment").alias("name"))
    f = context.flattened(s)
    return f.select("id", "depth", F.array_join("path", "/").alias("path"))


SYMBOLS = "SELECT event_id, ['Function', 'Method', 'Class', 'Constructor'][event_id % 4 + 1] AS kind, CASE event_id % 7 WHEN 0 THEN ' ' WHEN 1 THEN 'Lambda' WHEN 2 THEN 'function(x)' WHEN 3 THEN 'vim.api' WHEN 4 THEN '[3]' ELSE event_type END AS name, CAST(json_extract_string(props, '$.k') AS INT) AS line FROM events"


@query(f"WITH s AS ({SYMBOLS}) SELECT event_id, kind, name FROM s WHERE kind IN ('Function', 'Method', 'Constructor') AND line BETWEEN 10 AND 60 AND (kind <> 'Function' OR regexp_matches(name, '[^ \\t\\n\\x0B\\f\\r]') AND lower(name) NOT IN ('function', 'lambda', 'anonymous') AND NOT regexp_matches(name, '^function\\(|^vim\\.|^\\[\\d+\\]$'))")
def named_functions(spark, sf_dir):
    k = F.col("event_id")
    name = F.when(k % 7 == 0, " ").when(k % 7 == 1, "Lambda").when(k % 7 == 2, "function(x)").when(k % 7 == 3, "vim.api").when(k % 7 == 4, "[3]").otherwise(F.col("event_type"))
    kind = F.element_at(F.array(*map(F.lit, ("Function", "Method", "Class", "Constructor"))), (k % 4 + 1).cast("int"))
    s = table(spark, sf_dir, "events").select(k, kind.alias("kind"), name.alias("name"), F.get_json_object("props", "$.k").cast("int").alias("line"))
    return context.named_functions(s, 10, 60).select("event_id", "kind", "name")


TYPES = ", ".join(map(q, fixed.IDENTIFIER_TYPES))


@query(f"WITH n AS (SELECT event_id, user_id, CASE event_type WHEN 'click' THEN 'identifier' WHEN 'view' THEN 'name' WHEN 'error' THEN 'function_definition' WHEN 'signup' THEN 'class_declaration' ELSE 'block' END AS type, CAST(json_extract_string(props, '$.k') AS INT) AS sr, CAST(json_extract_string(props, '$.k') AS INT) + CAST(event_id % 9 AS INT) AS er FROM events) SELECT event_id, type, type IN ('function_definition', 'class_declaration') AS is_container FROM n WHERE sr <= 49 AND er >= 19 AND type IN ({TYPES}) UNION ALL SELECT event_id, type, true FROM n WHERE type IN ('function_definition', 'class_declaration')")
def syntax_filters(spark, sf_dir):
    kind = F.col("event_type")
    type_ = F.when(kind == "click", "identifier").when(kind == "view", "name").when(kind == "error", "function_definition").when(kind == "signup", "class_declaration").otherwise("block")
    line = F.get_json_object("props", "$.k").cast("int")
    n = table(spark, sf_dir, "events").select("event_id", type_.alias("type"), line.alias("sr"), (line + (F.col("event_id") % 9).cast("int")).alias("er"))
    a = context.identifiers(n, F.lit(20), F.lit(50)).select("event_id", "type", F.lit(False).alias("is_container"))
    return a.unionByName(context.containers(n).select("event_id", "type", F.lit(True).alias("is_container")))


@query("WITH c AS (SELECT user_id, event_id, CAST(json_extract_string(props, '$.k') AS INT) AS last FROM events WHERE event_type = 'view'), f AS (SELECT user_id, event_id AS f_id, CAST(json_extract_string(props, '$.k') AS INT) AS f_first FROM events WHERE event_type = 'click') SELECT c.user_id, c.event_id, c.last - 2 AS first, c.last, f_first, f_first + 5 AS f_last FROM c LEFT JOIN f ON f.user_id = c.user_id AND f_first - 1 = c.last")
def comment_adjacency(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
    c = e.where("event_type = 'view'").select("user_id", "event_id", (F.col("k") - 2).alias("first"), F.col("k").alias("last"))
    f = e.where("event_type = 'click'").select("user_id", F.col("k").alias("f_first"), (F.col("k") + 5).alias("f_last"))
    return context.adjacent(c, f, ["user_id"])


@query(r"SELECT doc_id, CASE WHEN NOT regexp_matches(text, '[^ \t\n\x0B\f\r]') THEN 'init' WHEN doc_id % 3 = 0 THEN 'comment_func' WHEN doc_id % 3 = 1 THEN 'impl' ELSE 'unknown' END AS kind, CASE WHEN length(text) > 500 THEN left(text, 500) || chr(10) || '-- [truncated]' ELSE text END AS cut FROM documents")
def cursor_kinds(spark, sf_dir):
    k = F.col("doc_id") % 3
    return table(spark, sf_dir, "documents").select("doc_id", context.cursor_kind(context.has_code(F.col("text")), k == 0, k == 1).alias("kind"), T.truncated(F.col("text")).alias("cut"))


@query(r"SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN regexp_matches(text, '[^ \t\n\x0B\f\r]') ELSE doc_id % 4 = 3 END AS code FROM documents")
def code_by_tree(spark, sf_dir):
    k = F.col("doc_id") % 4
    comment, block = F.lit("comment"), F.lit("block")
    kinds = F.when(k == 1, F.array().cast("array<string>")).when(k == 2, F.array(comment)).when(k == 3, F.array(comment, block))
    return table(spark, sf_dir, "documents").select("doc_id", context.has_code(F.col("text"), kinds).alias("code"))


@query("SELECT s_suppkey AS client FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def capable_clients(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("client"), "s_suppkey")
    caps = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("client"), F.when(F.col("n_regionkey") == 2, "hover").otherwise("symbols").alias("method"))
    return context.capable(s, caps, "hover").select(F.col("s_suppkey").alias("client"))


# ---------------------------------------------------------------- merging


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", F.col("turn").alias("arrival"), F.when(F.col("turn") % 3 == 0, None).otherwise(F.col("turn") * 7 % 5).alias("priority"), F.when(F.col("turn") % 4 == 1, "").otherwise(F.col("text")).alias("content"), (F.col("turn") * 130).alias("arrival_ms"))


CONTEXTS = "SELECT conv_id, turn AS arrival, CASE WHEN turn % 3 = 0 THEN NULL ELSE turn * 7 % 5 END AS priority, CASE WHEN turn % 4 = 1 THEN '' ELSE text END AS content, turn * 130 AS arrival_ms FROM conversations"


@query(f"WITH c AS ({CONTEXTS}) SELECT conv_id, count(*) AS n, string_agg(content, {NL} || {NL} ORDER BY arrival) AS content FROM c WHERE content <> '' GROUP BY conv_id")
def merge_concat(spark, sf_dir):
    return merge.concatenated(contexts(spark, sf_dir), "conv_id")


@query(f"WITH c AS ({CONTEXTS}) SELECT conv_id, count(*) AS n, string_agg(content, {NL} || {NL} ORDER BY coalesce(priority, 10), arrival) AS content FROM c WHERE content <> '' GROUP BY conv_id")
def merge_weighted(spark, sf_dir):
    return merge.weighted(contexts(spark, sf_dir), "conv_id")


@query(f"WITH c AS ({CONTEXTS}) SELECT conv_id, string_agg(arrival || ':' || length(content), ',' ORDER BY arrival) AS content FROM c GROUP BY conv_id")
def merge_custom(spark, sf_dir):
    return merge.custom(contexts(spark, sf_dir), "conv_id", lambda rows: ",".join(f"{r['arrival']}:{len(r['content'])}" for r in rows))


@query(f"WITH c AS ({CONTEXTS}) SELECT conv_id, count(*) AS n, string_agg(content, {NL} || {NL} ORDER BY arrival) AS content FROM c WHERE content <> '' AND arrival_ms <= 500 GROUP BY conv_id")
def fan_out_timeout(spark, sf_dir):
    return merge.concatenated(merge.in_time(contexts(spark, sf_dir)), "conv_id")


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 <> 0 AND s_suppkey % 2 = 0")
def enabled_providers(spark, sf_dir):
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select(k, F.when(k % 3 == 0, False).when(k % 3 == 1, True).alias("enabled"), (k % 2 == 0).alias("available"))
    return merge.enabled(s).select("s_suppkey")


@query("WITH s AS (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS total FROM conversations) SELECT conv_id, count(*) AS n, CAST(max(total) AS BIGINT) AS size FROM s WHERE total <= 500 GROUP BY conv_id")
def size_budget(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("size", F.length("text"))
    return merge.within_budget(c, "conv_id", "turn", "size", fixed.MAX_CONTEXT_SIZE).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))


# ---------------------------------------------------------------- events


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("id"), "ts", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query(
    """WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM g)
SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM s GROUP BY user_id, burst"""
)
def debounce(spark, sf_dir):
    return events.debounced(edits(spark, sf_dir), "user_id", "6 hours")


@query("WITH l AS (SELECT user_id, event_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events) SELECT user_id, event_id AS id, coalesce(next <= ts + INTERVAL 2 HOUR, false) AS stale FROM l")
def latest_wins(spark, sf_dir):
    e = edits(spark, sf_dir).withColumn("done_ts", F.expr("ts + INTERVAL 2 HOURS"))
    return events.latest_wins(e, "user_id").select("user_id", "id", "stale")


@query(
    """WITH l AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events),
x AS (SELECT *, coalesce(next <= ts + INTERVAL 1 HOUR, false) AS stale, CASE WHEN event_id % 7 = 0 THEN k + 1 ELSE k END AS row1, CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS col1 FROM l)
SELECT event_id AS id, CASE WHEN stale THEN 'stale' WHEN event_type = 'view' THEN 'left' WHEN row1 <> k OR (k % 2 = 0 AND col1 <> 0) THEN 'moved' WHEN event_id % 3 = 0 THEN 'empty' ELSE 'used' END AS verdict FROM x"""
)
def late_discard(spark, sf_dir):
    e = events.latest_wins(edits(spark, sf_dir).withColumn("done_ts", F.expr("ts + INTERVAL 1 HOURS")), "user_id")
    i, k = F.col("id"), F.col("k")
    mode = F.when(F.col("event_type") == "view", "n").otherwise("i")
    v = events.verdict(F.col("stale"), mode, k % 2 == 1, k, F.lit(0), F.when(i % 7 == 0, k + 1).otherwise(k), F.when(i % 5 == 0, 1).otherwise(0), i % 3)
    return e.select("id", v.alias("verdict"))


@query(
    """WITH a AS (SELECT user_id AS client, event_id AS id, ts, CAST(json_extract_string(props, '$.k') AS INT) AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
p AS (SELECT *, lag(n) OVER (PARTITION BY client, key ORDER BY n) AS before FROM a)
SELECT p.client, p.id, p.before IS NOT NULL AND (SELECT count(DISTINCT a.key) FROM a WHERE a.client = p.client AND a.n > p.before AND a.n < p.n) < 20 AS hit FROM p"""
)
def lru_hits(spark, sf_dir):
    a = edits(spark, sf_dir).select(F.col("user_id").alias("client"), "id", "ts", F.col("k").alias("key"), F.lit(1).alias("version"))
    return machine.cache_hits(a, 20)


@query("WITH r AS (SELECT user_id, event_id, ts, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 50 AS batch FROM events) SELECT user_id, CAST(batch AS BIGINT) AS batch, count(*) AS n, arg_min(event_id, (ts, event_id)) AS first_id, arg_max(event_id, (ts, event_id)) AS last_id FROM r GROUP BY user_id, batch")
def flush_batches(spark, sf_dir):
    return events.flushed(edits(spark, sf_dir), "user_id")


@query(
    """WITH e AS (SELECT *, count(*) FILTER (WHERE event_type <> 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id) - CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END AS g FROM events)
SELECT q.user_id AS client, q.event_id AS id, coalesce((SELECT string_agg(r.event_id::VARCHAR, ',' ORDER BY r.ts, r.event_id) FROM e r WHERE r.user_id = q.user_id AND r.event_type = 'error' AND r.g = q.g), '') AS rejected FROM e q WHERE q.event_type <> 'error'"""
)
def rejected_memory(spark, sf_dir):
    e = edits(spark, sf_dir).select(F.col("user_id").alias("client"), "id", "ts", F.when(F.col("event_type") == "error", "reject").otherwise("request").alias("kind"), F.col("id").cast("string").alias("completion"))
    m = machine.rejected_memory(e)
    return m.select("client", "id", F.array_join("rejected", ",").alias("rejected"))


@query(
    f"""WITH RECURSIVE b AS (SELECT item_id % 40 AS item, list_sort(list(text)) AS texts FROM benchmark GROUP BY 1),
z AS (SELECT item, texts, texts[1] AS text, length(regexp_extract(texts[1], '^{WS}*(?:{KEY}+|{OTHER}+){WS}*')) AS head FROM b),
x AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k, CASE event_type WHEN 'purchase' THEN 'response' WHEN 'signup' THEN 'leave' ELSE 'move' END AS kind FROM events),
v AS (SELECT user_id AS u, event_id::VARCHAR AS id, epoch_us(ts) // 1000 AS ms, kind, CASE WHEN event_id % 13 = 0 THEN 2 ELSE 1 END AS row, CASE WHEN kind = 'response' THEN 0 ELSE k % 12 END AS col,
  CASE WHEN event_id % 11 = 0 THEN '?' || text ELSE text END AS line, texts, CASE WHEN head < length(text) THEN head + 1 END AS need,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, kind, event_id::VARCHAR) AS n FROM x JOIN z ON z.item = x.user_id % 40),
w AS (SELECT * FROM v UNION ALL SELECT u, NULL, 4611686018427387904, 'end', NULL, NULL, NULL, any_value(texts), NULL, max(n) + 1 FROM v GROUP BY u),
s AS (SELECT DISTINCT u, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS id, CAST(NULL AS BIGINT) AS ms, CAST(NULL AS INT) AS row, CAST(NULL AS INT) AS col, CAST(NULL AS VARCHAR) AS typed,
  CAST(NULL AS VARCHAR) AS was, CAST(NULL AS VARCHAR) AS reason, CAST(NULL AS VARCHAR) AS told, CAST(NULL AS BIGINT) AS told_ms FROM w
  UNION ALL SELECT u, n, CASE WHEN kind = 'response' THEN new_id WHEN stays THEN id END, CASE WHEN kind = 'response' OR stays THEN new_ms END, CASE WHEN kind = 'response' THEN new_row WHEN stays THEN row END,
    CASE WHEN kind = 'response' THEN new_col WHEN stays THEN col END, CASE WHEN kind = 'response' THEN '' WHEN stays THEN now END, id, reason,
    CASE WHEN reason = 'idle' THEN typed WHEN reason <> 'cursor_moved' THEN now END, CASE WHEN reason = 'idle' THEN ms + 86400000 ELSE new_ms END
  FROM (SELECT *, coalesce(kind = 'move' AND id IS NOT NULL AND reason IS NULL, false) AS stays
    FROM (SELECT *, CASE WHEN id IS NULL THEN NULL WHEN new_ms - ms >= 86400000 THEN 'idle' WHEN kind <> 'move' THEN NULL WHEN new_row <> row OR new_col < col THEN 'cursor_moved'
        WHEN len(list_filter(texts, lambda t: starts_with(t, now))) = 0 THEN 'mismatch' WHEN length(now) >= need THEN 'typed' END AS reason
      FROM (SELECT s.u, w.n, s.id, s.ms, s.row, s.col, s.typed, w.id AS new_id, w.ms AS new_ms, w.row AS new_row, w.col AS new_col, w.kind, w.texts, w.need,
          substring(w.line, s.col + 1, greatest(w.col - s.col, 0)) AS now FROM s JOIN w ON w.u = s.u AND w.n = s.n + 1) i1) i2) i3),
o AS (SELECT s.u AS buffer_id, was AS request_id, make_timestamp(told_ms * 1000) AS ts, CASE WHEN reason IN ('idle', 'typed') THEN 'shown' ELSE 'rejected' END AS outcome, reason, told AS typed,
  CASE WHEN reason IN ('idle', 'typed') THEN list_transform(list_filter(w.texts, lambda t: starts_with(t, told) AND length(t) > length(told)), lambda t: substring(t, length(told) + 1)) END AS shown
  FROM s JOIN w ON w.u = s.u AND w.n = s.n WHERE reason IS NOT NULL)
SELECT buffer_id, request_id, ts, outcome, reason, typed, array_to_string(shown, chr(1)) AS shown FROM o WHERE outcome = 'rejected' OR len(shown) > 0"""
)
def deferred_validation(spark, sf_dir):
    """Users' events as edits over benchmark items; the SQL goes event by event, the query by windows."""
    b = table(spark, sf_dir, "benchmark").groupBy((F.col("item_id") % 40).alias("item")).agg(F.sort_array(F.collect_list("text")).alias("texts")).withColumn("text", F.get("texts", F.lit(0)))
    e = edits(spark, sf_dir).withColumn("item", F.col("user_id") % 40).join(b, "item")
    kind = F.when(F.col("event_type") == "purchase", "response").when(F.col("event_type") == "signup", "leave").otherwise("move")
    col = (F.col("k") % 12).cast("int")
    line = F.when(F.col("id") % 11 == 0, F.concat(F.lit("?"), "text")).otherwise(F.col("text"))
    rows = machine.as_events(e, buffer_id=F.col("user_id"), ts=F.col("ts").cast("timestamp"), kind=kind, request_id=F.col("id").cast("string"), row=F.when(F.col("id") % 13 == 0, 2).otherwise(1), col=F.when(kind == "response", 0).otherwise(col), line=line, candidates=F.col("texts"))
    return machine.validated(rows, idle_ms=86_400_000).withColumn("shown", F.array_join("shown", "\x01"))


LOG = """req AS (SELECT event_id AS request_id FROM events WHERE event_type = 'view'), resp AS (SELECT event_id AS request_id, event_id % 4 AS n FROM events WHERE event_type = 'view' AND event_id % 5 <> 0),
acc AS (SELECT event_id AS request_id, true AS accepted FROM events WHERE event_type = 'view' AND event_id % 3 = 0 UNION ALL SELECT event_id, event_id % 7 <> 0 FROM events WHERE event_type = 'view' AND event_id % 2 = 0)"""


@query(
    f"""WITH {LOG}, a AS (SELECT request_id, count(*) AS c, bool_or(accepted) AS accepted FROM acc GROUP BY 1)
SELECT request_id, n IS NOT NULL AS answered, coalesce(c, 0) AS n_accepts, accepted, CASE WHEN n IS NULL THEN 'no response' WHEN n = 0 THEN 'empty' WHEN accepted IS NULL THEN 'unresolved' WHEN accepted THEN 'accepted' ELSE 'rejected' END AS outcome FROM req LEFT JOIN resp USING (request_id) LEFT JOIN a USING (request_id)"""
)
def interaction_outcomes(spark, sf_dir):
    e, i = table(spark, sf_dir, "events").where("event_type = 'view'").select(F.col("event_id").alias("request_id")), F.col("request_id")
    resp = e.where(i % 5 != 0).withColumn("n_completions", i % 4)
    acc = e.where(i % 3 == 0).withColumn("accepted", F.lit(True)).unionByName(e.where(i % 2 == 0).withColumn("accepted", i % 7 != 0))
    return log.outcomes(e, resp, acc)


@query(
    """WITH r AS (SELECT event_id AS request_id, CAST(ts AS TIMESTAMP) AS ts FROM events WHERE event_type = 'view'),
s AS (SELECT request_id, ts + to_minutes(CAST(request_id % 8 AS INT)) AS response_ts FROM r WHERE request_id % 5 <> 0)
SELECT r.request_id, epoch_ms(response_ts) - epoch_ms(ts) AS took_ms FROM r LEFT JOIN s ON s.request_id = r.request_id AND response_ts >= ts AND response_ts <= ts + INTERVAL 5 MINUTES"""
)
def answered_requests(spark, sf_dir):
    i = F.col("event_id")
    r = table(spark, sf_dir, "events").where("event_type = 'view'").select(i.alias("request_id"), F.col("ts").cast("timestamp").alias("ts"))
    s = r.where("request_id % 5 <> 0").withColumn("ts", F.col("ts") + F.make_dt_interval(mins=(F.col("request_id") % 8).cast("int")))
    took = F.unix_millis("response_ts") - F.unix_millis("ts")
    return events.answered(r, s).select("request_id", took.alias("took_ms"))


@query(
    """WITH e AS (SELECT event_id, ['CursorMovedI', 'InsertEnter', 'InsertLeave', 'BufLeave', 'Other'][event_id % 5 + 1] AS kind, event_id % 11 = 0 AS pending, event_id % 2 = 0 AS visible, event_id % 7 <> 0 AS on_row, event_id % 3 - 1 AS moved, event_id % 4 < 2 AS ok FROM events)
SELECT event_id, CASE WHEN kind = 'InsertEnter' THEN 'trigger' WHEN kind IN ('InsertLeave', 'BufLeave') THEN 'dismiss' WHEN kind = 'Other' THEN 'nothing' WHEN pending THEN 'validate' WHEN NOT visible THEN 'trigger'
  WHEN on_row AND moved = 0 THEN 'keep' WHEN on_row AND moved > 0 AND ok THEN 'trim' ELSE 'dismiss and trigger' END AS action FROM e"""
)
def event_dispatch(spark, sf_dir):
    i = F.col("event_id")
    kind = F.element_at(F.array(*map(F.lit, ("CursorMovedI", "InsertEnter", "InsertLeave", "BufLeave", "Other"))), (i % 5 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(i, events.action(kind, i % 11 == 0, i % 2 == 0, i % 7 != 0, i % 3 - 1, i % 4 < 2).alias("action"))


@query("SELECT doc_id FROM documents WHERE doc_id % 2 = 0 AND doc_id % 3 <> 0 AND doc_id % 5 <> 0 AND text <> ''")
def eligible_buffers(spark, sf_dir):
    k = F.col("doc_id")
    b = table(spark, sf_dir, "documents").select(k, "text", (k % 2 == 0).alias("loaded"), F.when(k % 3 != 0, True).alias("listed"), F.when(k % 5 != 0, F.col("source")).otherwise("").alias("name"))
    return context.eligible_buffers(b).select("doc_id")


@query("SELECT event_id, CASE WHEN event_id % 4 < 3 THEN '/w/' || user_id END AS path, CASE WHEN event_id % 4 < 3 THEN k + 1 END AS start_line, CASE event_id % 4 WHEN 0 THEN k + 3 WHEN 1 THEN k + 1 WHEN 2 THEN k + 6 END AS end_line FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events) e")
def locations(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("file:///w/"), F.col("user_id").cast("string")).alias("uri"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    at = lambda c: F.struct(c.alias("line"))
    i = F.col("event_id") % 4
    reply = (
        F.when(i == 0, F.to_json(F.struct("uri", F.struct(at(F.col("k")).alias("start"), at(F.col("k") + 2).alias("end")).alias("range"))))
        .when(i == 1, F.to_json(F.struct(F.col("uri").alias("targetUri"), F.struct(at(F.col("k")).alias("start")).alias("targetSelectionRange"))))
        .when(i == 2, F.to_json(F.struct(F.col("uri").alias("targetUri"), F.struct(at(F.col("k")).alias("start"), at(F.col("k") + 5).alias("end")).alias("targetRange"))))
        .otherwise(F.to_json(F.struct("uri")))
    )
    return e.select("event_id", context.location(reply).alias("l")).select("event_id", "l.*")


@query(
    f"""WITH d AS (SELECT doc_id, string_split(text, {NL}) AS ls, CAST(doc_id % 3 AS INT) AS sr, CAST(doc_id % 3 + doc_id % 2 AS INT) AS er FROM documents), s AS (SELECT *, list_slice(ls, sr + 1, er + 1) AS p FROM d)
SELECT doc_id, CASE len(p) WHEN 0 THEN '' WHEN 1 THEN substring(p[1], 6, 12) ELSE array_to_string(list_concat(list_concat([substring(p[1], 6)], list_slice(p, 2, len(p) - 1)), [substring(p[len(p)], 1, 17)]), {NL}) END AS text FROM s"""
)
def node_texts(spark, sf_dir):
    k = F.col("doc_id")
    t = context.node_text(F.col("text"), (k % 3).cast("int"), F.lit(5), (k % 3 + k % 2).cast("int"), F.lit(17))
    return table(spark, sf_dir, "documents").select(k, t.alias("text"))


@query(
    f"""WITH {MIDDLE}, r AS (SELECT * FROM w WHERE lang <> 'fr' AND doc_id % 6 <> 5), p AS (SELECT *, doc_id % 2 = 0 AS chat FROM r),
c AS (SELECT *, CASE WHEN chat THEN 'lang ' || lang || {NL} || {NL} || 'head ' || ls[1] END AS ctx FROM p)
SELECT doc_id AS request, CASE WHEN chat THEN 'chat' ELSE 'fim' END AS mode, md5(CASE WHEN chat THEN {SYSTEM} ELSE before END) AS first_part,
  CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN '' ELSE 'new line' END AS completions, CASE WHEN doc_id % 7 = 0 THEN 'moved' WHEN doc_id % 3 < 2 THEN 'empty' ELSE 'used' END AS verdict FROM c"""
)
def suggestions(spark, sf_dir):
    """The request path end to end: eligible requests, context by two providers, prompts, responses, verdicts."""
    d = middle(spark, sf_dir)
    k = F.col("request")
    r = d.select(F.col("doc_id").alias("request"), "text", F.col("lang").alias("filetype"), "line", "col")
    r = r.withColumn("mode", F.when(k % 6 == 5, "n").otherwise("i")).withColumn("formatter", F.when(k % 2 == 0, "chat").otherwise("fim")).withColumn("rejected", F.lit(None).cast("array<string>"))
    reg = Registry()
    reg.provider("head", lambda x: x.select("request", F.concat(F.lit("head "), F.get(T.lines(F.col("text")), F.lit(0))).alias("content")), priority=20)
    reg.provider("lang", lambda x: x.select("request", F.concat(F.lit("lang "), "filetype").alias("content")), priority=5)
    r = suggest.with_prompts(suggest.eligible(r, ("fr",)), reg)
    fenced = F.when(k % 3 == 2, F.array(F.lit("```\nnew line\n```"))).otherwise(F.array().cast("array<string>"))
    answers = d.select(F.col("doc_id").alias("request")).where("request % 3 <> 0").withColumn("completions", fenced)
    r = suggest.used(suggest.with_completions(r, answers), F.lit(False), F.lit("i"), F.lit(True), F.when(k % 7 == 0, F.col("line") + 1).otherwise(F.col("line")), F.col("col"))
    first = F.coalesce(F.get(F.col("prompt.messages"), F.lit(0))["content"], F.col("prompt.prefix"))
    return r.select("request", F.col("prompt.mode").alias("mode"), md5(first).alias("first_part"), F.array_join("completions", "|").alias("completions"), "verdict")
