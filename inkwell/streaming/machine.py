"""The deferred-validation state machine, and scans of ordered events through keyed states.

The stream applies one plain step function; the batch form says the same in windows.
"""

from __future__ import annotations

import json
import math
import re
from collections import OrderedDict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import fixed, text
from inkwell.sources.shared import reachable

EVENTS = "buffer_id long, ts timestamp, kind string, request_id string, row int, col int, line string, candidates array<string>"
OUTCOMES = "buffer_id long, request_id string, ts timestamp, outcome string, reason string, typed string, shown array<string>"
_WORD = re.compile("[A-Za-z0-9_À-ÿ]+|[^A-Za-z0-9_À-ÿ \\t\\n\\x0b\\f\\r]+")


def threshold(first: str, spec: str) -> int | None:
    """As functions.text.overlap_threshold, for one text."""
    m = re.fullmatch(r"([0-9]+)?(?:\+([0-9]*\.?[0-9]+))?", spec)
    if not m or not (m[1] or m[2]):
        return None
    chars = float(m[2]) if m[2] else None
    if m[1] is None:
        return math.floor(chars)
    n, spans = int(m[1]), [x.span() for x in _WORD.finditer(first)]
    if n < 1 or len(spans) < n:
        return None
    if chars is None:
        return spans[n][0] if len(spans) > n else len(first) if spans[n - 1][1] < len(first) else None
    if len(spans) <= n:
        return None
    size = spans[n][1] - spans[n][0]
    return spans[n][0] + (math.ceil(chars * size) if 0 < chars < 1 else min(math.floor(chars), size))


def rests(candidates: list[str], typed: str) -> list[str]:
    return [c[len(typed) :] for c in candidates if c.startswith(typed) and len(c) > len(typed)]


def step(pending: dict | None, e: dict, spec: str = fixed.DEFAULT_OVERLAP, idle_ms: int = fixed.IDLE_MS) -> tuple[dict | None, list[dict]]:
    """(what is pending, outcomes) after an event; ``ms`` of an event is its time.

    A pending completion is shown once enough of it is typed, or after ``idle_ms`` without an event (0: at
    once, negative: never). It is rejected if the cursor leaves its line or goes back, or what is typed begins
    none of the candidates. One of which nothing remains is dropped silently, as is one that a new response
    replaces or that a leave event ends.
    """
    out: list[dict] = []

    def show(p: dict, ms: int, reason: str) -> None:
        if left := rests(p["candidates"], p["typed"]):
            out.append({"request_id": p["request_id"], "ms": ms, "outcome": "shown", "reason": reason, "typed": p["typed"], "shown": left})

    p, ms = pending, e["ms"]
    if p and idle_ms > 0 and ms - p["ms"] >= idle_ms:
        show(p, p["ms"] + idle_ms, "idle")
        p = None
    kind = e["kind"]
    if kind == "response":
        p = {"request_id": e["request_id"], "row": e["row"], "col": e["col"], "candidates": list(e["candidates"] if e["candidates"] is not None else []), "typed": "", "ms": ms}
        if idle_ms == 0:
            show(p, ms, "at once")
            p = None
    elif kind == "leave":
        p = None
    elif kind == "move" and p:
        reject = {"request_id": p["request_id"], "ms": ms, "outcome": "rejected", "shown": None}
        typed = (e["line"] or "")[p["col"] : max(e["col"], p["col"])]
        if e["row"] != p["row"] or e["col"] < p["col"]:
            out.append(reject | {"reason": "cursor_moved", "typed": None})
            p = None
        elif not any(c.startswith(typed) for c in p["candidates"]):
            out.append(reject | {"reason": "mismatch", "typed": typed})
            p = None
        else:
            p = p | {"typed": typed, "ms": ms}
            need = threshold(p["candidates"][0], spec) if p["candidates"] else None
            if need is not None and len(typed) >= need:
                show(p, ms, "typed")
                p = None
    return p, out


def scan(events: DataFrame, by: str, order: list[str], make: Callable[[], object], each: Callable, schema: str) -> DataFrame:
    """Rows of each key in order through ``each(state, row) -> iterator of dicts``, with ``each(state, None)`` after the last.

    Keys are partitioned and sorted, then read as a stream: a task holds one state, never a key's rows.
    """
    reachable(events.sparkSession)
    names = events.columns
    sorted_ = events.repartition(by).sortWithinPartitions(by, *order)
    fields = [f.strip().split(" ")[0] for f in re.split(r",(?![^<]*>)", schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, any_ = None, None, False
        for pdf in batches:
            out: list[dict] = []
            for row in pdf.itertuples(index=False, name=None):
                r = dict(zip(names, row))
                if not any_ or r[by] != key:
                    if any_:
                        out.extend({by: key} | x for x in each(state, None))
                    key, state, any_ = r[by], make(), True
                out.extend({by: key} | x for x in each(state, r))
            yield pd.DataFrame(out, columns=fields)
        if any_:
            yield pd.DataFrame([{by: key} | x for x in each(state, None)], columns=fields)

    return sorted_.mapInPandas(run, schema)


def _timed(x: dict) -> dict:
    return {k: v for k, v in x.items() if k != "ms"} | {"ts": pd.Timestamp(x["ms"], unit="ms")}


def validated(events: DataFrame, spec: str = fixed.DEFAULT_OVERLAP, idle_ms: int = fixed.IDLE_MS) -> DataFrame:
    """Outcomes of all events of a table; what is pending at the end is shown when its timer would fire.

    A move is judged against the latest response alone, so each row tells by itself whether it would end what
    is pending, and the first that does so after a response is the outcome. Ties go by kind, then request. One
    exchange by buffer; rows of a buffer are sorted and spill, but are one task's.
    """
    order = Window.partitionBy("buffer_id").orderBy("ts", "kind", "request_id")
    response, move = F.col("kind") == "response", F.col("kind") == "move"
    offered = F.coalesce("candidates", F.array().cast("array<string>"))
    # the threshold comes with the response, so it is found once and not at each move
    need = text.overlap_threshold(F.get(offered, F.lit(0)), F.lit(spec))
    own = F.when(response, F.struct("request_id", "row", "col", offered.alias("candidates"), need.alias("need")))
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    e = events.where(F.col("kind").isin("response", "move", "leave")).withColumn("ms", F.unix_millis("ts"))
    e = e.withColumns({"p": F.last(own, ignorenulls=True).over(so_far), "span": F.count_if(response).over(so_far), "next": F.lead("ms").over(order)})
    e = e.where("span > 0")
    at, candidates, col, size = F.col("p.col"), F.col("p.candidates"), F.col("col"), F.length("typed")
    e = e.withColumn("typed", F.when(move, F.substring(F.coalesce("line", F.lit("")), at + 1, F.greatest(col, at) - at)).otherwise(""))
    waits = F.coalesce(F.col("next") - F.col("ms") >= idle_ms, F.lit(True)) if idle_ms > 0 else F.lit(False)
    reason = (
        F.when(F.col("kind") == "leave", "left")
        .when(move & ((F.col("row") != F.col("p.row")) | (col < at)), "cursor_moved")
        .when(move & ~F.coalesce(F.exists(candidates, lambda c: c.startswith(F.col("typed"))), F.lit(False)), "mismatch")
        .when(move & (size >= F.col("p.need")), "typed")
        .when(response & F.lit(idle_ms == 0), "at once")
        .when(waits, "idle")
    )
    first = Window.partitionBy("buffer_id", "span").orderBy("ts", "kind", "request_id")
    e = e.withColumn("reason", reason).where("reason is not null").withColumn("nth", F.row_number().over(first)).where("nth = 1 and reason <> 'left'")
    rejected = F.col("reason").isin("cursor_moved", "mismatch")
    left = F.transform(F.filter(candidates, lambda c: c.startswith(F.col("typed")) & (F.length(c) > size)), lambda c: F.substring(c, size + 1, F.length(c)))
    e = e.withColumn("shown", F.when(~rejected, left)).where(rejected | (F.size("shown") > 0))
    when = F.timestamp_millis(F.col("ms") + F.when(F.col("reason") == "idle", idle_ms).otherwise(0))
    typed = F.when(F.col("reason") != "cursor_moved", F.col("typed"))
    outcome = F.when(rejected, "rejected").otherwise("shown")
    return e.select("buffer_id", F.col("p.request_id").alias("request_id"), when.alias("ts"), outcome.alias("outcome"), "reason", typed.alias("typed"), "shown")


def validated_stream(events: DataFrame, spec: str = fixed.DEFAULT_OVERLAP, idle_ms: int = fixed.IDLE_MS, late: str = "10 seconds") -> DataFrame:
    """The same over a stream: one pending completion a buffer in the state store, idle timers in event time."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    reachable(events.sparkSession)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        p = json.loads(state.get[0]) if state.exists else None
        out: list[dict] = []
        if state.hasTimedOut:
            p, got = step(p, {"ms": (p["ms"] + idle_ms) if p else 0, "kind": "end"}, spec, idle_ms)
            out += got
        else:
            rows = pd.concat(list(batches)).sort_values(["ts", "kind", "request_id"], kind="stable", na_position="first")
            for r in rows.to_dict("records"):
                p, got = step(p, r | {"ms": int(pd.Timestamp(r["ts"]).value // 1_000_000)}, spec, idle_ms)
                out += got
        if p is None:
            if state.exists:
                state.remove()
        else:
            state.update((json.dumps(p),))
            if idle_ms > 0:
                state.setTimeoutTimestamp(max(p["ms"] + idle_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([{"buffer_id": key[0]} | _timed(x) for x in out], columns=["buffer_id", "request_id", "ts", "outcome", "reason", "typed", "shown"])

    return events.withWatermark("ts", late).groupBy("buffer_id").applyInPandasWithState(run, OUTCOMES, "pending string", "append", GroupStateTimeout.EventTimeTimeout)


def cache_hits(accesses: DataFrame, capacity: int = fixed.CACHED_BUFFERS) -> DataFrame:
    """(client, id, hit) of accesses (client, id, ts, key, version): a least-recently-used cache of ``capacity`` keys a client.

    A key is found while it is cached with the same version.
    """
    kind = accesses.schema["client"].dataType.simpleString()

    def each(cache: OrderedDict, r: dict | None) -> Iterator[dict]:
        if r is None:
            return
        hit = cache.get(r["key"]) == (r["version"],)
        cache[r["key"]] = (r["version"],)
        cache.move_to_end(r["key"])
        if len(cache) > capacity:
            cache.popitem(last=False)
        yield {"id": r["id"], "hit": hit}

    return scan(accesses, "client", ["ts", "id"], OrderedDict, each, f"client {kind}, id long, hit boolean")


def rejected_memory(events: DataFrame) -> DataFrame:
    """(client, id, rejected): each request with the completions rejected since the request before it, then forgotten.

    Of events (client, id, ts, kind, completion) with kinds request and reject. A running count of requests
    numbers the spans between them; what is rejected in a span belongs to the request that ends it.
    """
    order = Window.partitionBy("client").orderBy("ts", "id")
    request, reject = F.col("kind") == "request", F.col("kind") == "reject"
    before = F.coalesce(F.sum(F.when(request, 1)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = events.where(request | reject).withColumn("span", before).groupBy("client", "span")
    held = F.sort_array(F.collect_list(F.when(reject, F.struct("ts", "id", "completion"))))
    out = spans.agg(F.max(F.when(request, F.col("id").cast("long"))).alias("id"), F.count_if(request).alias("n"), F.transform(held, lambda x: x["completion"]).alias("rejected"))
    return out.where("n = 1").select("client", "id", "rejected")


def as_events(rows: DataFrame, **columns) -> DataFrame:
    """Columns of EVENTS from expressions; those not named are null."""
    kinds = dict(x.strip().split(" ", 1) for x in EVENTS.split(","))
    return rows.select(*[(columns[n] if n in columns else F.lit(None)).cast(t).alias(n) for n, t in kinds.items()])
