"""Edit events: debouncing, latest-wins, late results, buffered flushes. Batch and stream share the expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import fixed


def debounced(events: DataFrame, by: str, gap: str = f"{fixed.DEBOUNCE_MS} milliseconds") -> DataFrame:
    """(by, first_ts, last_ts, n): one row a burst of events with less than ``gap`` between them.

    Works on tables and on streams with a watermark, where a burst comes out once it has surely ended.
    """
    w = F.session_window("ts", gap)
    return events.groupBy(by, w.alias("w")).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n")).drop("w")


def latest_wins(requests: DataFrame, by: str) -> DataFrame:
    """``requests`` (by, id, ts, done_ts) with stale: whether a later request began before this one's result."""
    following = F.lead("ts").over(Window.partitionBy(by).orderBy("ts", "id"))
    return requests.withColumn("stale", F.coalesce(following <= F.col("done_ts"), F.lit(False)))


def latest_wins_stream(requests: DataFrame, by: str, late: str, window: str) -> DataFrame:
    """Per key and tumbling window the newest request, for streams."""
    newest = F.max_by(F.struct("id", "ts"), F.struct("ts", "id"))
    return requests.withWatermark("ts", late).groupBy(by, F.window("ts", window).alias("w")).agg(newest.alias("x")).select(by, "x.*")


def answered(requests: DataFrame, responses: DataFrame, late: str = "10 minutes", within: str = "5 minutes") -> DataFrame:
    """(request_id, ts, response_ts): requests (request_id, ts) with their response (request_id, ts) in time, else null.

    Works on tables and on streams. A stream keeps a request only until the watermark has passed all responses that
    it could have; a request without one comes out then, so the last ones need later events.
    """
    r = requests.select("request_id", "ts").withWatermark("ts", late)
    s = responses.select(F.col("request_id").alias("of"), F.col("ts").alias("response_ts")).withWatermark("response_ts", late)
    in_time = F.col("response_ts").between(F.col("ts"), F.col("ts") + F.expr(f"INTERVAL {within}"))
    return r.join(s, (F.col("request_id") == F.col("of")) & in_time, "left").select("request_id", "ts", "response_ts")


def verdict(stale: Column, mode: Column, deferred: Column, row0: Column, col0: Column, row: Column, col: Column, n_completions: Column) -> Column:
    """What becomes of a result: the first of stale, left insert mode, moved (only the row counts if deferred), empty; else used."""
    moved = F.when(deferred, row != row0).otherwise((row != row0) | (col != col0))
    return F.when(stale, "stale").when(mode != "i", "left").when(moved, "moved").when(F.coalesce(n_completions, F.lit(0)) <= 0, "empty").otherwise("used")


def flushed(events: DataFrame, by: str, most: int = fixed.BUFFERED_EVENTS) -> DataFrame:
    """(by, batch, n, first_id, last_id): buffered events in the batches of ``most`` in which a buffer is written."""
    at = F.row_number().over(Window.partitionBy(by).orderBy("ts", "id")) - 1
    return events.withColumn("batch", F.floor(at / most).cast("long")).groupBy(by, "batch").agg(F.count(F.lit(1)).alias("n"), F.min_by("id", F.struct("ts", "id")).alias("first_id"), F.max_by("id", F.struct("ts", "id")).alias("last_id"))


def append_stream(events: DataFrame, path: str, checkpoint: str):
    """Writes a stream to the JSON-lines log every 30 seconds; a running write delays the next, nothing is lost."""
    return events.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(processingTime=f"{fixed.FLUSH_SECONDS} seconds").start()


def action(kind: Column, pending: Column, visible: Column, on_row: Column, moved: Column, typed_matches: Column) -> Column:
    """What an edit event leads to: validate, keep, trim, dismiss or trigger (or both of these), else nothing."""
    cursor = (
        F.when(pending, "validate").when(visible & on_row & (moved == 0), "keep").when(visible & on_row & (moved > 0) & typed_matches, "trim")
        .when(visible, "dismiss and trigger").otherwise("trigger")
    )
    return F.when(kind == "CursorMovedI", cursor).when(kind == "InsertEnter", "trigger").when(kind.isin("InsertLeave", "BufLeave"), "dismiss").otherwise("nothing")


def finish(query) -> None:
    """Writes all that a stream has received and stops it."""
    query.processAllAvailable()
    query.stop()
