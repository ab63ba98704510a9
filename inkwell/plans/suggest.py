"""The whole request path as one lazy plan: window, context, prompt, response, clean-up, verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import fixed
from inkwell.functions import text as T
from inkwell.operators import merge, prompt, window
from inkwell.registry import Registry
from inkwell.streaming import events


def eligible(requests: DataFrame, ignored: tuple[str, ...] = ()) -> DataFrame:
    """Requests made in insert mode, in filetypes that are not ignored."""
    return requests.where((F.col("mode") == "i") & ~F.coalesce(F.col("filetype").isin(*ignored) if ignored else F.lit(False), F.lit(False)))


def with_prompts(requests: DataFrame, registry: Registry | None = None, n: int = fixed.MAX_LINES, strategy: str = "weighted") -> DataFrame:
    """``requests`` (request, text, filetype, line, col, formatter, rejected, ...) with before, after and prompt.

    Context is gathered only for formatters that take it: the others' requests never reach the providers.
    """
    r = requests.withColumn("_w", window.line_window(F.col("text"), F.col("line"), F.col("col"), n))
    r = r.withColumn("before", F.col("_w.lines_before")).withColumn("after", F.col("_w.lines_after")).drop("_w")
    name = T.formatter_name(F.col("formatter"), F.lit(None).cast("string"))
    context = F.lit(None).cast("string")
    if registry is not None and registry.providers:
        asking = r.where(name.isin(*registry.takes_context))
        merged = (merge.weighted if strategy == "weighted" else merge.concatenated)(registry.gather(asking), "request").select("request", F.col("content").alias("_context"))
        r, context = r.join(merged, "request", "left"), F.col("_context")
    return r.withColumn("prompt", prompt.formatted(name, F.col("before"), F.col("after"), F.col("filetype"), context, F.col("rejected"))).drop("_context")


def with_completions(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """``requests`` with the clean completions of responses (request, completions); none answered: null."""
    r = requests.join(responses.select("request", F.col("completions").alias("raw")), "request", "left")
    return r.withColumn("completions", T.postprocessed(F.col("raw"), F.col("before"), F.col("after")))


def used(requests: DataFrame, stale: Column, mode: Column, deferred: Column, row: Column, col: Column) -> DataFrame:
    """``requests`` with the verdict on their results, given where the cursor was when they came."""
    return requests.withColumn("verdict", events.verdict(stale, mode, deferred, F.col("line"), F.col("col"), row, col, F.size(F.coalesce("completions", F.array().cast("array<string>")))))
