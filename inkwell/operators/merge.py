"""Merging the contexts of a request into one text."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import fixed


def in_time(contexts: DataFrame, timeout_ms: int = fixed.CONTEXT_TIMEOUT_MS) -> DataFrame:
    """Contexts that arrived (arrival_ms after the request) before the timeout; late ones are ignored."""
    return contexts.where(F.col("arrival_ms") <= timeout_ms)


def enabled(providers: DataFrame) -> DataFrame:
    """Providers are enabled unless they say otherwise, and must be available."""
    return providers.where(F.coalesce("enabled", F.lit(True)) & F.coalesce("available", F.lit(False)))


def merged(contexts: DataFrame, by: str, *order: Column) -> DataFrame:
    """(by, n, content): non-empty contents in the given order, a blank line between."""
    rows = contexts.where(F.col("content") != "").select(by, F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col("content").alias("t")).alias("x"))
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), "\n\n").alias("content"))


def concatenated(contexts: DataFrame, by: str) -> DataFrame:
    """In order of arrival."""
    return merged(contexts, by, F.col("arrival"))


def weighted(contexts: DataFrame, by: str) -> DataFrame:
    """By priority, low first; without one a context has the default. Ties go by arrival."""
    return merged(contexts, by, F.coalesce("priority", F.lit(fixed.DEFAULT_PRIORITY)), F.col("arrival"))


def custom(contexts: DataFrame, by: str, merger: Callable[[list[dict]], str]) -> DataFrame:
    """By a function from a request's contexts, in order of arrival, to a text."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("arrival", kind="stable")
        return pd.DataFrame({by: [pdf[by].iloc[0]], "content": [merger(rows.to_dict("records"))]})

    kind = contexts.schema[by].dataType.simpleString()
    return contexts.groupBy(by).applyInPandas(run, f"{by} {kind}, content string")


def within_budget(rows: DataFrame, by: str, order: str, size: str, budget: int) -> DataFrame:
    """Rows of each group in order, until one would take the running sum of ``size`` over ``budget``."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    s = rows.withColumn("_sum", F.sum(size).over(w))
    return s.where(F.col("_sum") <= budget).drop("_sum")
