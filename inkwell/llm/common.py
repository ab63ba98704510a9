"""What the operators of this subpackage share: text classes, sessions for Python workers, columns of any name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.sources.shared import forget, mapped, reachable, shared_folder, worker_written, written  # noqa: F401

#: White space of all contracts (code points 0x20 and 0x09 to 0x0D) and a maximal run of anything else.
SPACES = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Text in one Arrow batch, about.
BATCH_BYTES = "4m"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shielded(docs: DataFrame, *own: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with all columns but ``own`` under names that nothing else has, and the way back to its own columns."""
    names = docs.columns
    inner = [c if c in own else f"__{i}" for i, c in enumerate(names)]
    return docs.toDF(*inner), lambda df: df.select(*inner).toDF(*names)


def ready(spark: SparkSession) -> None:
    """Prepares a session for Python workers.

    They find this package where it is not installed but lies at the same path, and get texts in batches of
    a few MB, since a batch is in memory several times, in the JVM and in a worker.
    """
    reachable(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z lowered and nothing else. ``lower`` is the fast path where every character is one byte."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_list(text: Column) -> Column:
    """The words of a text; null counts as empty."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    """Number of words, as long. Runs of white space become one blank, so that blanks can be counted."""
    flat = F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D\x20]+", " "))
    blanks = F.octet_length(flat) - F.octet_length(F.replace(flat, F.lit(" "), F.lit("")))
    return F.when(flat == "", F.lit(0)).otherwise(blanks + 1).cast("long")
