"""The append-only interaction log: requests, responses and acceptances as JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MESSAGE = T.StructType().add("role", T.StringType()).add("content", T.StringType())
_PROMPT = T.StructType().add("mode", T.StringType()).add("messages", T.ArrayType(_MESSAGE)).add("prefix", T.StringType()).add("suffix", T.StringType())
_CURSOR = T.StructType().add("line", T.IntegerType()).add("col", T.IntegerType())
#: One explicit schema for the three kinds; nothing is inferred, since each kind lacks the others' fields.
SCHEMA = (
    T.StructType()
    .add("event_type", T.StringType())
    .add("request_id", T.StringType())
    .add("timestamp", T.LongType())
    .add("cwd", T.StringType())
    .add("filename", T.StringType())
    .add("filetype", T.StringType())
    .add("cursor", _CURSOR)
    .add("lines_before", T.StringType())
    .add("lines_after", T.StringType())
    .add("provider", T.StringType())
    .add("model", T.StringType())
    .add("provider_config", T.VariantType())
    .add("prompt_data", _PROMPT)
    .add("additional_context", T.StringType())
    .add("response_raw", T.VariantType())
    .add("completions", T.ArrayType(T.StringType()))
    .add("response_time_ms", T.DoubleType())
    .add("accepted", T.BooleanType())
    .add("accepted_item_label", T.StringType())
    .add("acceptance_type", T.StringType())
    .add("lines_accepted", T.IntegerType())
    .add("lines_remaining", T.IntegerType())
    .add("accepted_text", T.StringType())
    .add("rejection_reason", T.StringType())
    .add("typed_text", T.StringType())
)
SECRET = ("authorization", "api-key", "api_key", "apikey", "x-api-key", "token", "headers", "extra_headers")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The log; lines that are no JSON are kept whole in _corrupt. An empty list logged as {} reads as null."""
    schema = T.StructType([*SCHEMA.fields]).add("_corrupt", T.StringType())
    log = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return log.withColumn("responses", F.try_variant_get("response_raw", "$", "array<string>"))


def append_log(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def redacted(config: dict) -> dict:
    """A back end's configuration for the log: functions become markers, header-like values are masked."""

    def clean(key: str, value: object) -> object:
        if key.lower() in SECRET:
            return "***"
        if isinstance(value, dict):
            return {k: clean(str(k), v) for k, v in value.items()}
        if isinstance(value, (list, tuple)):
            return [clean("", v) for v in value]
        if value is None or isinstance(value, (str, int, float, bool)):
            return value
        return {"__type": "function" if callable(value) else type(value).__name__}

    return {k: clean(str(k), v) for k, v in config.items()}


def requests(rows: DataFrame) -> DataFrame:
    """Request events of rows that have the columns of a request; others are null."""
    own = ["request_id", "timestamp", "cwd", "filename", "filetype", "cursor", "lines_before", "lines_after", "provider", "model", "prompt_data", "additional_context"]
    return rows.select(F.lit("request").alias("event_type"), *[F.col(c) if c in rows.columns else F.lit(None).alias(c) for c in own])


def responses(rows: DataFrame) -> DataFrame:
    return rows.select(F.lit("response").alias("event_type"), "request_id", "timestamp", F.col("completions").alias("response_raw"), "response_time_ms")


def acceptances(rows: DataFrame) -> DataFrame:
    own = ["request_id", "timestamp", "accepted", "acceptance_type", "lines_accepted", "lines_remaining", "accepted_text", "rejection_reason", "typed_text"]
    return rows.select(F.lit("acceptance").alias("event_type"), *[F.col(c) if c in rows.columns else F.lit(None).alias(c) for c in own])


def outcomes(request: DataFrame, response: DataFrame, acceptance: DataFrame) -> DataFrame:
    """Per request: request_id, answered, n_accepts, accepted (null if unresolved), outcome.

    A request has at most one response but any number of acceptances (several partial ones and a last), so
    these are aggregated first. No acceptance row at all is unresolved, not rejected.
    """
    r = response.groupBy("request_id").agg(F.max("n_completions").alias("n_completions"))
    a = acceptance.groupBy("request_id").agg(F.count(F.lit(1)).alias("n_accepts"), F.bool_or("accepted").alias("accepted"))
    out = request.join(r, "request_id", "left").join(a, "request_id", "left")
    kind = (
        F.when(F.col("n_completions").isNull(), "no response").when(F.col("n_completions") == 0, "empty").when(F.col("accepted").isNull(), "unresolved")
        .when(F.col("accepted"), "accepted").otherwise("rejected")
    )
    return out.select("request_id", F.col("n_completions").isNotNull().alias("answered"), F.coalesce("n_accepts", F.lit(0)).cast("long").alias("n_accepts"), "accepted", kind.alias("outcome"))


def request_id() -> Column:
    """A random identifier for a request."""
    return F.uuid()


def write_lines(lines: DataFrame, path: str) -> None:
    """Appends log lines (one string column) to a text log."""
    lines.write.mode("append").text(path)
