"""Prompts of both modes as one struct: mode, messages, prefix, suffix."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.functions import fixed

MESSAGES = "array<struct<role:string,content:string>>"
PROMPT = f"struct<mode:string,messages:{MESSAGES},prefix:string,suffix:string>"


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chat(before: Column, after: Column, filetype: Column, context: Column | None = None, rejected: Column | None = None) -> Column:
    """System text, one tagged user message, then a pair of messages for each rejected completion."""
    system = F.concat(F.lit(fixed.CHAT_SYSTEM_1), filetype, F.lit(fixed.CHAT_SYSTEM_2), filetype, F.lit(fixed.CHAT_SYSTEM_3))
    if context is not None:
        system = F.concat(system, F.when(context != "", F.concat(F.lit(fixed.CHAT_CONTEXT), context)).otherwise(""))
    user = F.concat(F.lit(fixed.PREFIX_OPEN), before, F.lit(fixed.PREFIX_CLOSE + fixed.SUFFIX_OPEN), after, F.lit(fixed.SUFFIX_CLOSE + fixed.MIDDLE_OPEN))
    messages = F.array(message("system", system), message("user", user)).cast(MESSAGES)
    if rejected is not None:
        pairs = F.flatten(F.transform(rejected, lambda r: F.array(message("assistant", r), message("user", F.lit(fixed.REJECTED_REPLY)))))
        messages = F.concat(messages, F.coalesce(pairs, F.array()).cast(MESSAGES))
    return F.struct(F.lit("chat").alias("mode"), messages.alias("messages"), F.lit(None).cast("string").alias("prefix"), F.lit(None).cast("string").alias("suffix"))


def fim(before: Column, after: Column, context: Column | None = None) -> Column:
    """The text before the cursor, after the context and a line feed unless the context is null, and the text after."""
    prefix = before if context is None else F.when(context.isNotNull(), F.concat(context, F.lit("\n"), before)).otherwise(before)
    return F.struct(F.lit("fim").alias("mode"), F.lit(None).cast(MESSAGES).alias("messages"), prefix.alias("prefix"), after.alias("suffix"))


def formatted(name: Column, before: Column, after: Column, filetype: Column, context: Column, rejected: Column) -> Column:
    """The prompt of the named formatter. Only chat gets the context."""
    return F.when(name == "chat", chat(before, after, filetype, context, rejected)).otherwise(fim(before, after))


def split_system(messages: Column) -> tuple[Column, Column]:
    """(content of the last system message, the other messages in order)."""
    last = F.try_element_at(F.filter(messages, lambda m: m["role"] == "system"), F.lit(-1))["content"]
    return last, F.filter(messages, lambda m: m["role"] != "system")
