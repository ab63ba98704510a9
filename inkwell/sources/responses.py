"""Completions out of the JSON bodies of model back ends, and request bodies for them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.functions import fixed


def from_choices(body: Column) -> Column:
    """choices[]: each message's content, else its text; nulls go. Null for a body that is no such object."""
    choices = F.from_json(body, "struct<choices array<struct<message struct<content string>, text string>>>")["choices"]
    return F.filter(F.transform(choices, lambda c: F.coalesce(c["message"]["content"], c["text"])), lambda x: x.isNotNull())


def from_blocks(body: Column) -> Column:
    """content[]: the text of each block that has one."""
    blocks = F.from_json(body, "struct<content array<struct<type string, text string>>>")["content"]
    return F.filter(F.transform(blocks, lambda b: b["text"]), lambda x: x.isNotNull())


def from_generate(body: Column) -> Column:
    """message.content, else response, without end-of-text marks, as one completion; null where both lack."""
    r = F.from_json(body, "struct<message struct<content string>, response string>")
    t = F.replace(F.coalesce(r["message"]["content"], r["response"]), F.lit(fixed.END_OF_TEXT), F.lit(""))
    return F.when(t.isNotNull(), F.array(t))


def chat_body(prompt: Column, model: Column, temperature: float, n: int, max_tokens: int | None = None) -> Column:
    """Body for a chat-completions back end: messages in chat mode, else prompt and suffix."""
    chat = prompt["mode"] == "chat"
    fields = [model.alias("model"), F.lit(temperature).alias("temperature"), F.lit(n).alias("n"), F.lit(False).alias("stream")]
    if max_tokens is not None:
        fields.append(F.lit(max_tokens).alias("max_tokens"))
    fields += [F.when(chat, prompt["messages"]).alias("messages"), F.when(~chat, prompt["prefix"]).alias("prompt"), F.when(~chat, prompt["suffix"]).alias("suffix")]
    return F.to_json(F.struct(*fields))


def blocks_body(prompt: Column, model: Column, max_tokens: int) -> Column:
    """Body for a messages back end: the last system message lifted out; a fill-in prompt wrapped as chat."""
    chat = prompt["mode"] == "chat"
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    wrapped = F.array(message("user", F.concat(F.lit(fixed.FIM_USER_1), F.coalesce(prompt["prefix"], F.lit("")), F.lit(fixed.FIM_USER_2), F.coalesce(prompt["suffix"], F.lit("")))))
    lifted = F.filter(prompt["messages"], lambda m: m["role"] == "system")
    system = F.when(chat, F.try_element_at(lifted, F.lit(-1))["content"]).otherwise(F.lit(fixed.FIM_SYSTEM))
    rest = F.when(chat, F.filter(prompt["messages"], lambda m: m["role"] != "system")).otherwise(wrapped)
    return F.to_json(F.struct(model.alias("model"), F.lit(max_tokens).alias("max_tokens"), rest.alias("messages"), F.lit(False).alias("stream"), system.alias("system")))


def generate_body(prompt: Column, model: Column) -> Column:
    chat = prompt["mode"] == "chat"
    return F.to_json(F.struct(model.alias("model"), F.lit(False).alias("stream"), F.when(chat, prompt["messages"]).alias("messages"), F.when(~chat, prompt["prefix"]).alias("prompt"), F.when(~chat, prompt["suffix"]).alias("suffix")))
