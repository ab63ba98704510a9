"""Text operations of a completion pipeline as Column expressions.

All positions count characters. White space is blank, \\t, \\n, \\v, \\f and \\r, spelt out so that engines agree.
A null argument gives null unless said otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

WS = r"[ \t\n\x0B\f\r]"
NOT_WS = r"[^ \t\n\x0B\f\r]"
KEYWORD = r"[A-Za-z0-9_\x{C0}-\x{FF}]"
OTHER = r"[^A-Za-z0-9_\x{C0}-\x{FF} \t\n\x0B\f\r]"
FENCE = "```"


def text(value: str | Column) -> Column:
    return F.lit(value) if isinstance(value, str) else value


def lines(t: Column) -> Column:
    """Split at line feeds; keeps empty lines, and an empty text has one."""
    return F.split(t, "\n", -1)


def joined(ls: Column) -> Column:
    return F.array_join(ls, "\n")


def trimmed(t: Column) -> Column:
    return F.regexp_replace(t, f"^{WS}+|{WS}+$", "")


def is_blank(t: Column) -> Column:
    return ~t.rlike(NOT_WS)


def tail(ls: Column, start: Column | int) -> Column:
    """Items from the 1-based ``start``."""
    return F.slice(ls, start, F.greatest(F.size(ls), F.lit(1)))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def strip_fences(t: Column) -> Column:
    """Drops a first line that begins with a fence, left-trimming the next, and a last line that does.

    Texts of one line stay. The two cuts are independent.
    """
    ls = lines(t)
    opened = F.get(ls, F.lit(0)).startswith(FENCE)
    rest = tail(ls, 2)
    shifted = F.transform(rest, lambda x, i: F.when(i == 0, F.regexp_replace(x, f"^{WS}+", "")).otherwise(x))
    body = F.when(opened, shifted).otherwise(ls)
    last = F.get(body, F.size(body) - 1)
    closed = F.coalesce(last.startswith(FENCE), F.lit(False))
    kept = F.when(closed, F.slice(body, 1, F.greatest(F.size(body) - 1, F.lit(0)))).otherwise(body)
    return F.when(F.size(ls) < 2, t).otherwise(joined(kept))


def line_set(t: Column) -> Column:
    """The trimmed non-blank lines, each once."""
    return F.array_distinct(F.filter(F.transform(lines(F.coalesce(t, F.lit(""))), trimmed), lambda x: x != ""))


def strip_overlap(t: Column, before: Column, after: Column) -> Column:
    """Drops leading lines that stand before the cursor already and trailing lines that stand after it.

    Trimmed lines are compared. From the start, non-blank lines of ``before`` go. From the end, up to two
    short lines (two bytes or less) may be skipped to reach lines that are blank or of ``after``; if there are
    any, those and the skipped ones go. A text that would lose nothing or everything stays as it is.

    One character a line turns both runs into anchored patterns.
    """

    def cut(v: Column) -> Column:
        lead = F.array_join(F.transform(v["trimmed"], lambda x: F.when((x != "") & F.array_contains(v["before"], x), "B").otherwise("-")), "")
        return let(F.length(F.regexp_extract(lead, "^B+", 0)), lambda start: both(v, start))

    def both(v: Column, start: Column) -> Column:
        kinds = F.transform(F.reverse(tail(v["trimmed"], start + 1)), lambda x: F.when((x == "") | F.array_contains(v["after"], x), "S").when(F.octet_length(x) <= 2, "T").otherwise("L"))
        return let(F.length(F.regexp_extract(F.array_join(kinds, ""), "^T{0,2}S+", 0)), lambda end: kept(v, start, end))

    def kept(v: Column, start: Column, end: Column) -> Column:
        left = F.size(v["lines"]) - start - end
        return F.when(((start == 0) & (end == 0)) | (left <= 0), t).otherwise(joined(F.slice(v["lines"], start + 1, F.greatest(left, F.lit(0)))))

    parts = let(lines(t), lambda ls: F.struct(ls.alias("lines"), F.transform(ls, trimmed).alias("trimmed"), line_set(before).alias("before"), line_set(after).alias("after")))
    return let(parts, cut)


def postprocessed(completions: Column, before: Column, after: Column) -> Column:
    """Both clean-ups on each of an array of completions."""
    return F.transform(completions, lambda c: strip_overlap(strip_fences(c), before, after))


def words(t: Column) -> Column:
    """Maximal runs of one class (keyword characters, or other non-blank ones)."""
    return F.regexp_extract_all(t, F.lit(f"({KEYWORD}+|{OTHER}+)"), F.lit(1))


def runs(t: Column) -> Column:
    """All runs, white space too."""
    return F.regexp_extract_all(t, F.lit(f"({KEYWORD}+|{OTHER}+|{WS}+)"), F.lit(1))


def char_class(c: Column) -> Column:
    """3 for white space, 1 for keyword characters, 2 for others."""
    return F.when(c.rlike(f"^{WS}"), 3).when(c.rlike(f"^{KEYWORD}"), 1).otherwise(2)


def word_spans(t: Column, among: Column | None = None) -> Column:
    """array<struct<first, last>> of the words, 1-based and inclusive; only those ``among`` so many first runs, if given."""
    r = runs(t) if among is None else F.slice(runs(t), F.lit(1), among)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<first:int,last:int>>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        end = acc["at"] + F.length(x)
        span = F.struct((acc["at"] + 1).cast("int").alias("first"), end.cast("int").alias("last"))
        return F.struct(end.alias("at"), F.when(x.rlike(f"^{WS}"), acc["spans"]).otherwise(F.concat(acc["spans"], F.array(span))).alias("spans"))

    return F.aggregate(r, start, step, lambda acc: acc["spans"])


def overlap_words(spec: Column) -> Column:
    """N of ``N+M``, ``N`` or ``+M``; null where absent."""
    return F.nullif(F.regexp_extract(spec, r"^([0-9]+)([+].*)?$", 1), F.lit("")).try_cast("int")


def overlap_chars(spec: Column) -> Column:
    """M as double; null where absent or not a number."""
    return F.nullif(F.regexp_extract(spec, r"^[0-9]*[+]([0-9]*[.]?[0-9]+)$", 1), F.lit("")).try_cast("double")


def overlap_threshold(t: Column, spec: Column) -> Column:
    """How many characters must be typed before a completion ``t`` may show; null if it cannot be told.

    ``N+M``: N whole words and M characters of the next, or that part of it where 0 < M < 1. ``N``: N words and
    what follows up to the next. ``+M``: M characters. Zero words with characters give null.
    """
    n, m = overlap_words(spec), overlap_chars(spec)
    # N+1 words are among the first 2N+3 runs; a lambda's argument is computed once, a column wherever it is named
    enough = F.least(F.coalesce(n, F.lit(0)), F.lit(1_000_000_000)) * 2 + 3

    def found(s: Column) -> Column:
        nxt = F.get(s, n)
        size = nxt["last"] - nxt["first"] + 1
        extra = F.when((m > 0) & (m < 1), F.ceil(m * size)).otherwise(F.least(F.floor(m), size.cast("long")))
        trailing = F.when(F.get(s, n - 1)["last"] < F.length(t), F.length(t))
        no_chars = F.when(nxt.isNotNull(), nxt["first"] - 1).otherwise(trailing)
        out = F.when(n.isNull(), F.floor(m)).when(n < 1, None).when(F.size(s) < n, None).when(m.isNull(), no_chars).when(nxt.isNotNull(), nxt["first"] - 1 + extra)
        return out.cast("int")

    return F.get(F.transform(F.array(word_spans(t, enough)), found), F.lit(0))


def prefix_trimmed(completions: Column, typed: Column) -> Column:
    """Completions that begin with ``typed``, without it; empty rests go, order stays."""
    rests = F.transform(F.filter(completions, lambda c: c.startswith(typed)), lambda c: F.substring(c, F.length(typed) + 1, F.length(c)))
    return F.filter(rests, lambda x: x != "")


def typed_through(completion: Column, typed: Column) -> Column:
    """The rest of a shown completion after typing; null if the typing leaves it."""
    return F.when(completion.startswith(typed), F.substring(completion, F.length(typed) + 1, F.length(completion)))


def typed_since(same_place: Column, line: Column, trigger_col: Column, col: Column) -> Column:
    """What was typed on ``line`` since the trigger; null if buffer or row changed or the cursor moved back."""
    return F.when(same_place & (col >= trigger_col), F.substring(line, trigger_col + 1, col - trigger_col))


def indent(t: Column) -> Column:
    return F.regexp_extract(t, f"^{WS}*", 0)


def accepted(completion: Column, n: Column, before: Column, after: Column) -> Column:
    """struct<kind, inserted, remaining>: accepting the first ``n`` lines between ``before`` and ``after``.

    All lines: kind full, nothing remains. Fewer: kind partial; the next line's indent is taken along, so the
    cursor stands behind it.
    """
    ls = lines(completion)
    nxt = F.get(ls, n)
    lead = indent(nxt)
    part = joined(F.concat(F.array(F.concat(before, F.get(ls, F.lit(0)))), F.slice(ls, 2, F.greatest(n - 1, F.lit(0))), F.array(F.concat(lead, after))))
    rest = joined(F.concat(F.array(F.substring(nxt, F.length(lead) + 1, F.length(nxt))), tail(ls, n + 2)))
    full = n >= F.size(ls)
    return F.struct(
        F.when(full, "full").otherwise("partial").alias("kind"),
        F.when(full, F.concat(before, completion, after)).otherwise(part).alias("inserted"),
        F.when(full, "").otherwise(rest).alias("remaining"),
    )


def paragraph_lines(completion: Column) -> Column:
    """How many lines accepting a paragraph takes: through the first blank line, else all."""
    ls = lines(completion)
    at = F.array_position(F.transform(ls, is_blank), F.lit(True)).cast("int")
    return F.when(at > 0, at).otherwise(F.size(ls))


def next_index(i: Column, n: Column) -> Column:
    """The next of 1 to n, after n comes 1."""
    return F.pmod(i, n) + 1


def previous_index(i: Column, n: Column) -> Column:
    return F.pmod(i - 2, n) + 1


def utf16_offset(t: Column, chars: Column) -> Column:
    """UTF-16 units before the 0-based character ``chars``."""
    return (F.octet_length(F.encode(F.substring(t, F.lit(1), chars), "UTF-16LE")) / 2).cast("int")


def formatter_name(model: Column, configured: Column) -> Column:
    """The model's formatter, else the configured one, else fim; unknown names give fim."""
    name = F.coalesce(model, configured, F.lit("fim"))
    return F.when(name.isin(*fixed.FORMATTERS), name).otherwise("fim")


def formatter_alias(name: Column) -> Column:
    """Old names of formatters to their present ones; others stay, unknown ones give null."""
    out = F.when(name.isin(*fixed.FORMATTERS), name)
    for old, new in fixed.FORMATTER_ALIASES.items():
        out = out.when(name == old, new)
    return out


def log_line(ts: Column, level: Column, message: Column) -> Column:
    return F.format_string("[%s] [%s] %s", F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.coalesce(level, F.lit("UNKNOWN")), message)


def level_number(level: Column) -> Column:
    out = F.when(F.lit(False), 0)
    for name, n in fixed.LOG_LEVELS.items():
        out = out.when(level == name, n)
    return out


def relative_path(path: Column, cwd: Column) -> Column:
    return F.when(path.startswith(cwd), F.substring(path, F.length(cwd) + 2, F.length(path))).otherwise(path)


def hover_text(contents: Column) -> Column:
    """A hover reply's text: a string itself, or the value of an object."""
    v = F.try_parse_json(contents)
    return F.coalesce(F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")), F.try_variant_get(v, "$.value", "string"))


def plausible_name(name: Column) -> Column:
    """Whether a plain function's name names something, rather than standing in for a missing name."""
    return name.rlike(NOT_WS) & ~F.lower(name).isin("function", "lambda", "anonymous") & ~name.rlike(r"^function\(|^vim\.|^\[\d+\]$")


def truncated(t: Column, most: int = fixed.MAX_CONTEXT_SIZE) -> Column:
    """At most ``most`` characters and a mark that the rest is missing."""
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit(fixed.TRUNCATED))).otherwise(t)
