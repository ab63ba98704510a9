"""Context sources: neighbour buffers, diagnostics, identifiers, definitions, syntax nodes, symbols."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.functions import fixed
from inkwell.functions.text import lines, plausible_name, truncated
from inkwell.sources.shared import written


def neighbours(buffers: DataFrame, current: Column, most: int = fixed.MAX_BUFFERS, most_lines: int = fixed.MAX_LINES_PER_BUFFER) -> DataFrame:
    """(id, n_buffers, content) for the ``current`` ones of buffers (id, filetype, text).

    The first ``most`` other buffers of the same filetype in id order, non-empty, their first lines. Buffers with
    loaded, listed and name must be eligible ones, and each comes under its name. Only the first most + 1 of a
    filetype can ever be among them, so they are found once and joined: the self-join never sees more than that
    many rows a filetype.
    """
    usable = buffers.where(F.col("text").isNotNull() & (F.col("text") != ""))
    head = F.array_join(F.slice(lines(F.col("text")), 1, most_lines), "\n")
    if {"loaded", "listed", "name"} <= set(buffers.columns):
        usable = eligible_buffers(buffers)
        head = F.concat(F.lit(fixed.BUFFER_NAME), F.col("name"), F.lit("\n\n"), head)
    first = usable.withColumn("r", F.row_number().over(Window.partitionBy("filetype").orderBy("id"))).where(F.col("r") <= most + 1)
    first = first.groupBy("filetype").agg(F.array_sort(F.collect_list(F.struct("id", head.alias("head")))).alias("firsts"))
    cur = buffers.where(current).select("id", "filetype").join(first, "filetype", "left")
    others = F.slice(F.filter("firsts", lambda x: x["id"] != F.col("id")), 1, most)
    cur = cur.withColumn("others", F.coalesce(others, F.array().cast("array<struct<id:bigint,head:string>>")))
    content = F.when(F.size("others") > 0, F.concat(F.lit(fixed.BUFFERS_HEADER), F.array_join(F.transform("others", lambda x: x["head"]), "\n\n"))).otherwise("")
    return cur.select("id", F.size("others").cast("long").alias("n_buffers"), content.alias("content"))


def diagnostic_line(severity: Column, lnum: Column, message: Column) -> Column:
    name = reduce(lambda acc, kv: acc.when(severity == kv[0], kv[1]), fixed.SEVERITIES.items(), F.when(F.lit(False), ""))
    return F.concat(F.lit("["), F.coalesce(name, F.lit("INFO")), F.lit("] Line "), (lnum + 1).cast("string"), F.lit(": "), message)


def diagnostics(rows: DataFrame, cursor: Column, reach: int = fixed.DIAGNOSTIC_RANGE, most: int = fixed.MAX_DIAGNOSTICS) -> DataFrame:
    """(buffer, n, content): the ``most`` most severe of (buffer, id, lnum, severity, message) around the cursor's line.

    Ties go to the cursor's own line, then the smaller id. Rank filters become partial per task, so a buffer
    with many diagnostics does not meet in one place whole.
    """
    near = rows.withColumn("cursor", cursor).where(F.col("lnum").between(F.greatest(F.col("cursor") - reach, F.lit(0)), F.col("cursor") + reach))
    order = Window.partitionBy("buffer").orderBy("severity", F.col("lnum") != F.col("cursor"), "id")
    top = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    text = F.transform(F.array_sort(F.collect_list(F.struct("rank", diagnostic_line(F.col("severity"), F.col("lnum"), F.col("message")).alias("t")))), lambda x: x["t"])
    return top.groupBy("buffer").agg(F.count(F.lit(1)).alias("n"), F.concat(F.lit(fixed.DIAGNOSTICS_HEADER), F.array_join(text, "\n")).alias("content"))


def diagnostics_content(diagnostic: Column, symbols: Column, hover: Column) -> Column:
    """struct<content, has_diagnostics, has_hover>: the non-empty parts, a blank line between."""
    has = lambda c: F.coalesce(c != "", F.lit(False))
    return F.struct(F.concat_ws("\n\n", *[F.when(has(c), c) for c in (diagnostic, symbols, hover)]).alias("content"), has(diagnostic).alias("has_diagnostics"), has(hover).alias("has_hover"))


def first_of_each(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows that agree in ``keys``, the one with the least ``order``. Combined per task before the shuffle."""
    rest = [c for c in rows.columns if c not in keys and c != order]
    if not rest:  # a plain minimum has a hash aggregate, a struct's has none
        return rows.groupBy(*keys).agg(F.min(order).alias(order))
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(order, *rest), order).alias("_best"))
    return best.select(*keys, "_best.*")


def reserved_names(spark: SparkSession) -> DataFrame:
    """(filetype, name): names never looked up; a null filetype stands for all."""
    rows = [(None, n) for n in fixed.SKIP_NAMES] + [(ft, n) for ft, names in fixed.SKIP_NAMES_BY_FILETYPE.items() for n in names]
    return spark.createDataFrame(rows, "filetype string, name string")


def without_reserved(tokens: DataFrame, reserved: DataFrame, filetype: str = "filetype") -> DataFrame:
    """Tokens whose (filetype, name) is not reserved.

    ``reserved`` is a fixed list of some dozens of names, so it is sent to all tasks and nothing is shuffled.
    """
    general = reserved.where(F.col("filetype").isNull()).select("name")
    own = reserved.where(F.col("filetype").isNotNull()).withColumnRenamed("filetype", filetype)
    return tokens.join(F.broadcast(general), "name", "left_anti").join(F.broadcast(own), [filetype, "name"], "left_anti")


def coalesced(keys: DataFrame, key: str, sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """``keys`` with source and value from the first of ``sources`` (name, rows of (key, value)) that has the key."""
    out = keys
    for i, (_, rows) in enumerate(sources):
        out = out.join(rows.select(F.col(key), F.col("value").alias(f"v{i}")), key, "left")
    name = reduce(lambda acc, i: acc.when(F.col(f"v{i}").isNotNull(), sources[i][0]), range(len(sources)), F.when(F.lit(False), ""))
    return out.select(*keys.columns, name.alias("source"), F.coalesce(*[F.col(f"v{i}") for i in range(len(sources))]).alias("value"))


def definitions(resolved: DataFrame, most: int = fixed.MAX_DEFINITIONS, reach: int = fixed.MAX_LINES) -> DataFrame:
    """(request, n, content) from (request, visit, name, path, start_line, code, current_path, cursor, cwd).

    A place counts once, at its first visit, before anything else; those visible around the cursor and those
    without code go; then at most ``most`` stay, in order of visit.
    """
    once = first_of_each(resolved, ["request", "path", "start_line"], "visit")
    seen = (F.col("path") == F.col("current_path")) & F.col("start_line").between(F.col("cursor") - reach, F.col("cursor") + reach)
    kept = once.where(~F.coalesce(seen, F.lit(False)) & (F.col("code") != ""))
    kept = kept.withColumn("r", F.row_number().over(Window.partitionBy("request").orderBy("visit"))).where(F.col("r") <= most)
    shown = F.when(F.col("path").startswith(F.col("cwd")), F.substring("path", F.length("cwd") + 2, F.length("path"))).otherwise(F.col("path"))
    part = F.concat(F.lit("-- definition: "), F.col("name"), F.lit(" ("), shown, F.lit(":"), F.col("start_line").cast("string"), F.lit(")\n"), F.col("code"))
    text = F.transform(F.array_sort(F.collect_list(F.struct("r", part.alias("t")))), lambda x: x["t"])
    return kept.groupBy("request").agg(F.count(F.lit(1)).alias("n"), F.concat(F.lit(fixed.DEFINITIONS_HEADER + "\n"), F.array_join(text, "\n")).alias("content"))


def enclosing(points: DataFrame, spans: DataFrame, by: list[str], width: int = 1024) -> DataFrame:
    """``points`` (by, at) with the first span (by, first, last) that holds ``at``; without one they go.

    Spans are listed under each stretch of ``width`` positions that they touch, so that the join is one of
    equality on (by, stretch), followed by the exact test.
    """
    cells = spans.withColumn("_cell", F.explode(F.sequence((F.col("first") / width).cast("long"), (F.col("last") / width).cast("long"))))
    p = points.withColumn("_cell", (F.col("at") / width).cast("long"))
    hit = p.join(cells, [*by, "_cell"]).where(F.col("at").between(F.col("first"), F.col("last"))).drop("_cell")
    own = [c for c in spans.columns if c not in by]
    best = hit.groupBy(*points.columns).agg(F.min(F.struct(*sorted(own, key=lambda c: (c != "first", c != "last")))).alias("_span"))
    return best.select(*points.columns, "_span.*")


def node_at(points: DataFrame, nodes: DataFrame, by: list[str], width: int = 1024) -> DataFrame:
    """``points`` (by, at) with the smallest node (by, node_id, first, last) that covers them, met on stretches as in ``enclosing``."""
    cells = nodes.withColumn("_cell", F.explode(F.sequence((F.col("first") / width).cast("long"), (F.col("last") / width).cast("long"))))
    p = points.withColumn("_cell", (F.col("at") / width).cast("long"))
    hit = p.join(cells, [*by, "_cell"]).where(F.col("at").between(F.col("first"), F.col("last")))
    rest = [c for c in nodes.columns if c not in by]
    best = hit.groupBy(*points.columns).agg(F.min_by(F.struct(*rest), F.struct(F.col("last") - F.col("first"), "node_id")).alias("_node"))
    return best.select(*points.columns, "_node.*")


def identifiers(nodes: DataFrame, start: Column, end: Column) -> DataFrame:
    """Identifier nodes that overlap lines ``start`` to before ``end``, in pre-order."""
    return nodes.where((F.col("sr") <= end - 1) & (F.col("er") >= start - 1) & F.col("type").isin(*fixed.IDENTIFIER_TYPES))


def containers(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("type").isin(*fixed.CONTAINER_TYPES))


def named_functions(symbols: DataFrame, start: Column | int, end: Column | int) -> DataFrame:
    """Functions, methods and constructors that start between two lines; plain functions only with a real name."""
    return symbols.where(F.col("kind").isin(*fixed.FUNCTION_KINDS) & ((F.col("kind") != "Function") | plausible_name(F.col("name"))) & F.col("line").between(start, end))


def flattened(symbols: DataFrame, levels: int = 32) -> DataFrame:
    """Symbols (id, parent, name) with depth and path of names, roots first; trees deeper than ``levels`` are an error.

    One join a level, with the parents of the level before, which is written first so that no level is
    computed twice; it ends with the deepest.
    """
    level = symbols.where(F.col("parent").isNull()).select("id", F.lit(0).alias("depth"), F.array("name").alias("path"))
    out = [level]
    for depth in range(1, levels + 1):
        level = symbols.join(level.select(F.col("id").alias("parent"), F.col("path").alias("_up")), "parent").select("id", F.lit(depth).alias("depth"), F.concat("_up", F.array("name")).alias("path"))
        level = written(level, "symbols")
        if level.isEmpty():
            return reduce(DataFrame.unionByName, out)
        out.append(level)
    raise ValueError(f"symbols are nested deeper than {levels} levels")


def ancestors(nodes: DataFrame, kinds: tuple[str, ...] | None = None, most: int = fixed.MAX_PARENTS, budget: int = fixed.MAX_CONTEXT_SIZE, levels: int | None = None) -> DataFrame:
    """(id, n_parents, content): each node's ancestors, outermost first, of nodes (id, parent, type, text).

    Going up, ancestors of ``kinds`` (all if None) are taken until ``most`` are, or one would take the total
    size over ``budget``. One join a level; without kinds, ``most`` levels settle it. With kinds, and ``levels``
    not given, it climbs until nothing is open, and each level is written so that none is computed twice.
    """
    up = nodes.select(F.col("id").alias("_at"), F.col("parent").alias("_up"), F.col("type").alias("_type"), F.col("text").alias("_text"))
    state = nodes.select("id", F.col("parent").alias("at"), F.array().cast("array<string>").alias("parts"), F.lit(0).alias("size"), F.lit(False).alias("done"))
    open_ended = kinds is not None and levels is None
    for _ in range(nodes.count() if open_ended else levels or most):
        s = state.join(up, F.col("at") == F.col("_at"), "left")
        wanted = F.col("_at").isNotNull() & ~F.col("done")
        if kinds is not None:
            wanted = wanted & F.col("_type").isin(*kinds)
        fits = F.col("size") + F.length("_text") <= budget
        take = F.coalesce(wanted & fits, F.lit(False))
        part = F.concat(F.lit("-- ["), F.col("_type"), F.lit("]\n"), F.col("_text"))
        parts = F.when(take, F.concat(F.array(part), F.col("parts"))).otherwise(F.col("parts"))
        size = F.col("size") + F.when(take, F.length("_text")).otherwise(0)
        done = F.col("done") | F.coalesce(wanted & ~fits, F.lit(False)) | (F.size(parts) >= most) | (size >= budget)
        state = s.select("id", F.col("_up").alias("at"), parts.alias("parts"), size.alias("size"), done.alias("done"))
        if open_ended:
            state = written(state, "ancestors")
            if state.where(F.col("at").isNotNull() & ~F.col("done")).isEmpty():
                break
    return state.select("id", F.size("parts").cast("long").alias("n_parents"), F.array_join("parts", "\n\n").alias("content"))


def node_content(kind: Column, parents: Column) -> Column:
    """A node's type and its ancestors, cut to the size limit."""
    return truncated(F.when(parents != "", F.concat(F.lit("-- Current node: "), kind, F.lit("\n-- Parent context:\n"), parents)).otherwise(F.concat(F.lit("-- Current node: "), kind)))


def adjacent(comments: DataFrame, functions: DataFrame, by: list[str]) -> DataFrame:
    """Comments (by, first, last) with the function (by, f_first, f_last) that begins on the next line, if one does."""
    f = functions.withColumn("_at", F.col("f_first") - 1)
    return comments.join(f, [comments[b] == f[b] for b in by] + [comments["last"] == f["_at"]], "left").select(*[comments[c] for c in comments.columns], "f_first", "f_last")


def has_code(text: Column, root_kinds: Column | None = None) -> Column:
    """Whether the root of the syntax tree has a child that is no comment, by ``root_kinds`` (their kinds).

    Where there is no tree (null, or none given): whether any line is not blank.
    """
    filled = F.exists(lines(text), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]"))
    return filled if root_kinds is None else F.when(root_kinds.isNull(), filled).otherwise(F.exists(root_kinds, lambda k: k != "comment"))


def cursor_kind(code: Column, in_comment_before_function: Column, in_function: Column) -> Column:
    """init without code; comment_func in a comment right above a function; impl in a function; else unknown."""
    return F.when(~code, "init").when(in_comment_before_function, "comment_func").when(in_function, "impl").otherwise("unknown")


def chosen_model(running: DataFrame, configured: DataFrame, defaults: DataFrame, by: str) -> DataFrame:
    """(by, model): per catalogue the model to ask.

    Running models that are configured are viable. Without any, or where the default runs, it is the default;
    else the first viable in the order of (by, model, position).
    """
    viable = running.join(configured.select(by, "model").distinct(), [by, "model"], "left_semi").groupBy(by).agg(F.min_by("model", "position").alias("viable"))
    up = running.select(by, F.col("model").alias("default")).distinct().withColumn("up", F.lit(True))
    d = defaults.join(viable, by, "left").join(up, [by, "default"], "left")
    return d.select(by, F.when(F.col("viable").isNull() | F.col("up").isNotNull(), F.col("default")).otherwise(F.col("viable")).alias("model"))


def capable(clients: DataFrame, capabilities: DataFrame, method: str) -> DataFrame:
    """Clients that announce a method."""
    return clients.join(capabilities.where(F.col("method") == method).select("client").distinct(), "client", "left_semi")


def eligible_buffers(buffers: DataFrame) -> DataFrame:
    """Buffers that may serve as context: loaded, listed, named and not empty."""
    return buffers.where(F.coalesce("loaded", F.lit(False)) & F.coalesce("listed", F.lit(False)) & (F.col("name") != "") & (F.col("text") != ""))


def location(reply: Column) -> Column:
    """struct<path, start_line, end_line> of a definition reply in JSON, of either shape; lines from 1; null without place.

    Without an end the place ends on its first line.
    """
    get = lambda path: F.get_json_object(reply, path)
    uri = F.coalesce(get("$.uri"), get("$.targetUri"))
    shapes = ("range", "targetSelectionRange", "targetRange")
    has = [get(f"$.{s}").isNotNull() for s in shapes]
    pick = lambda part: F.when(has[0], get(f"$.range.{part}.line")).when(has[1], get(f"$.targetSelectionRange.{part}.line")).when(has[2], get(f"$.targetRange.{part}.line")).cast("int")
    start = F.coalesce(pick("start"), F.lit(0)) + 1
    place = F.struct(F.regexp_replace(uri, "^file://", "").alias("path"), start.alias("start_line"), (F.coalesce(pick("end"), start - 1) + 1).alias("end_line"))
    return F.when(uri.isNotNull() & (has[0] | has[1] | has[2]), place)


def node_text(text: Column, sr: Column, sc: Column, er: Column, ec: Column) -> Column:
    """The text of a range: rows from 0, columns from 0, the last exclusive."""
    ls = F.slice(lines(text), sr + 1, F.greatest(er - sr + 1, F.lit(0)))
    n = F.size(ls)
    one = F.substring(F.get(ls, F.lit(0)), sc + 1, F.greatest(ec - sc, F.lit(0)))
    many = F.transform(ls, lambda x, i: F.when(i == 0, F.substring(x, sc + 1, F.length(x))).when(i == n - 1, F.substring(x, F.lit(1), ec)).otherwise(x))
    return F.when(n == 0, "").when(n == 1, one).otherwise(F.array_join(many, "\n"))
