"""Windows of lines around a cursor. Lines and columns of cursors count from 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import fixed
from inkwell.functions.text import lines


def surround(text: Column, start: Column, end: Column, line: Column, col: Column) -> Column:
    """struct<lines_before, lines_after>: lines ``start`` to before ``end``, cut at the cursor."""
    ls = lines(text)
    cur = F.coalesce(F.get(ls, line), F.lit(""))
    before = F.concat(F.slice(ls, start + 1, F.greatest(line - start, F.lit(0))), F.array(F.substring(cur, F.lit(1), col)))
    after = F.concat(F.array(F.substring(cur, col + 1, F.length(cur))), F.slice(ls, line + 2, F.greatest(end - line - 1, F.lit(0))))
    return F.struct(F.array_join(before, "\n").alias("lines_before"), F.array_join(after, "\n").alias("lines_after"))


def line_window(text: Column, line: Column, col: Column, n: int = fixed.MAX_LINES) -> Column:
    """``n`` lines on either side of the cursor's."""
    return surround(text, F.greatest(line - n, F.lit(0)), line + 1 + n, line, col)


def popup_window(text: Column, line: Column, col: Column, n: int = fixed.MAX_LINES) -> Column:
    """As line_window, but one line less after the cursor."""
    return surround(text, F.greatest(line - n, F.lit(0)), line + n, line, col)


def smart_window(text: Column, line: Column, col: Column, kind: Column, inner: Column, n: int = fixed.MAX_LINES) -> Column:
    """The window that suits where the cursor is.

    ``kind`` impl: the enclosing range ``inner`` (struct<first, last>), unless the cursor is within five lines
    of either end of it; comment_func: ``inner``; init: the whole text; anything else: line_window.
    """
    near = (line - inner["first"] < 5) | (inner["last"] - line < 5)
    whole = surround(text, F.lit(0), F.size(lines(text)), line, col)
    ranged = surround(text, inner["first"], inner["last"] + 1, line, col)
    plain = line_window(text, line, col, n)
    return F.when(kind == "init", whole).when((kind == "comment_func") & inner.isNotNull(), ranged).when((kind == "impl") & inner.isNotNull() & ~near, ranged).otherwise(plain)


def range_union(a: Column, b: Column) -> Column:
    """struct<first, last> that spans both; a missing side gives the other."""
    return F.when(a.isNull() & b.isNull(), None).otherwise(F.struct(F.least(a["first"], b["first"]).alias("first"), F.greatest(a["last"], b["last"]).alias("last")))


def exploded(buffers: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, line_no, line)."""
    return buffers.select(key, F.posexplode(lines(F.col("text"))).alias("line_no", "line"))


def line_frames(rows: DataFrame, key: str, before: int, after: int) -> DataFrame:
    """Each line of (key, line_no, line) with the lines before and after it, joined; '' where there are none."""
    w = Window.partitionBy(key).orderBy("line_no")
    join = lambda a, b: F.array_join(F.collect_list("line").over(w.rowsBetween(a, b)), "\n")
    return rows.withColumn("before", join(-before, -1)).withColumn("after", join(1, after))


def declarations(rows: DataFrame, key: str, pattern: str, reach: int = 10) -> DataFrame:
    """Each line with the last of the up to ``reach`` lines before it, itself included, that match ``pattern``."""
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(-reach, 0)
    return rows.withColumn("declaration", F.last(F.when(F.col("line").rlike(pattern), F.col("line")), ignorenulls=True).over(w))
