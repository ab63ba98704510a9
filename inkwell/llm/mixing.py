"""Mixing sources to target weights with hash-threshold histograms, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, shielded, word_count, written

#: Hash bits: LEVELS nested histograms of 2**BITS buckets each. Buckets of the last level hold about
#: one document in 2**36 of a source.
LEVELS, BITS = 3, 12
#: Sources up to this count are sent to all executors (about 100 bytes each); more are joined.
SMALL = 50_000


def doc_hash(doc_id: Column) -> Column:
    """The first 36 bits of the MD5 of the id's decimal form: engine independent, so reruns agree."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, LEVELS * BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, cycle: int = 3, share: float = 1.0, most: int = 3) -> DataFrame:
    """(source, source_size) to (source, source_size, weight, target).

    Sources by code point, null last, weigh 1 to ``cycle``, repeating. Targets share ``share`` of all
    sizes by weight (equal caps per weight go by source); one above ``most`` times its source's size stops there and the excess goes to the
    others by weight. That is a water level: in order of cap per weight, a source is capped while its cap
    lies below its share of what earlier caps leave, so one ordered pass settles it. One row per source.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    every = Window.partitionBy()
    cap = (F.lit(most) * F.col("source_size")).cast("decimal(38,0)")
    s = sizes.withColumn("weight", ((rank - 1) % cycle + 1).cast("long")).withColumn("cap", cap)
    s = s.withColumn("budget", F.floor(F.sum("source_size").over(every) * share).cast("decimal(38,0)")).withColumn("weights", F.sum("weight").over(every))
    before = Window.orderBy((F.col("cap").cast("double") / F.col("weight")), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0)).cast("decimal(38,0)"))
    s = s.withColumn("w_before", F.coalesce(F.sum("weight").over(before), F.lit(0)).cast("long"))
    level = F.col("weight") * (F.col("budget") - F.col("cap_before")).cast("double") / (F.col("weights") - F.col("w_before"))
    s = s.withColumn("capped", F.col("cap").cast("double") < level)
    left = F.col("budget").cast("double") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(every), F.lit(0)).cast("double")
    open_w = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(every)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * left / open_w)
    return s.withColumn("target", target).select("source", "source_size", "weight", "target")


def thresholds(narrow: DataFrame, goals: DataFrame, levels: int = LEVELS, bits: int = BITS) -> DataFrame:
    """(source, size, h) and per-source goals to goals with ``passes``, ``cut``.

    Whole passes take each document that many times; documents whose hash lies below ``cut`` are taken
    once more. ``cut`` is found from the top bits down: each level sums sizes by bucket, keeps the buckets
    below the one in which the rest of the target falls, and looks only into that one at the next level.
    At the last level its bucket is in or out, whichever comes nearer to the target.
    """
    by = Window.partitionBy("source").orderBy("b")
    n = 1 << bits
    g = goals.withColumn("passes", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(3))).otherwise(F.lit(0)).cast("long"))
    g = g.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")).withColumn("prefix", F.lit(0).cast("long")).withColumn("open", F.col("rest") > 0)
    levels_read: list[DataFrame] = []
    for level in range(levels):
        shift = bits * (levels - 1 - level)
        cells = narrow if level == 0 else same_source(narrow, g.select("source", "prefix", "open")).where(F.col("open") & (F.shiftright("h", shift + bits) == F.col("prefix")))
        hist = cells.groupBy("source", F.shiftright("h", shift).alias("b")).agg(F.sum("size").alias("words"))
        run = hist.withColumn("upto", F.sum("words").over(by)).withColumnRenamed("source", "of")
        run = g.join(run, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
        last = level == levels - 1
        reached = F.col("upto") >= F.col("rest")
        found = F.min(F.when(reached, F.struct("b", (F.col("upto") - F.col("words")).alias("under"), "words")))
        keys = ["source", "source_size", "weight", "target", "passes", "rest", "prefix", "open"]
        g = run.groupBy(*keys).agg(found.alias("at"), F.max("b").alias("top"))
        g = g.withColumn("open", F.col("open") & F.col("at").isNotNull())
        # rounding can leave the rest above the last running sum: then all buckets are in
        beyond = F.coalesce(F.col("top") + 1, F.col("prefix") * n)
        prefix = F.when(F.col("rest") <= 0, 0).when(F.col("at").isNotNull(), F.col("at.b")).otherwise(beyond)
        if last:
            nearer = (F.col("at.under") + F.col("at.words") - F.col("rest")) < (F.col("rest") - F.col("at.under"))
            prefix = prefix + F.when(F.col("open") & nearer, 1).otherwise(0)
        rest = F.when(F.col("open") & F.lit(not last), F.col("rest") - F.col("at.under")).otherwise(F.col("rest"))
        # one row a source, written so that the next level does not count this one again
        before, g = levels_read, written(g.withColumn("prefix", prefix.cast("long")).withColumn("rest", rest).drop("at", "top"), "mix-level")
        forget(*before)
        levels_read = [g]
    return g.select("source", "source_size", "target", "passes", F.col("prefix").alias("cut"))


def same_source(left: DataFrame, goals: DataFrame) -> DataFrame:
    """``left`` with its source's columns; goals have one row per source, sent whole only if few."""
    right = goals.withColumnRenamed("source", "of_source")
    if goals.limit(SMALL + 1).count() <= SMALL:
        right = F.broadcast(right)
    return left.join(right, F.col("source").eqNullSafe(F.col("of_source")), "inner").drop("of_source")


def plan(docs: DataFrame, cycle: int = 3, share: float = 1.0, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, size, h) of all documents, and (source, source_size, target, passes, cut)."""
    narrow = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), doc_hash(F.col("doc_id")).alias("h"))
    narrow = written(narrow, "mix")
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = written(targets(sizes, cycle, share, most), "mix-targets")
    return narrow, thresholds(narrow, goals)


def times(h: Column, most: int = 3) -> Column:
    """How often a document of this hash is taken, next to its source's passes and cut."""
    return F.least(F.col("passes") + F.when(h < F.col("cut"), 1).otherwise(0), F.lit(most))


def mix(docs: DataFrame, cycle: int = 3, share: float = 1.0, most: int = 3) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, taken.

    size is the number of words of the whole text, however long (null or blank text: 0). taken is size times how often the mix takes the
    document, 0 to ``most``. An empty table gives an empty result; rows that repeat an id share its hash and
    stand or fall together, as do ids of equal hash; a null source is a source. Columns other than doc_id, text and source are ignored.
    """
    narrow, cuts = plan(docs, cycle, share, most)
    out = same_source(narrow, cuts)
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * times(F.col("h"), most)).cast("long").alias("taken"))


def repeated(docs: DataFrame, cycle: int = 3, share: float = 1.0, most: int = 3) -> DataFrame:
    """``docs`` as the mix takes them: rows taken twice come twice, rows not taken are gone.

    Each row is judged by its own hash and its source's cut, so texts are not shuffled.
    """
    rows, back = shielded(docs, "doc_id", "text", "source")
    _, cuts = plan(rows, cycle, share, most)
    rows = same_source(rows, cuts.select("source", "passes", "cut"))
    rows = rows.withColumn("times", times(doc_hash(F.col("doc_id")), most)).where(F.col("times") > 0)
    return back(rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))))
