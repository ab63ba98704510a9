"""Dropping lines that many documents share, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, ascii_lower, shielded, written

MIN_CHARS, MIN_DOCS = 40, 5


def lines_of(text: Column) -> Column:
    r"""A text's lines, split at \n; null and empty have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def text_hash(text: Column) -> Column:
    """Tells rows of one id with different texts apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def long_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, th, k1, k2, at): one row per line of at least ``min_chars``; th is the text's hash, k1 and k2 are 128 bits of the line's key."""
    lines = docs.where(F.length("text") >= min_chars).select("doc_id", text_hash(F.col("text")).alias("th"), F.posexplode(lines_of(F.col("text"))).alias("at", "line"))
    lines = lines.where(F.length("line") >= min_chars).withColumn("line", F.btrim(F.col("line"), F.lit(SPACES)))
    lines = lines.where(F.length("line") >= min_chars).select("doc_id", "th", "at", ascii_lower(F.col("line")).alias("key"))
    return lines.select("doc_id", "th", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit("second"), "key").alias("k2"), "at")


def shared_lines(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(k1, k2, holder): hashes that ``min_docs`` documents or more hold, and the largest doc_id that does.

    Rows are dealt once, by hash and a salt of the document, so that a line of a third of all documents spreads
    over all tasks and yet one task has all rows of a document and hash. Each task counts a hash's documents and
    keeps the largest with its first position there. These partial rows, at most one per hash and salt, are
    partitioned by ranges of the hash and sorted by hash, document (largest first) and position; two windows
    stream over that order: the first row of a hash is its holder, the sum its number of documents.
    """
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lines.select("k1", "k2", F.pmod(F.hash("doc_id"), F.lit(parts)).alias("salt"), "doc_id", "at").repartition(parts, "k1", "k2", "salt")
    once = dealt.groupBy("k1", "k2", "salt", "doc_id").agg(F.min("at").alias("at"))
    part = once.groupBy("k1", "k2", "salt").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("holder"), F.max_by("at", "doc_id").alias("at"))
    ranged = part.repartitionByRange(parts, "k1", "k2")
    by_key = Window.partitionBy("k1", "k2").orderBy(F.col("holder").desc(), "at")
    every = by_key.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = ranged.select("k1", "k2", "holder", F.row_number().over(by_key).alias("place"), F.sum("n").over(every).alias("docs"))
    return seen.where((F.col("place") == 1) & (F.col("docs") >= min_docs)).select("k1", "k2", "holder")


def keep_maps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, th, n_dropped, gaps): per document and text that loses lines, its keep bitmap, compressed.

    ``gaps`` has one number per dropped line: how many kept lines stand before it since the last one.

    Hashes of shared lines go back to the lines by a join that Spark can split where one hash is hot. Rows that
    repeat an id count as one document; each of its texts has a map of its own. Rows without an id neither lose
    lines nor count. Very long texts and lines only ever pass as hashes.
    """
    lines = written(long_lines(docs.where(F.col("doc_id").isNotNull()), min_chars), "lines")
    hit = lines.join(shared_lines(lines, min_docs), ["k1", "k2"]).where(F.col("doc_id") != F.col("holder"))
    drops = hit.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("at")).alias("drops"))
    gaps = F.transform("drops", lambda x, i: F.when(i == 0, x).otherwise(x - F.get("drops", i - 1) - 1))
    return drops.select("doc_id", "th", F.size("drops").cast("long").alias("n_dropped"), gaps.alias("gaps"))


def apply_maps(docs: DataFrame, maps: DataFrame) -> DataFrame:
    """``docs`` with n_lines, n_dropped and kept_text (a null text gives an empty one)."""
    m = maps.select(F.col("doc_id").alias("map_doc"), F.col("th").alias("map_th"), "n_dropped", "gaps")
    d = docs.join(m, (docs["doc_id"] == m["map_doc"]) & (text_hash(docs["text"]) == m["map_th"]), "left").drop("map_doc", "map_th")
    lines = lines_of(F.col("text"))
    runs = F.flatten(F.transform("gaps", lambda g: F.concat(F.array_repeat(F.lit(True), g), F.array(F.lit(False)))))
    d = d.withColumn("flags", runs)
    kept = F.array_join(F.filter(lines, lambda x, i: F.coalesce(F.get("flags", i), F.lit(True))), "\n")
    d = d.withColumn("n_lines", F.size(lines).cast("long")).withColumn("kept_text", F.when(F.col("gaps").isNull(), F.coalesce("text", F.lit(""))).otherwise(kept))
    return d.withColumn("n_dropped", F.coalesce("n_dropped", F.lit(0)).cast("long")).drop("flags", "gaps")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """All of ``docs`` with n_lines, n_dropped and kept_text in place of any columns of these names.

    A line's key is the line stripped of white space at both ends, A-Z lowered. Keys of ``min_chars`` code
    points or more that ``min_docs`` documents or more hold lose all their lines except in the largest
    doc_id that holds them. Other lines stay as they are, in order. Null and empty texts have one empty line,
    which stays. Texts of any length are whole. Rows that repeat an id are one document when keys are counted, and
    each loses its own shared lines only. An empty table gives an empty result.
    """
    docs = docs.drop("n_lines", "n_dropped", "kept_text")
    names = docs.columns
    rows, _ = shielded(docs, "doc_id", "text")
    inner = rows.columns
    out = apply_maps(rows, keep_maps(rows.select("doc_id", "text"), min_chars, min_docs))
    return out.select(*inner, "n_lines", "n_dropped", "kept_text").toDF(*names, "n_lines", "n_dropped", "kept_text")
