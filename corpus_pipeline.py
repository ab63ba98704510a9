"""From raw documents to token ids: five stages, each applying one operator of inkwell.llm to all it is given."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import bytebpe, linededup, mixing, neardup, quality
from inkwell.llm.common import ready, shielded, table, worker_written, written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that it rejects go.

    Null texts are scored as empty ones, long texts whole; a score equal to the threshold stays. Rows that repeat
    stand or fall together, rows without an id are scored by their text; columns of any name pass through. An
    empty table stays empty. Without labels of both kinds the classifier treats all documents alike.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    rows, back = shielded(docs, "doc_id", "text")
    return back(quality.score(rows, model).where("predicted = 1"))


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: texts lose the lines that many documents share.

    Null texts stay null, empty ones empty, long ones lose lines like others. Of documents that share a line the
    one with the largest id keeps it. Rows that repeat an id count as one document and lose their own lines only;
    rows without an id lose none. n_chars follows a changed text; other columns, of any name, pass through. An
    empty table stays empty.
    """
    lost = F.col("n_dropped") > 0
    rows, back = shielded(docs, "doc_id", "text", "n_chars")
    out = linededup.dedup_lines(rows)
    out = out.withColumn("text", F.when(lost, F.col("kept_text")).otherwise(F.col("text")))
    return back(out.withColumn("n_chars", F.when(lost, F.length("text").cast("long")).otherwise(F.col("n_chars"))))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup on five-word shingles at 0.8: of each group of near duplicates the smallest id stays.

    Null and empty texts are near duplicates of nothing; long texts count whole; a similarity of 0.8 exactly is a
    link. Rows that repeat an id stay or go together; rows without an id stay. Columns of any name pass through.
    An empty table stays empty.
    """
    ready(spark)
    gone = worker_written(neardup.near_duplicates(docs, 80, 5).where(~F.col("kept")).select("doc_id").distinct(), "gone")
    if gone.limit(neardup.FEW_IDS + 1).count() <= neardup.FEW_IDS:
        gone = F.broadcast(gone)
    rows, back = shielded(docs, "doc_id")
    return back(rows.join(gone, "doc_id", "left_anti"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: documents come as often as the mix takes them, up to three times.

    Null and empty texts have no words; a document's turn goes by its id's hash, so texts of any length are taken
    or left whole and rows that repeat an id go together, as do ids of equal hash. A null source is a source, last
    in order. Columns of any name pass through. An empty table stays empty.
    """
    return mixing.repeated(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: the token ids of each row, and digests of them and of what they decode to.

    Null and empty texts have no tokens; long texts are encoded whole. Each row gives one row, repeats and rows
    without an id too. Other columns, of any name, are left out. An empty table stays empty.
    """
    ready(spark)
    out = bytebpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_shared_lines),
    ("near dedup", keep_one_of_each),
    ("mixing", mix_sources),
    ("byte BPE", encode),
]

#: The classifier's training and the tokens are not expressible in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
