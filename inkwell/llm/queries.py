"""The thin queries over the operators of this subpackage, and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import bytebpe, html, linededup, mixing, neardup, quality, rules, tokencount, topk, urls
from .common import table
from .oracle import ORACLE_SQL  # noqa: F401

URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op1_exact_topk(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op2_mix_sources(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_token_counts(spark, sf_dir):
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), 4096)


def encoded(docs):
    out = bytebpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_byte_bpe(spark, sf_dir):
    return encoded(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op6_minhash_dedup(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), 80, 2)


def op7_html_extract(spark, sf_dir):
    return html.extract(table(spark, sf_dir, "pages"))


def op8_line_dedup(spark, sf_dir):
    d = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op9_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return urls.judge(pages, URL_RULES, urls.train(pages, URL_RULES)).select("page_id", "host", "path", "rule", "verdict")


def op10_quality_rules(spark, sf_dir):
    out = rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {f.__name__: f for f in (op1_exact_topk, op2_mix_sources, op3_token_counts, op4_byte_bpe, op5_quality_classifier, op6_minhash_dedup, op7_html_extract, op8_line_dedup, op9_url_filter, op10_quality_rules)}
