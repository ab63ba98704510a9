"""Token counts, byte-level BPE and top-k search against the libraries and plain arithmetic."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkwell.llm import bytebpe, tokencount, topk

ODD = ["", " ", "  Hello  world\n\tabc ▁x é日本 \U0001f600 á ﬁ", "<s> </s> <unk> <0x41> <|endoftext|>", "a" * 60, " " * 100 + "x" + " " * 57, "привет мир", "it's 'ss I'm", "x　y z\x85q", "\x00x\x1cy", "\n", "a \n b"]
TEXT = st.text(alphabet=st.sampled_from("aeiou thnrs  \n\tABC.,!*0123éñпри日'\x1c\x85\U0001f600▁"), max_size=120)
pieces = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
transducer = tokencount.Transducer(P.path("piece_bpe_32k.model"))
codec = bytebpe.Codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
tik = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bytebpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})


def docs(spark, texts):
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(None, "null id", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, ids int")


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=4))
def test_transducer_equals_the_library(texts):
    assert transducer.counts(texts).tolist() == [len(x) for x in pieces.encode(texts, num_threads=1)]


def test_token_counts(spark):
    texts = [*ODD, None, "word " * 30_000, "x" * 50_000]
    got = {r.doc_id: r for r in tokencount.count_tokens(docs(spark, texts), P.path("piece_bpe_32k.model"), 4096).collect()}
    for i, t in enumerate(texts):
        n = len(pieces.encode(t or "", num_threads=1))
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 4096)
    assert len(got) == len(texts) + 1
    assert tokencount.count_tokens(docs(spark, []).where("false"), P.path("piece_bpe_32k.model")).count() == 0


def test_transducer_starts_anew_when_full(monkeypatch):
    monkeypatch.setattr(tokencount, "MOST_STATES", 10)
    monkeypatch.setattr(tokencount, "MOST_PAIRS", 10)
    t = tokencount.Transducer(P.path("piece_bpe_32k.model"))
    for _ in range(3):
        assert t.counts(ODD).tolist() == [len(x) for x in pieces.encode(ODD, num_threads=1)]


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=4))
def test_codec_equals_the_library(texts):
    for t, ids in zip(texts, codec.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == tik.encode_ordinary(t)
        assert codec.decode(ids) == t.encode()
        cuts = list(range(0, len(ids), 4))
        assert "".join(codec.decode_stream(ids[i : i + 4] for i in cuts)) == t
        for (a, b), i in zip(codec.offsets(t, ids), cuts):
            assert codec.decode(ids[i : i + 4]) in t[a:b].encode()


def test_byte_bpe(spark, monkeypatch):
    monkeypatch.setattr(bytebpe, "MOST_WORDS", 3)
    texts = [*ODD, None, "word thing " * 20_000]
    got = {r.doc_id: r for r in bytebpe.encode(docs(spark, texts), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()}
    for i, t in enumerate(texts):
        want = tik.encode_ordinary(t or "")
        assert got[i].n_tokens == len(want) and bytes(got[i].ids) == np.array(want, "<u4").tobytes() and bytes(got[i].decoded) == (t or "").encode()
    assert bytebpe.encode(docs(spark, []).where("false"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_all_byte_pairs_round_trip():
    text = "".join(chr(c) for c in (*range(0x20, 0x250), 0x20AC, 0x1F600)) * 2
    assert codec.decode(codec.encode([text])[0]) == text.encode()
    assert hashlib.sha256(codec.encode([text])[0]).digest() == hashlib.sha256(np.array(tik.encode_ordinary(text), "<u4").tobytes()).digest()


def plain_top(rows, k):
    good = {(i, tuple(int(np.floor(256 * np.float64(np.float32(x)))) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = {}
    for q, w in good:
        if q % 5 == 0:
            best = sorted((-sum(a * b for a, b in zip(w, v)), i) for i, v in good if i != q and len(v) == len(w))[:k]
            out[q] = [(i, -s) for s, i in best]
    return out


@pytest.mark.parametrize("small", [True, False])
def test_top_k(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(topk, "ROWS", 20)
        monkeypatch.setattr(topk, "QUERIES", 3)
    rnd = random.Random(8)
    rows = [(i, [rnd.choice([0.0, 0.5, -0.25, rnd.uniform(-1, 1)]) for _ in range(6)]) for i in range(120)]
    rows += [rows[3], rows[5], rows[5], (200, None), (205, [1.0, None]), (210, [float("nan")] * 6), (215, [float("inf")] * 6), (None, [0.1] * 6), (220, [0.5, 0.5]), (221, [0.25, 1.0]), (225, [])]
    rows += [(300 + i, rows[0][1]) for i in range(9)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash")).withColumn("width", F.lit(1))
    got = {}
    for r in topk.top_k(d, F.col("vec_id") % 5 == 0, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == {q: v for q, v in plain_top(rows, 5).items() if v}
    assert topk.top_k(d.where("false"), F.col("vec_id") % 5 == 0).count() == 0


def test_top_k_of_large_numbers():
    rng = np.random.default_rng(1)
    v = rng.integers(-(2**28), 2**28, (70, 5))
    index = topk.sliced(np.arange(70), v)
    for i in range(10):
        want = sorted((-int(a), j) for j, a in enumerate(v @ v[i]) if j != i)[:4]
        assert sorted((-s, r) for r, s in topk.best(index, ~index["maps"], i, v[i].tolist(), 4)) == want


@given(st.integers(-(2**40), 2**40))
def test_signed_digits(n):
    d = list(topk.digits(n))
    assert sum(s << t if s > 0 else -(1 << t) for t, s in d) == n
    assert all(b - a > 1 for (a, _), (b, _) in zip(d, d[1:]))


def test_texts_without_blanks_are_cut_and_composed():
    """Chunks of fixed length, entered in whatever state the one before gives, count as the library does."""
    import time

    path = P.path("piece_bpe_32k.model")
    sp, t = sentencepiece.SentencePieceProcessor(model_file=path), tokencount.Transducer(path)
    rnd = random.Random(21)
    chinese = [chr(c) for c in range(0x4E00, 0x4E00 + 400)]
    kinds = ["abcdefghijklmnopqrstuvwxyz", "abc", "ab的é😀z0=/+", chinese, "a", "ACGT", ["function(", "return", "{", "};", "=>", "this.", "0x1f", "&&"]]
    for kind in kinds:
        texts = ["".join(rnd.choice(kind) for _ in range(n)) for n in (1, 383, 384, 385, 767, 768, 1153, 5000)]
        assert t.counts(texts).tolist() == [len(sp.encode(x)) for x in texts]
    long = "".join(rnd.choice(kinds[-1]) for _ in range(50_000)) + "a" * 100_000
    t.counts([long])
    began = time.perf_counter()
    assert t.counts([long])[0] == len(sp.encode(long))
    assert time.perf_counter() - began < 2


def test_pairs_are_judged_as_the_merges_do():
    path = P.path("piece_bpe_32k.model")
    t = tokencount.Transducer(path)
    rnd = random.Random(8)
    tokens = [p for p in rnd.sample(sorted(t.rank), 3000) if t.is_token(p)]
    pairs = [(rnd.choice(tokens), rnd.choice(tokens)) for _ in range(3000)] + [(p[:k], p[k:]) for p in tokens for k in range(1, len(p)) if t.is_token(p[:k]) and t.is_token(p[k:])]
    for a, b in pairs:
        assert t.follows(a, b) == (t.merged(a + b) == [a, b])


def test_only_queries_travel(spark, monkeypatch):
    """Index blocks are dealt once; the packed queries go to each block, so bytes sent grow with queries times blocks."""
    monkeypatch.setattr(topk, "ROWS", 40)
    monkeypatch.setattr(topk, "QUERIES", 4)
    rnd = random.Random(5)
    d = spark.createDataFrame([(i, [rnd.uniform(-1, 1) for _ in range(8)], i % 10 == 0) for i in range(400)], "vec_id long, embedding array<float>, asks boolean")
    index = topk.blocks(d.select("vec_id", topk.quantised(F.col("embedding")).alias("v"), "asks", F.lit(8).alias("width")), 5)
    blocks = index.collect()
    packs = [q for b in blocks for q in b["queries"]]
    assert len(blocks) == 10 and sum(len(topk.pickle.loads(q)["ids"]) for q in packs) == 40
    sent = topk.sent(index).collect()
    assert len(sent) == len(packs) * len(blocks) and sum(len(r.q) for r in sent) == len(blocks) * sum(map(len, packs))
    plan = topk.top_k(d, F.col("asks"), 5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("explode") == 1 and "explode(queries" in plan


def test_blocks_out_of_reach_are_skipped():
    rng = np.random.default_rng(6)
    near, far = rng.integers(200, 256, (50, 8)), rng.integers(-256, -200, (50, 8))
    query = near[:1]
    floor = sorted(-(near[1:] @ query[0]))[4] * -1
    index = topk.sliced(np.arange(50), far)
    assert topk.reachable(index, query)[0] < floor
    index = topk.sliced(np.arange(50), near)
    assert topk.reachable(index, query)[0] >= (near @ query[0]).max()
    mixed = rng.integers(-256, 256, (50, 8))
    assert all(m >= (mixed @ q).max() for m, q in zip(topk.reachable(topk.sliced(np.arange(50), mixed), mixed), mixed))
