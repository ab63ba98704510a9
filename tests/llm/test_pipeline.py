"""The pipeline's stages, each on what the one before it left, against plain versions."""

from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from test_text_operators import WORD, WS, lowered, plain_components, plain_targets

import corpus_pipeline
from inkwell.llm import bytebpe, quality
from inkwell.llm.common import written

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def states(spark):
    docs = [spark.read.parquet(f"{DATA}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        docs.append(written(stage(spark, docs[-1], DATA), "test-stage"))
    return docs


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_columns_and_order(states):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "near dedup", "mixing", "byte BPE"]
    assert all(s.columns == states[0].columns for s in states[:-1])


def test_quality(spark, states):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    kept = {r["doc_id"]: r for r in rows(states[1])}
    before = {r["doc_id"]: r for r in rows(states[0])}
    assert all(before[i] == r for i, r in kept.items())
    model = quality.train(states[0], spark.read.parquet(f"{DATA}/labels.parquet"))
    assert kept.keys() == {i for i, r in before.items() if quality.Model.score(model, np.array([model.margin(quality.features(r["text"] or ""))]))[0] >= 0.7}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in good) >= 0.95 * len(good)


def test_lines(states):
    before, after = rows(states[1]), {r["doc_id"]: r for r in rows(states[2])}
    holders = defaultdict(set)
    key = lambda x: lowered(x.strip(WS))
    for r in before:
        for x in r["text"].split("\n"):
            if len(key(x)) >= 40:
                holders[key(x)].add(r["doc_id"])
    for r in before:
        text = "\n".join(x for x in r["text"].split("\n") if not (len(holders[key(x)]) >= 5 and max(holders[key(x)]) != r["doc_id"]))
        assert after[r["doc_id"]] == r | {"text": text, "n_chars": len(text)}
    assert len(after) == len(before)


def test_near(states):
    before, after = rows(states[2]), rows(states[3])
    comp = plain_components([(r["doc_id"], r["text"]) for r in before], 5)
    assert sorted(r["doc_id"] for r in after) == sorted(i for i, (_, c) in comp.items() if c == i)


def test_mixing(states):
    before, after = {r["doc_id"]: r for r in rows(states[3])}, rows(states[4])
    sizes = Counter()
    for r in before.values():
        sizes[r["source"]] += len(WORD.findall(r["text"]))
    n = Counter(r["doc_id"] for r in after)
    assert max(n.values()) <= 3 and all(r == before[r["doc_id"]] for r in after)
    taken = Counter()
    for r in after:
        taken[r["source"]] += len(WORD.findall(r["text"]))
    most = max(len(WORD.findall(r["text"])) for r in before.values())
    assert all(abs(taken[s] - t) <= most for s, t in plain_targets(dict(sizes)).items())


def test_tokens(states):
    texts = {r["doc_id"]: r["text"] for r in rows(states[4])}
    tik = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bytebpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    out = rows(states[5])
    assert Counter(r["doc_id"] for r in out) == Counter(r["doc_id"] for r in rows(states[4]))
    for r in out:
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == tik.encode_ordinary(texts[r["doc_id"]])


def test_odd_rows_and_extra_columns(spark):
    base = [(i, f"word{i} " * 60, "en", "a", 9) for i in range(20)]
    odd = [(None, "x y z", None, None, None), (30, None, "en", "b", None), (31, "", "en", None, 0), base[0]]
    docs = spark.createDataFrame(base + odd, "doc_id long, text string, lang string, source string, n_chars long")
    for clash in ("score", "kept_text", "times", "cut", "__0"):
        docs = docs.withColumn(clash, F.lit("mine"))
    d = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = written(stage(spark, d, DATA), "test-odd")
        assert d.columns == docs.columns, name
        assert d.where("score <> 'mine' or times <> 'mine' or cut <> 'mine'").count() == 0
        assert stage(spark, docs.where("false"), DATA).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).count() == len(base) + len(odd)
