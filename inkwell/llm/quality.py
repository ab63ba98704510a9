"""A quality classifier: linear support vectors on n-gram indicators scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import pieces

#: Slots of n-grams of word shapes, then of words.
SHAPES, WORDS = 1 << 16, 1 << 18
SLOTS = SHAPES + WORDS
#: What a word's ratio counts next to a shape's: a text has many more words than shapes, and most are rare.
WORD_WEIGHT = 0.25
#: At most so many labelled rows, those with the smallest hashes of their ids, train the model.
MOST_ROWS = 6000
THRESHOLD = 0.7

#: Bytes to classes: lower case and bytes above ASCII to a, upper case to A, digits to 0, white space to blank.
CLASSES = bytes(
    0x20 if b == 0x20 or 0x09 <= b <= 0x0D else ord("a") if b >= 0x80 or 0x61 <= b <= 0x7A else ord("A") if 0x41 <= b <= 0x5A else ord("0") if 0x30 <= b <= 0x39 else b
    for b in range(256)
)
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def squeezed(raw: bytes) -> bytes:
    """Classes of the bytes with runs of one class made one."""
    x = np.frombuffer(raw.translate(CLASSES), np.uint8)
    return x[np.concatenate([[True], x[1:] != x[:-1]])].tobytes() if len(x) else b""


def slot(gram: tuple) -> int:
    return zlib.crc32(b"\x00".join(gram)) % SHAPES


_slots: dict[tuple, int] = {}
K1, K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def word_slots(raw: bytes) -> np.ndarray:
    """Slots of the words (ASCII letters lowered) and of pairs of neighbours, repeats included."""
    digest = xxhash.xxh3_64_intdigest
    h = np.array([digest(w) for w in raw.lower().split()], np.uint64)
    grams = np.concatenate([h * K2, h[:-1] * K1 + h[1:] * K2]) if len(h) else h
    return (grams >> np.uint64(65 - WORDS.bit_length())).astype(np.int32) + np.int32(SHAPES)


def features(text: str) -> np.ndarray:
    """The n-grams that a text has, as sorted slots.

    Grams are of one and two words, and of one to three words' shapes (``Word,`` is ``Aa,``), where a word equal to the one before it
    is marked, as are the first and the last word; and of shapes that make up a tenth, a quarter or half of
    all words.
    """
    raw = text.encode("utf-8", "surrogatepass")
    shapes = squeezed(raw).split()
    words = WORD.findall(raw)
    marked = [s if a != b else b"=" + s for s, a, b in zip(shapes, words, [b"", *words])]
    tokens = [b"^", *marked, b"$"]
    grams: set[tuple] = set(zip(tokens))
    grams.update(zip(tokens, tokens[1:]))
    grams.update(zip(tokens, tokens[1:], tokens[2:]))
    if marked:
        kinds, n = np.unique(np.array(marked, dtype=object), return_counts=True)
        for kind, share in zip(kinds.tolist(), (n / len(marked)).tolist()):
            grams.update((b"share", kind, b"%d" % i) for i, least in enumerate((0.1, 0.25, 0.5)) if share >= least)
    if len(_slots) > 100_000:
        _slots.clear()
    out = []
    for g in grams:
        s = _slots.get(g)
        if s is None:
            s = _slots[g] = slot(g)
        out.append(s)
    return np.unique(np.concatenate([np.array(out, np.int32), word_slots(raw)]))


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, x: np.ndarray) -> float:
        return float(self.weights[x].sum()) + self.bias

    def score(self, margins: np.ndarray) -> np.ndarray:
        """0 to 1; ``THRESHOLD`` where the margin is on the boundary that training chose."""
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -30, 30)))


def ratios(rows: list[np.ndarray], y: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """Log of how much likelier each n-gram is in rows of label 1."""
    p, q = np.full(SLOTS, smooth), np.full(SLOTS, smooth)
    for x, label in zip(rows, y):
        (p if label > 0 else q)[x] += 1
    r = np.log(p / p.sum()) - np.log(q / q.sum())
    r[SHAPES:] *= WORD_WEIGHT
    return r


def descend(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray, cost: float, epochs: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L2-regularised hinge loss on rows of r at their slots and a constant 1.

    Each step solves one dual variable exactly, between 0 and the row's cost; rows of both labels get the
    same cost in sum.
    """
    w, b = np.zeros(SLOTS), 0.0
    values = [r[x] for x in rows]
    norms = [float(v @ v) + 1.0 for v in values]
    n = len(rows)
    most = np.where(y > 0, cost * n / (2 * max(1, (y > 0).sum())), cost * n / (2 * max(1, (y < 0).sum())))
    dual = np.zeros(n)
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(n):
            x, v = rows[i], values[i]
            slope = y[i] * (float(w[x] @ v) + b) - 1
            new = min(max(dual[i] - slope / norms[i], 0.0), most[i])
            step = (new - dual[i]) * y[i]
            if step:
                w[x] += step * v
                b += step
                moved = max(moved, abs(step))
                dual[i] = new
        if moved < 1e-4:
            break
    return w, b


def fit(rows: list[np.ndarray], labels: np.ndarray, cost: float = 0.05, folds: int = 4) -> Model:
    """Weights from all rows; the boundary and the scale of the score from margins of rows left out in turn.

    With labels of one kind only, or none, every score is THRESHOLD if they are 1 or there are none, else 0.
    """
    y = np.where(labels > 0, 1.0, -1.0)
    even = float(np.log(THRESHOLD / (1 - THRESHOLD)))
    if not (y > 0).any() or not (y < 0).any():
        return Model(np.zeros(SLOTS), 0.0, 0.0, even + 1e-9 if not (y < 0).any() else -30.0)
    def train(some: list[int]) -> tuple[np.ndarray, float]:
        part, label = [rows[i] for i in some], y[some]
        if not (label > 0).any() or not (label < 0).any():
            return np.zeros(SLOTS), 0.0
        r = ratios(part, label)
        w, b = descend(part, label, r, cost)
        return w * r, b

    out = np.zeros(len(rows))
    part = np.arange(len(rows)) % folds
    for f in range(folds):
        v, b = train(np.flatnonzero(part != f).tolist())
        for i in np.flatnonzero(part == f):
            out[i] = v[rows[i]].sum() + b
    # the boundary that loses least, good rows counting double, midway in the gap where there is one
    at = np.unique(out)
    cuts = np.concatenate([[at[0] - 1], (at[1:] + at[:-1]) / 2])
    good, bad = np.sort(out[y > 0]), np.sort(out[y < 0])
    loss = 2 * np.searchsorted(good, cuts) / len(good) + (1 - np.searchsorted(bad, cuts) / len(bad))
    best = np.flatnonzero(loss <= loss.min() + 1e-12)
    cut = float(cuts[best[len(best) // 2]])
    slope = 4 / max(1e-6, float(np.median(np.abs(out - cut))))
    v, b = train(list(range(len(rows))))
    return Model(v, b, slope, even - slope * cut + 1e-9)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text has remainder 2 by 4."""
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2, F.lit(False))


def featured(docs: DataFrame, *keep: str) -> DataFrame:
    d = docs.select(*keep, F.coalesce("text", F.lit("")).alias("text"))
    kinds = ", ".join(f"{c} {d.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in pieces(batch, "text"):
                x = pa.array([features(t).tobytes() for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([*rows.columns[: len(keep)], x], names=[*keep, "x"])

    return d.mapInArrow(run, f"{kinds}, x binary")


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> Model:
    """A model from labelled rows that are not held out.

    At most ``most`` of them, those with the smallest hashes of their ids, so that runs agree and the driver
    gets a bounded number of rows, each with at most SLOTS n-grams of four bytes. Of several labels the lowest counts.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.where(~held_out(F.col("doc_id"))).withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(most)
    # a bounded number of rows of three numbers each
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    got = featured(rows, "doc_id", "quality", "h").collect()
    got = list({r["doc_id"]: r for r in sorted(got, key=lambda r: (r["h"], r["doc_id"], bytes(r["x"])))}.values())
    return fit([np.frombuffer(bytes(r["x"]), np.int32) for r in got], np.array([r["quality"] for r in got]))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """All of ``docs`` with score (0 to 1, higher: label 1 likelier) and predicted (1 from ``threshold``).

    Only the text is looked at, whole; null counts as empty, and an empty text gets the score of its n-grams
    like any other. Repeated rows score alike; other columns pass through; an empty table stays empty.
    """
    from pyspark.sql.types import DoubleType, IntegerType, StructType

    sent = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias, model.slope, model.shift))
    docs = docs.drop("score", "predicted")
    names = docs.columns
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*sent.value)
        for batch in batches:
            for rows, texts in pieces(batch, "text"):
                s = m.score(np.array([m.margin(features(t)) for t in texts]))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=[*names, "score", "predicted"])

    return docs.mapInArrow(run, StructType([*schema.fields]).add("score", DoubleType()).add("predicted", IntegerType()))
