"""Exact top-k inner products on a bit-sliced index.

Each vector becomes integers floor(256 * x). A block of rows is indexed by bit slices: for each component,
the block's least value is taken off and each bit of the rest is a bitmap over the block's rows. For a query,
the slices of all components are added with bitmap arithmetic, shifted by the bits of the query's weights (a
negative weight adds complemented slices and a constant). The sum is again bit-sliced; from its most
significant slice downward, rows are split into surely in, still tied, and out, until k are found. Rows still
tied after the last slice have equal scores: the smallest ids among them are taken.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Rows of an index block and queries of a query block.
ROWS, QUERIES = 32768, 256


def quantised(vector: Column) -> Column:
    """floor(256 * x) of each component, x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("long"))


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False))


def sliced(ids: np.ndarray, ints: np.ndarray) -> dict:
    """The index of one block: rows by id, per component its least value and its slices."""
    order = np.argsort(ids, kind="stable")
    ids, ints = ids[order], ints[order]
    words = -(-len(ids) // 64)
    low = ints.min(axis=0) if len(ids) else np.zeros(ints.shape[1], np.int64)
    rest = (ints - low).astype(np.uint64)
    bits = [int(x).bit_length() for x in rest.max(axis=0)] if len(ids) else []
    maps = []
    for d, n in enumerate(bits):
        for s in range(n):
            raw = np.packbits(((rest[:, d] >> np.uint64(s)) & np.uint64(1)).astype(bool), bitorder="little")
            maps.append(np.pad(raw, (0, words * 8 - len(raw))).view(np.uint64))
    high = ints.max(axis=0) if len(ids) else low
    return {"ids": ids, "low": low, "high": high, "bits": bits, "maps": np.array(maps, np.uint64).reshape(-1, words), "words": words}


def digits(w: int) -> Iterator[tuple[int, int]]:
    """The non-zero digits of an integer in its sparsest signed binary form: (power of two, +1 or -1)."""
    at = 0
    while w:
        if w & 1:
            sign = 2 - (w & 3)
            yield at, sign
            w -= sign
        w >>= 1
        at += 1


def scored(index: dict, turned: np.ndarray, weights: list[int]) -> tuple[list[np.ndarray], int]:
    """Slices of a query's sums over the block, and the constant that they lack.

    Of three bitmaps at one power of two, one stays and one is carried, so a power's list never holds more
    than two. ``turned`` are the complemented slices, for digits of -1.
    """
    parts: list[list[np.ndarray]] = [[]]
    lack, at = 0, 0
    for w, n, low in zip(weights, index["bits"], index["low"].tolist()):
        lack += w * low
        for t, sign in digits(w):
            if sign < 0:
                lack -= ((1 << n) - 1) << t
            maps = index["maps"] if sign > 0 else turned
            for s in range(n):
                x, power = maps[at + s], s + t
                while True:
                    while power >= len(parts):
                        parts.append([])
                    here = parts[power]
                    if len(here) < 2:
                        here.append(x)
                        break
                    a, b = here
                    one = a ^ b
                    carry = a & b
                    carry |= one & x
                    one ^= x
                    here[:] = [one]
                    x, power = carry, power + 1
        at += n
    out, carry = [], None
    power = 0
    while power < len(parts) or carry is not None:
        here = list(parts[power]) if power < len(parts) else []
        if carry is not None:
            here.append(carry)
        carry = None
        if len(here) == 3:
            a, b, c = here
            carry = (a & b) | ((a ^ b) & c)
            here = [a ^ b ^ c]
        elif len(here) == 2:
            a, b = here
            carry, here = a & b, [a ^ b]
        out.append(here[0] if here else np.zeros(index["words"], np.uint64))
        power += 1
    return out, lack


def best(index: dict, turned: np.ndarray, own: int, weights: list[int], k: int) -> list[tuple[int, int]]:
    """(row's id, score) of the k best rows of the block for one query, fewer if it has fewer."""
    ids, words = index["ids"], index["words"]
    sums, lack = scored(index, turned, weights)
    valid = np.zeros(words * 64, bool)
    valid[: len(ids)] = ids != own
    tied = np.packbits(valid, bitorder="little").view(np.uint64)
    sure, n_sure = np.zeros_like(tied), 0
    for s in reversed(sums):
        one = tied & s
        n = n_sure + int(np.bitwise_count(one).sum(dtype=np.int64))
        if n > k:
            tied = one
        else:
            sure, n_sure = sure | one, n
            tied = tied & ~s
    rows = np.flatnonzero(np.unpackbits(sure.view(np.uint8), bitorder="little")).tolist()
    rows += np.flatnonzero(np.unpackbits(tied.view(np.uint8), bitorder="little"))[: k - len(rows)].tolist()
    return [(int(ids[r]), max(-(2**63), min(2**63 - 1, lack + sum(((int(s[r >> 6]) >> (r & 63)) & 1) << j for j, s in enumerate(sums))))) for r in rows]


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(flat), width)


def reachable(index: dict, ints: np.ndarray) -> list[int]:
    """For each query the sum of the most that each component can add in the block: no row scores more."""
    w = ints.astype(object)
    return np.maximum(w * index["low"].astype(object), w * index["high"].astype(object)).sum(axis=1).tolist() if ints.shape[1] else [0] * len(ints)


def blocks(rows: DataFrame, k: int) -> DataFrame:
    """(block, width, part, index, queries): rows (vec_id, v, asks) of equal width, bit-sliced in blocks of about ROWS.

    ``queries`` are those of the block, packed by up to QUERIES, each with its floor and what it found in its own block.
    """
    n = max(1, math.ceil(rows.count() / ROWS))
    put = F.pmod(F.xxhash64("vec_id", "width"), F.lit(n)).cast("int")

    def pack(key: tuple, t: pa.Table) -> pa.Table:
        width, size = key[1].as_py(), ROWS
        ids, ints, asks = t.column("vec_id").to_numpy(), matrix(t.column("v"), width), np.array(t.column("asks").to_pylist(), bool)
        # a block of many repeats of one id is cut as well: its parts are blocks of their own
        bodies, packed = [], []
        for part, at in enumerate(range(0, len(ids), 2 * size)):
            cut = slice(at, at + 2 * size)
            index = sliced(ids[cut], ints[cut])
            turned, own = ~index["maps"], []
            mine = np.flatnonzero(asks[cut]) + at
            for i in range(0, len(mine), QUERIES):
                some = mine[i : i + QUERIES]
                found = [best(index, turned, q, w, k) for q, w in zip(ids[some].tolist(), ints[some].tolist())]
                floors = [min(s for _, s in f) if len(f) == k else None for f in found]
                own.append(pickle.dumps({"from": (key[0].as_py(), part), "ids": ids[some], "ints": ints[some], "floors": floors, "found": found}, protocol=5))
            bodies.append(pickle.dumps(index, protocol=5))
            packed.append(own)
        m = len(bodies)
        return pa.table({"block": pa.array([key[0].as_py()] * m, pa.int32()), "width": pa.array([width] * m, pa.int32()), "part": pa.array(range(m), pa.int32()), "index": pa.array(bodies, pa.binary()), "queries": pa.array(packed, pa.list_(pa.binary()))})

    packed = rows.withColumn("block", put).groupBy("block", "width").applyInArrow(pack, "block int, width int, part int, index binary, queries array<binary>")
    return written(packed, "index")


def sent(index: DataFrame) -> DataFrame:
    """(block, width, q): the packed queries, once for each block of their width."""
    asked = index.select("width", F.explode("queries").alias("q"))
    return asked.join(index.select("block", "width").distinct(), "width").select("block", "width", "q")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k highest scores, ties to the smaller vec_id.

    ``vectors`` (vec_id, embedding); ``is_query`` picks the queries among its rows. Candidates of a query are
    all rows of other ids and of its own width. Vectors that are null or hold null or non-finite components
    take no part, nor do rows without an id. Rows that repeat an id with equal vectors count once; an id with
    different vectors takes part with each, as a query with the best ``k`` results over all of them. Scores are exact; one
    beyond the range of a long shows as its limit. Empty tables give an empty result; other columns are ignored.

    Index blocks and packed queries meet on the block's number in an equality join. What is shuffled is every index
    block once, and the queries once for each block; a task holds one block and one pack of queries at a time.
    """
    v = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding")).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    v = v.groupBy("vec_id", "v").agg(F.bool_or("asks").alias("asks")).withColumn("width", F.size("v"))
    index = blocks(v, k)
    asked = sent(index)
    parts = max(1, min(index.count(), 20_000))
    pairs = index.select("block", "width", "part", "index").repartition(parts, "block", "width").join(asked.repartition(parts, "block", "width"), ["block", "width"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, part, body, q in zip(*batch.columns):
                at, index, asked = (block.as_py(), part.as_py()), pickle.loads(body.as_buffer()), pickle.loads(q.as_buffer())
                found: tuple[list, list, list] = ([], [], [])
                if at == asked["from"]:
                    results = asked["found"]
                else:
                    turned, most = ~index["maps"], reachable(index, asked["ints"])
                    results = [best(index, turned, own, weights, k) if floor is None or top >= floor else [] for own, weights, floor, top in zip(asked["ids"].tolist(), asked["ints"].tolist(), asked["floors"], most)]
                for own, rows in zip(asked["ids"].tolist(), results):
                    for row in rows:
                        for to, x in zip(found, (own, *row)):
                            to.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["query_id", "vec_id", "score"])

    found = pairs.select("block", "part", "index", "q").mapInArrow(search, "query_id long, vec_id long, score long").distinct()
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
