"""Near-duplicate documents by min-max hashing, exact confirmation and connected components."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import pieces
from .common import forget, mapped
from .common import worker_written as written

#: Each of HASHES permutations gives its minimum and its maximum, so BANDS * ROWS is twice HASHES. A pair at
#: similarity 0.8 is missed by all bands with a chance of (1 - 0.8**5)**32, about 3 in a million.
HASHES, BANDS, ROWS = 80, 32, 5
#: Buckets up to this size are compared pair by pair, larger ones in blocks.
SMALL = 24
#: Documents and shingles in a block of such members, about, and columns that a product of two blocks takes at once.
BLOCK, BLOCK_SHINGLES, WIDTH = 1024, 400_000, 4096
#: So many ids (8 bytes each) may be sent to all executors; more are joined by shuffling.
FEW_IDS = 1_000_000

K1, K2, K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)
_random = np.random.default_rng(20_240_601)
MULTIPLY = _random.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _random.integers(0, 2**63, HASHES, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x = x * K3
    return x ^ (x >> np.uint64(32))


def shingles(texts: list[str], width: int = 2) -> tuple[list[np.ndarray], list[bytes]]:
    """Each text's set as sorted 64-bit hashes, and 128 bits of its words' sequence (b'' without words).

    A-Z are lowered; shingles are of ``width`` words, or all words of a text that has fewer.
    """
    words = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
    digest = xxhash.xxh3_64_intdigest
    h = np.array([digest(w) for ws in words for w in ws], np.uint64)
    runs = h[: max(0, len(h) - width + 1)]
    for j in range(1, width):
        runs = mixed(runs * K1 + h[j : j + len(runs)] * K2)
    out, at = [], 0
    for ws in words:
        n = len(ws)
        if n >= width:
            out.append(np.unique(runs[at : at + n - width + 1]))
        else:
            short = h[at : at + min(n, 1)]
            for j in range(1, n):
                short = mixed(short * K1 + h[at + j : at + j + 1] * K2)
            out.append(mixed(short * K2 + K1))
        at += n
    return out, [hashlib.blake2b(b" ".join(ws), digest_size=16).digest() if ws else b"" for ws in words]


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """(texts, BANDS) keys; rows of empty sets mean nothing."""
    sizes = np.array([max(1, len(s)) for s in sets])
    flat = np.concatenate([s if len(s) else np.zeros(1, np.uint64) for s in sets])
    starts = np.cumsum(sizes) - sizes
    keys = np.empty((len(sets), BANDS), np.uint64)
    row = key = None
    place = 0
    for a, b in zip(MULTIPLY, ADD):
        v = flat * a + b
        for value in (np.minimum.reduceat(v, starts), np.maximum.reduceat(v, starts)):
            band, row = divmod(place, ROWS)
            key = mixed((value if row == 0 else key ^ value) * K1 + np.uint64(band + 1))
            if row == ROWS - 1:
                keys[:, band] = key
            place += 1
    return keys.view(np.int64)


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, same, keys) of whole texts; same is null and keys empty without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in pieces(batch, "text"):
                sets, same = shingles(texts, width)
                keys = band_keys(sets)
                lists = pa.array([k if len(s) else None for k, s in zip(keys, sets)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([x or None for x in same], pa.binary()), lists], names=["doc_id", "n_shingles", "same", "keys"])

    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return mapped(d, run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_shingles long, same binary, keys array<long>")


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, body): the sets as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in pieces(batch, "text"):
                sets, _ = shingles(texts, width)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "body"])

    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return mapped(d, run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, body binary")


def linked(pairs: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets have 100 * intersection >= ``similar`` * union."""
    x = pairs.select("a", "b").join(sets.select(F.col("doc_id").alias("a"), F.col("body").alias("x")), "a")
    x = x.join(sets.select(F.col("doc_id").alias("b"), F.col("body").alias("y")), "b").select("a", "b", "x", "y")
    kind = x.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if 100 * min(len(p), len(q)) < similar * max(len(p), len(q)):
                    keep.append(False)
                    continue
                both = np.concatenate([p, q])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= similar * (len(both) - common) and common > 0)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    return mapped(x, run, f"a {kind}, b {kind}")


def least_of(edges: DataFrame, rows: int) -> DataFrame:
    """(u, m): the smallest v of each u, written, so that a join with it has plain shuffles on both sides and Spark can split a hot u."""
    return written(edges.groupBy("u").agg(F.min("v").alias("m")), "least", rows)


def components(edges: DataFrame) -> DataFrame:
    """(doc, component): the smallest id that each id of an edge (a, b) reaches; ids in no edge are left out.

    Alternates two steps until nothing moves: every node hands its larger neighbours to the smallest it knows,
    then its smaller ones. Each halves the trees' heights or better; a round is two aggregations and joins,
    written to the shared folder. No round has more edges than the one before. ``edges`` is read twice, since
    the number of edges says how many files a table needs.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e, before = written(e, "edges", edges.count()), None
    while True:
        now = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before or not now["n"]:
            return e.select(F.col("u").alias("doc"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("doc"), F.col("v").alias("component")).distinct())
        before, most = now, 2 * now["n"]
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = least_of(both, most)
        larger = written(both.join(least.select("u", F.least("u", "m").alias("m")), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges", most)
        forget(e, least)
        least = least_of(larger, most)
        moved = larger.join(least, "u")
        e = moved.select("u", F.col("m").alias("v")).unionByName(moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        e = written(e, "edges", most)
        forget(larger, least)


def only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id is among ``ids`` (doc_id, distinct); these are sent whole only if few."""
    if ids.limit(FEW_IDS + 1).count() <= FEW_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, "doc_id", "left_semi")


def relabelled(labels: DataFrame, roots: DataFrame) -> DataFrame:
    """(doc, component) after components met: ``roots`` maps a component, or a document by itself, to the one it is part of."""
    r = roots.select(F.col("doc").alias("old"), F.col("component").alias("root"))
    inside = labels.join(r, labels["component"] == r["old"], "left").select("doc", F.coalesce("root", "component").alias("component"))
    alone = roots.join(labels.select("doc"), "doc", "left_anti")
    return inside.unionByName(alone)


def labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Bucket members (key, doc) with c, the component of the document or itself."""
    return members.join(labels.withColumnRenamed("doc", "of"), F.col("doc") == F.col("of"), "left").select("key", "doc", F.coalesce("component", "doc").alias("c"))


def candidates(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b, ca, cb), a > b: all pairs of different components ca and cb in the small buckets (key, doc, n)."""
    small = labelled(members.where(F.col("n") <= SMALL), labels).groupBy("key").agg(F.collect_set(F.struct("doc", "c")).alias("all"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1")
    pairs = small.select(F.explode("all").alias("x"), "all").select("x", F.explode("all").alias("y")).where("x.doc > y.doc and x.c <> y.c")
    return pairs.select(F.col("x.doc").alias("a"), F.col("y.doc").alias("b"), F.col("x.c").alias("ca"), F.col("y.c").alias("cb")).distinct()


def unsettled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc, c, hub): members of the large buckets (key, doc, n) that still hold several components, with the bucket's smallest."""
    m = written(labelled(members.where(F.col("n") > SMALL), labels), "large")
    # written, so that the join has plain shuffles on both sides and a hot bucket can be split
    ends = written(m.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.min("doc").alias("hub")).where("c0 <> c1").select("key", "hub"), "open", m.count())
    return m.join(ends, "key").select("doc", "c", "hub").distinct()


def across(open_: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """(a, b): components of documents that ``open_`` (doc, c, hub) ties together and that a pair of similar documents links.

    Documents that buckets tie together are dealt by size class and, where a component is large, by it, into
    blocks. Blocks whose sizes can be similar meet, unless both are of one component, and all their pairs are
    counted by matrix products; each two blocks give a spanning forest of the components that they link.
    """
    tied = written(components(open_.select(F.col("doc").alias("a"), F.col("hub").alias("b"))), "tied")
    d = open_.select("doc", "c").distinct().join(tied.withColumnRenamed("component", "s"), "doc")
    step = max(math.log(100 / similar) * 1.0001, 1e-3) if similar else math.inf
    d = d.join(sets.select(F.col("doc_id").alias("doc"), (F.octet_length("body") / 8).cast("long").alias("size")).distinct(), "doc")
    d = d.withColumn("class", F.floor(F.log("size") / F.lit(step)).cast("long"))
    big = d.groupBy("s", "c").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= BLOCK // 4).select("s", "c", F.concat(F.lit("c"), "c").alias("lot"))
    d = written(d.join(big, ["s", "c"], "left").withColumn("lot", F.coalesce("lot", F.lit(""))), "open")
    lots = d.groupBy("s", "lot", "class").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("long").alias("parts"))
    name = F.concat_ws(":", "class", "part", "lot")
    blocks = lots.select("s", "lot", "class", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")).select("s", "lot", "class", name.alias("block"))
    x, y = (blocks.select("s", *[F.col(c).alias(f"{c}_{k}") for c in ("lot", "class", "block")]) for k in "xy")
    meet = x.join(y, "s").where("block_x <= block_y and abs(class_x - class_y) <= 1 and (lot_x = '' or lot_x <> lot_y)")
    meet = written(meet.select("s", "block_x", "block_y", F.concat_ws("|", "s", "block_x", "block_y").alias("pair")), "meet")
    sides = meet.select("s", F.col("block_x").alias("block"), "pair", F.lit(False).alias("right")).unionByName(meet.where("block_x <> block_y").select("s", F.col("block_y").alias("block"), "pair", F.lit(True).alias("right")))
    placed = d.join(lots, ["s", "lot", "class"]).withColumn("part", F.pmod(F.xxhash64("doc"), F.col("parts"))).select("s", name.alias("block"), "doc", "c", "size")
    bodies = placed.join(sets.select(F.col("doc_id").alias("doc"), "body"), "doc").where("octet_length(body) = 8 * size").select("s", "block", "c", "body")
    kind = open_.schema["c"].dataType.simpleString()

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        coded = rows.column("c").combine_chunks().dictionary_encode()
        c, names = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        right = np.array(rows.column("right").to_pylist(), bool)
        found = similar_rows([np.frombuffer(b.as_buffer(), np.uint64) for b in rows.column("body")], right, c, similar)
        return pa.table({"a": names.take(pa.array([i for i, _ in found], pa.int32())), "b": names.take(pa.array([j for _, j in found], pa.int32()))})

    return bodies.join(sides, ["s", "block"]).select("pair", "right", "c", "body").groupBy("pair").applyInArrow(run, f"a {kind}, b {kind}").distinct()


def similar_rows(sets: list[np.ndarray], right: np.ndarray, c: np.ndarray, similar: int) -> list[tuple[int, int]]:
    """A spanning forest of the components ``c`` that similar sets of the two sides link; without a right side, all meet all."""
    left, right = np.flatnonzero(~right), np.flatnonzero(right)
    if not len(right):
        right = left
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    sides = []
    for rows in (left, right):
        at = np.concatenate([column[ends[i] - sizes[i] : ends[i]] for i in rows])
        sides.append((np.repeat(np.arange(len(rows)), sizes[rows]), at))
    counts = [np.bincount(at, minlength=len(values)) for _, at in sides]
    shared = (counts[0] > 0) & (counts[1] > 0) & (counts[0] + counts[1] > 1 + (left is right))
    # in a block that meets itself, a shingle of one document counts twice for it and is of no other
    new = np.cumsum(shared) - 1
    sides = [(row[shared[at]], new[at[shared[at]]]) for row, at in sides]
    sides = [(row[o], at[o]) for row, at in sides for o in [np.argsort(at, kind="stable")]]
    common = np.zeros((len(left), len(right)))
    for first in range(0, int(shared.sum()), WIDTH):
        dense = []
        for n, (row, at) in zip((len(left), len(right)), sides):
            a, b = np.searchsorted(at, (first, first + WIDTH))
            m = np.zeros((n, WIDTH), np.float32)
            m[row[a:b], at[a:b] - first] = 1
            dense.append(m)
        common += dense[0] @ dense[1].T
    total = sizes[left][:, None] + sizes[right][None, :] - common
    i, j = np.nonzero((common > 0) & (100 * common >= similar * total) & (c[left][:, None] != c[right][None, :]))
    pairs = np.unique(np.stack([np.minimum(c[left[i]], c[right[j]]), np.maximum(c[left[i]], c[right[j]])], 1), axis=0).tolist()
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        while (up := parent.get(v, v)) != v:
            parent[v] = parent.get(up, up)
            v = up
        return v

    out = []
    for a, b in pairs:
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def near_duplicates(docs: DataFrame, similar: int = 80, width: int = 5) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept.

    Documents are linked at 100 * intersection >= ``similar`` * union of their sets of shingles of ``width``
    words; component_id is the smallest id reachable, kept whether that is the document itself. Null, empty and
    blank texts have an empty set and no links; a text of fewer words is one shingle. Very long texts count whole.
    Of equal similarities none is preferred: every link counts. Rows without an id have no component and are kept.
    Ids are taken as unique; rows that repeat one share its component. Other columns are ignored, an empty table
    stays empty.

    Exact copies (equal word sequences) are settled by one aggregation and only their smallest ids go on. Of
    these, documents that share a band key meet in a bucket. First each is compared with the one smallest
    member that it meets most often, which settles most components. Then all pairs of different components are
    compared in small buckets, and all documents of large buckets that still hold several components in blocks.
    Every link is confirmed on the full sets. What is sent is keys, sets of documents that meet any other,
    blocks of sets, and links, never single pairs of a large bucket.
    """
    sig = written(signatures(docs, width), "signatures")
    n = sig.count()
    with_words = sig.where(F.col("same").isNotNull() & F.col("doc_id").isNotNull())
    copies = with_words.groupBy("same").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    # read again, so that the join has plain shuffles on both sides and a hot group of copies can be split
    copies = written(copies.drop("copies"), "groups", n)
    own = written(with_words.select("doc_id", "same").join(copies, "same").select("doc_id", "first"), "copies")
    later = own.where("doc_id <> first").select("doc_id").distinct()
    kept = with_words.join(later, "doc_id", "left_anti")
    keyed = written(kept.select(F.col("doc_id").alias("doc"), F.explode("keys").alias("key")), "keys")
    buckets = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("hub")).where("n > 1"), "sizes", BANDS * n)
    members = written(keyed.join(buckets, "key"), "buckets")
    forget(keyed, buckets)
    met = members.where("doc <> hub").groupBy("doc", "hub").agg(F.count(F.lit(1)).alias("times"))
    first = met.groupBy("doc").agg(F.max(F.struct("times", (-F.col("hub")).alias("to"))).alias("best")).select(F.col("doc").alias("a"), (-F.col("best.to")).alias("b"))
    tried = written(first, "pairs", n)
    ids = written(members.select(F.col("doc").alias("doc_id")).distinct(), "ids", n)
    sets = written(full_sets(only(docs.select("doc_id", "text"), ids), width), "sets")
    labels = written(components(written(linked(tried, sets, similar), "links")), "labels", n)
    more = written(candidates(members, labels).join(tried, ["a", "b"], "left_anti"), "pairs")
    found = written(linked(more, sets, similar).join(more, ["a", "b"]).select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), "links", more.count())
    if not found.isEmpty():
        labels = written(relabelled(labels, components(found)), "labels")
    rest = written(unsettled(members, labels), "unsettled", BANDS * n)
    if not rest.isEmpty():
        found = written(across(rest, sets, similar), "links", rest.count())
        if not found.isEmpty():
            labels = written(relabelled(labels, components(found)), "labels")
    forget(members, tried, ids, sets, more, found, rest)
    c = own.join(labels, own["first"] == labels["doc"], "left").select("doc_id", F.coalesce("component", "first").alias("component_id"))
    c = c.unionByName(labels.join(own.select(F.col("doc_id").alias("doc")), "doc", "left_anti").select(F.col("doc").alias("doc_id"), F.col("component").alias("component_id"))).distinct()
    out = sig.select("doc_id", "n_shingles").join(c.withColumnRenamed("doc_id", "of"), F.col("doc_id") == F.col("of"), "left").drop("of")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    out = out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))).select("doc_id", "n_shingles", "component_id", "kept")
    # written, so that a caller who stores it gets as many files as its rows need, not one of each shuffle partition
    out = written(out, "result")
    forget(sig, copies, own, labels)
    return out
