"""Quality rules with risk-controlled thresholds, in DataFrame operations only."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, word_list, written

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: Upper bounds of the strata, in words. Strata are bands of length, so there are always three.
BANDS = (200, 2000)
#: A document is rejected where one of these exceeds the stratum's cutoff.
RATIOS = {
    "symbol_share": lambda: F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)),
    "dup_line_share": lambda: F.col("n_dup_lines") / F.greatest(F.col("n_text_lines"), F.lit(1)),
    "repeat_share": lambda: F.col("n_repeat_words") / F.greatest(F.col("n_words"), F.lit(1)),
}
GRID = (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7)


@dataclass
class Risk:
    """What is promised: with confidence 1 - ``delta`` for all strata and rules together, each rule rejects at most ``alpha`` of a stratum's good documents."""

    alpha: float = 0.03
    delta: float = 0.05
    grid: tuple = field(default=GRID)


def octets(text: Column, chars: str) -> Column:
    """How often any of these one-byte characters occurs."""
    counts = [F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit(""))) for c in chars]
    total = counts[0]
    for c in counts[1:]:
        total = total + c
    return total.cast("long")


def metrics(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, ``keep`` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_text_lines (long).

    Of whole texts; null counts as empty, where all are 0. n_repeat_words counts words in a 3-word window
    that the text has twice or more, the first included: windows are hashed, sorted with their positions
    and compared with their neighbours, so a text of n words costs n log n whatever it repeats.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", *keep, t.alias("t")).withColumn("w", word_list(F.col("t")))
    lines = F.filter(F.split("t", "\n", -1), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
    d = d.select(
        "doc_id", *keep, "w",
        F.size("w").cast("long").alias("n_words"),
        (F.length("t") - octets(F.col("t"), SPACES)).cast("long").alias("word_chars"),
        octets(F.col("t"), SYMBOLS).alias("n_symbols"),
        lines.alias("l"),
    )
    span = F.when(F.size("w") >= 3, F.sequence(F.lit(0), F.size("w") - 3)).otherwise(F.array().cast("array<int>"))
    windows = F.transform(span, lambda i: F.struct(F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)).alias("h"), i.alias("i")))
    d = d.withColumn("s", F.sort_array(windows))
    twice = F.filter("s", lambda x, k: F.get("s", k - 1)["h"].eqNullSafe(x["h"]) | F.get("s", k + 1)["h"].eqNullSafe(x["h"]))
    d = d.withColumn("r", F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    return d.select(
        "doc_id", *keep, "n_words", "word_chars", "n_symbols",
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct("r")).cast("long").alias("n_repeat_words"),
        F.size("l").cast("long").alias("n_text_lines"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))


def stratum() -> Column:
    out = F.when(F.col("n_words") < BANDS[0], 0)
    for i, top in enumerate(BANDS[1:], 1):
        out = out.when(F.col("n_words") < top, i)
    return out.otherwise(len(BANDS))


def surely_below(rejected: int, n: int, alpha: float, delta: float) -> bool:
    """Whether the exact (Clopper-Pearson) upper bound at level 1 - delta for a rate seen as rejected / n is at most alpha.

    That is so when a binomial of n draws at alpha gives ``rejected`` or fewer with probability delta at most.
    """
    if n == 0 or rejected >= alpha * n:
        return False
    log = math.lgamma(n + 1) - math.lgamma(rejected + 1) - math.lgamma(n - rejected + 1) + rejected * math.log(alpha) + (n - rejected) * math.log1p(-alpha)
    total, term, j = 1.0, 1.0, rejected
    while j > 0 and term > 1e-17 * total:
        term *= j * (1 - alpha) / ((n - j + 1) * alpha)
        total += term
        j -= 1
    return log + math.log(total) <= math.log(delta)


def cutoffs(known: DataFrame, risk: Risk) -> dict[tuple[int, str], float]:
    """(stratum, rule) to its cutoff, from metrics of documents known to be good (quality 1) or bad (0).

    Fixed-sequence testing: a rule's cutoffs are tested in a stratum from the loosest down, each on the good
    documents by the exact bound, and the first that fails ends the sequence; so one sequence costs one test,
    however long it is, and delta is shared by strata and rules alone (Bonferroni). Of the cutoffs that passed,
    all of which keep the promise, the one is taken whose share of rejected bad documents exceeds its share of
    rejected good ones most (ties: the loosest); the tightest where no bad document is known. What reaches the
    driver is one row a stratum.
    """
    grid = sorted(risk.grid, reverse=True)
    good = F.col("quality") == 1
    over = [(name, i, ratio() > c) for name, ratio in RATIOS.items() for i, c in enumerate(grid)]
    sums = [F.count_if(x & (good if q else ~good)).alias(f"{name}_{i}_{q}") for name, i, x in over for q in (0, 1)]
    rows = known.where(~base_failed()).groupBy(stratum().alias("stratum")).agg(F.count_if(good).alias("n1"), F.count_if(~good).alias("n0"), *sums).collect()
    delta = risk.delta / ((len(BANDS) + 1) * len(RATIOS))
    out = {}
    for r in rows:
        for name in RATIOS:
            safe = []
            for i, c in enumerate(grid):
                if not surely_below(r[f"{name}_{i}_1"], r["n1"], risk.alpha, delta):
                    break
                safe.append((r[f"{name}_{i}_0"] / r["n0"] - r[f"{name}_{i}_1"] / r["n1"], c) if r["n0"] else (-c, c))
            if safe:
                out[r["stratum"], name] = max(safe)[1]
    return out


def judge(docs: DataFrame, labels: DataFrame, risk: Risk | None = None) -> DataFrame:
    """Per document: doc_id, the metrics, base_failed and kept.

    ``labels`` (doc_id, quality) of 1 or 0 are the holdout; several labels of one document count once, as good
    if any says so. Fewer than 50 words or more than half of the words in repeated windows fail outright.
    Without labels, or with too few for a bound, only those base rules reject. Null and empty texts have no words
    and fail; texts of any length are whole. A ratio equal to a cutoff passes. Rows that repeat are judged alike
    and count each in the holdout. Rows without an id are judged and never in the holdout. Columns other than
    doc_id and text are ignored; an empty table stays empty.
    """
    m = written(metrics(docs), "metrics")
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("known_doc")).agg(F.max("quality").alias("quality"))
    cut = cutoffs(m.join(known, m["doc_id"] == known["known_doc"]), risk or Risk())
    bad = F.lit(False)
    for (band, name), c in sorted(cut.items()):
        bad = bad | ((stratum() == band) & (RATIOS[name]() > c))
    return m.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~bad)
