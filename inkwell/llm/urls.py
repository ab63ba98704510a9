"""URL filters: rules by host and path, then a classifier on segmented host and path tokens.

Nothing here names a site or a word. Word frequencies come from the pages' texts and paths, and labels from the
rules' own verdicts: urls like those that the rules block are blocked.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import pieces
from .common import ascii_lower

#: The commonest words of all pages that the segmentation knows, and tokens that the classifier weighs: what is sent to all tasks.
MOST_WORDS = 50_000
#: Splits of names that a worker remembers.
MOST_NAMES = 100_000
#: One host in so many is kept from training, to measure on.
HELD_OUT = 5
TOKEN = re.compile(r"[a-z]+")
#: What of a page is no text; and words: letters alone.
MARKUP = r"(?s)<script.*?</script>|<style.*?</style>|<[^>]*>|&[#a-zA-Z0-9]+;"
WORDS = r"(?<![\p{L}\p{N}])[a-z]{2,24}(?![\p{L}\p{N}])"


class Segmenter:
    """Splits a run of letters into words by the likeliest sequence of a unigram model.

    A run of letters that is no known word costs more for each letter than known words do, so unknown names
    stay in one piece.
    """

    def __init__(self, counts: dict[str, float], unknown: float = 3.2, start: float = 6.0):
        total = sum(counts.values())
        self.cost = {w: -math.log(n / total) for w, n in counts.items()}
        self.longest = max(map(len, counts), default=0)
        self.unknown, self.start = unknown, start

    def split(self, name: str) -> list[str]:
        """Time and memory grow with the name's length alone."""
        n = len(name)
        # two best costs for each place: after a known word, and inside or after an unknown run
        known = [0.0] + [math.inf] * n
        run = [math.inf] * (n + 1)
        word_from = [0] * (n + 1)
        run_from = [0] * (n + 1)
        for end in range(1, n + 1):
            for a in range(max(0, end - self.longest), end):
                c = self.cost.get(name[a:end])
                if c is not None and (x := min(known[a], run[a]) + c) < known[end]:
                    known[end], word_from[end] = x, a
            fresh, longer = known[end - 1] + self.start, run[end - 1]
            if fresh < longer:
                run[end], run_from[end] = fresh + self.unknown, end - 1
            elif longer < math.inf:
                run[end], run_from[end] = longer + self.unknown, run_from[end - 1]
        out, end = [], n
        while end:
            a = word_from[end] if known[end] <= run[end] else run_from[end]
            out.append(name[a:end])
            end = a
        return out[::-1]


class Classifier:
    """Multinomial naive Bayes from counts of tokens in blocked and allowed urls.

    Tokens that training lacks say nothing, and both verdicts are taken as equally likely before: how many
    urls the rules block says nothing of the others.
    """

    def __init__(self, blocked: dict[str, int], allowed: dict[str, int], smooth: float = 1.0):
        words = blocked.keys() | allowed.keys()
        na, nb = sum(blocked.values()) + smooth * len(words), sum(allowed.values()) + smooth * len(words)
        self.weight = {w: math.log((blocked.get(w, 0) + smooth) / na) - math.log((allowed.get(w, 0) + smooth) / nb) for w in words}

    def margin(self, tokens: list[str]) -> float:
        return sum(self.weight.get(t, 0.0) for t in tokens)


@dataclass
class Model:
    segmenter: Segmenter
    classifier: Classifier

    def __post_init__(self):
        self.names: dict[str, tuple[str, ...]] = {}

    def name(self, name: str) -> tuple[str, ...]:
        got = self.names.get(name)
        if got is None:
            got = tuple(self.segmenter.split(name))
            if len(name) <= 64:
                if len(self.names) >= MOST_NAMES:
                    self.names.clear()
                self.names[name] = got
        return got

    def tokens(self, host: str, path: str) -> list[str]:
        """Words of a host without its last label, and of the path; single letters say nothing."""
        labels = host.split(":")[0].split(".")
        names = [x for label in (labels[:-1] or labels) for x in TOKEN.findall(label)]
        names += TOKEN.findall(path.lower())
        return [t for n in names for t in self.name(n) if len(t) > 1]


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def parsed(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """page_id, host, path, rule and said, the rule's verdict (both null where no rule fits)."""
    d = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, said = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, text in sorted(rules, key=lambda r: len(r[1])):
        host, slash, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        rule, said = F.when(fits, text).otherwise(rule), F.when(fits, verdict).otherwise(said)
    return d.withColumn("rule", rule).withColumn("said", said)


def word_counts(pages: DataFrame) -> Segmenter:
    """A unigram model of the MOST_WORDS commonest words of all pages' texts and paths, counted over whole pages."""
    text = F.concat_ws(" ", F.regexp_replace(F.coalesce("html", F.lit("")), MARKUP, " "), path_of(F.col("url")))
    words = pages.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0))).alias("word"))
    top = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "word").limit(MOST_WORDS)
    return Segmenter({r["word"]: r["n"] for r in top.collect()})


def held_out(host: Column) -> Column:
    return F.pmod(F.xxhash64(host), F.lit(HELD_OUT)) == 0


def train(pages: DataFrame, rules: list[tuple[str, str]]) -> Model:
    """The segmentation, and a classifier of the urls that rules decide, but for those of held-out hosts.

    A token counts once for each host and verdict it comes with, so no host outweighs others by its pages alone.
    All pages are read whole; what comes to the driver is MOST_WORDS words and as many tokens, the commonest
    (ties: by code point). Null pages and urls have no words; an empty table, or rules that decide nothing, give
    a classifier to which all urls are equal.
    """
    segmenter = word_counts(pages)
    labelled = parsed(pages, rules).where(F.col("said").isNotNull() & ~held_out(F.col("host"))).select("host", "path", "said")
    sent = pages.sparkSession.sparkContext.broadcast(segmenter)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(sent.value, Classifier({}, {}))
        for batch in batches:
            for rows, paths in pieces(batch, "path"):
                hosts = rows.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array([list(set(model.tokens(h, p))) for h, p in zip(hosts, paths)], pa.list_(pa.string()))], names=["host", "said", "tokens"])

    tokens = labelled.mapInArrow(run, "host string, said string, tokens array<string>").select("host", "said", F.explode("tokens").alias("token")).distinct()
    sums = tokens.groupBy("token").agg(F.count_if(F.col("said") == "block").alias("blocked"), F.count_if(F.col("said") != "block").alias("allowed"))
    top = sums.orderBy((F.col("blocked") + F.col("allowed")).desc(), "token").limit(MOST_WORDS).collect()
    return Model(segmenter, Classifier({r["token"]: r["blocked"] for r in top}, {r["token"]: r["allowed"] for r in top}))


def judge(pages: DataFrame, rules: list[tuple[str, str]], model: Model) -> DataFrame:
    """Per row: page_id, host, path, rule, verdict, margin.

    ``rules`` of (verdict, host/path), a short list. A rule fits its host and all subdomains if the url's path
    starts with the rule's; the longest that fits decides. Where none does, the verdict is block if the
    classifier finds the segmented tokens likelier blocked; a margin of 0, as of tokens that it does not know,
    allows. Null urls and those without ``://`` have an empty host and path, fit no rule and are allowed. Urls of
    any length are whole. Repeated rows get equal verdicts, further columns are ignored, an empty table stays empty.
    """
    d = parsed(pages, rules)
    kind = d.schema["page_id"].dataType.simpleString()
    sent = pages.sparkSession.sparkContext.broadcast((model.segmenter, model.classifier))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*sent.value)
        for batch in batches:
            for rows, paths in pieces(batch, "path"):
                hosts = rows.column(1).to_pylist()
                margins = [m.classifier.margin(m.tokens(h, p)) for h, p in zip(hosts, paths)]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(margins, pa.float64())], names=["page_id", "host", "path", "rule", "said", "margin"])

    scored = d.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, said string, margin double")
    verdict = F.coalesce("said", F.when(F.col("margin") > 0, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "margin")


def accuracy(pages: DataFrame, rules: list[tuple[str, str]], model: Model) -> DataFrame:
    """(said, judged, n): the rules' verdicts on urls of held-out hosts against the classifier's own."""
    j = judge(pages, rules, model).where(F.col("rule").isNotNull() & held_out(F.col("host")))
    return j.groupBy(F.col("verdict").alias("said"), F.when(F.col("margin") > 0, "block").otherwise("allow").alias("judged")).agg(F.count(F.lit(1)).alias("n"))
