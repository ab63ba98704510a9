"""Mixing, classifier, near duplicates, extraction, line dedup, url filters and rules on small tables."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.llm import html, linededup, mixing, neardup, quality, rules, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")
WS = " \t\n\x0b\f\r"


def lowered(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def frame(spark, rows, schema="doc_id long, text string, source string"):
    return spark.createDataFrame(rows, schema)


# ---------------------------------------------------------------- mixing


def plain_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        left, w = total - sum(capped.values()), sum(weight[s] for s in order if s not in capped)
        target = {s: capped.get(s, weight[s] * left / w if w else 0.0) for s in order}
        over = [s for s in order if s not in capped and target[s] > 3 * sizes[s]]
        if not over:
            return target
        capped |= {s: 3 * sizes[s] for s in over}


def mix_rows(n, seed):
    rnd = random.Random(seed)
    sources = ["b", "a", "é", None, "z", "tiny"]
    rows = [(i, " ".join(["w"] * rnd.choice([0, 1, 3, 10, 40])), "a" if rnd.random() < 0.4 else rnd.choice(sources[:5])) for i in range(n)]
    return rows + [(n, "one two", "tiny"), (n + 1, None, "empty"), (n + 2, " \n ", "empty"), rows[0], rows[0], (None, "x y", "a")]


@pytest.mark.parametrize("seed", [1, 2])
def test_mix(spark, seed):
    rows = mix_rows(3000, seed)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want = plain_targets(dict(sizes))
    d = frame(spark, rows).withColumn("size", F.lit("clash")).withColumn("cut", F.lit(1))
    got = mixing.mix(d).collect()
    taken = Counter()
    for r in got:
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size) and r.source_size == sizes[r.source]
        assert math.isclose(r.target, want[r.source], rel_tol=1e-12, abs_tol=1e-9)
        taken[r.source] += r.taken
    assert len(got) == len(rows)
    for s, t in want.items():
        assert abs(taken[s] - t) <= 40, (s, taken[s], t)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(d).collect()))
    out = mixing.repeated(d).groupBy("doc_id").count().collect()
    n = {r.doc_id: r["count"] for r in out}
    for r in got:
        if r.size and r.doc_id not in (0, None):
            assert n.get(r.doc_id, 0) == r.taken // r.size
    assert mixing.repeated(d).columns == d.columns


def test_mix_of_nothing(spark):
    assert mixing.mix(frame(spark, [])).count() == 0
    assert [(r.taken, r.target) for r in mixing.mix(frame(spark, [(1, None, "a"), (2, "", None)])).collect()] == [(0, 0.0)] * 2


# ---------------------------------------------------------------- classifier


def test_descent_solves_the_dual():
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(0, 30, 6)) for _ in range(60)]
    y = np.where(np.array([3 in x or 7 in x for x in rows]), 1.0, -1.0)
    r = quality.ratios(rows, y)
    w, b = quality.descend(rows, y, r, 0.5, epochs=2000)
    most = [0.5 * 60 / (2 * (y == v).sum()) for v in y]
    primal = 0.5 * (w @ w + b * b) + sum(c * max(0, 1 - v * (w[x] @ r[x] + b)) for x, v, c in zip(rows, y, most))
    step = rng.normal(0, 1e-3, quality.SLOTS)
    other = w + step
    worse = 0.5 * (other @ other + b * b) + sum(c * max(0, 1 - v * (other[x] @ r[x] + b)) for x, v, c in zip(rows, y, most))
    assert primal <= worse + 1e-9


def labelled(n, seed):
    rnd = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8))) for _ in range(rnd.randint(20, 60))]
        bad = rnd.random() < 0.3
        text = {0: " ".join(w.upper() + "!!" for w in words), 1: " | ".join(words), 2: " ".join([words[0]] * 40)}[i % 3] if bad else " ".join(words).capitalize() + "."
        rows.append((i, text, "s"))
        labels.append((i, int(not bad), 0))
    return rows, labels


def test_classifier_on_held_out_rows(spark):
    rows, labels = labelled(900, 3)
    extra = [(10_000, None, "s"), (10_001, "", "s"), (10_002, "w " * 40_000, "s"), (None, "null id", "s")]
    d = frame(spark, rows + extra).withColumn("score", F.lit("clash"))
    lab = frame(spark, labels + [(0, None, None), (None, 1, 1), labels[1]], "doc_id long, quality int, toxic int")
    model = quality.train(d, lab)
    got = {r.doc_id: r for r in quality.score(d, model).withColumn("held", quality.held_out(F.col("doc_id"))).collect()}
    truth = {i: q for i, q, _ in labels}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held == (i in set(held)) for i in truth)
    assert all((got[i].score >= 0.7) == bool(got[i].predicted) and 0 <= got[i].score <= 1 for i in truth)
    assert sum(got[i].predicted == truth[i] for i in held) >= 0.97 * len(held)
    assert got[10_000].score == got[10_001].score and len(got) == len(rows) + 4
    again = quality.train(d.repartition(7), lab)
    assert np.array_equal(model.weights, again.weights) and model.shift == again.shift
    assert quality.score(d.where("false"), model).count() == 0


def test_words_decide_between_equal_shapes(spark):
    """Fluent texts of one shape that differ in their words alone, one of them empty of known words."""
    rnd = random.Random(6)
    good, bad = ([a + b for a in x for b in "abcdefgh"] for x in (["mo", "la", "si"], ["zu", "kre", "vi"]))
    both = ["".join(rnd.choice("stuvw") for _ in range(4)) for _ in range(60)]
    rows = [(i, " ".join(rnd.choice(both if rnd.random() < 0.6 else good if i % 3 else bad) for _ in range(60)), "s") for i in range(600)]
    model = quality.train(frame(spark, rows), frame(spark, [(i, int(i % 3 > 0), 0) for i, _, _ in rows], "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r for r in quality.score(frame(spark, rows), model).withColumn("held", quality.held_out(F.col("doc_id"))).collect()}
    held = [r for r in got.values() if r.held]
    assert len(held) > 100 and sum(r.predicted == int(r.doc_id % 3 > 0) for r in held) >= 0.97 * len(held)


def test_classifier_without_labels(spark):
    d = frame(spark, [(1, "a b", "s")])
    none = frame(spark, [], "doc_id long, quality int, toxic int")
    assert quality.score(d, quality.train(d, none)).first().predicted == 1
    assert quality.score(d, quality.train(d, frame(spark, [(1, 0, 0)], "doc_id long, quality int, toxic int"))).first().predicted == 0


def test_labels_of_held_out_rows_do_not_matter(spark):
    rows, labels = labelled(300, 4)
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q, t) for i, q, t in labels]
    a, b = (quality.train(frame(spark, rows), frame(spark, x, "doc_id long, quality int, toxic int")) for x in (labels, flipped))
    assert np.array_equal(a.weights, b.weights)


# ---------------------------------------------------------------- near duplicates


def shingle_set(t, width=2):
    w = WORD.findall(lowered(t or ""))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()}


def plain_components(rows, width=2):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, shingle_set(t, width))
    at = {i: i for i in sets}

    def find(i):
        while at[i] != i:
            i = at[i]
        return i

    ids = sorted(sets)
    by = defaultdict(set)
    for i in ids:
        for g in sets[i]:
            by[g].add(i)
    for i in ids:
        for j in set().union(*(by[g] for g in sets[i])) if sets[i] else ():
            if j < i and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                at[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_rows(seed, groups=12, copies=14):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdefg") for _ in range(5)) for _ in range(400)]
    rows = []
    for _ in range(groups):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([6, 30, 120]))]
        for _ in range(copies):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 6])):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            rows.append((" " if rnd.random() < 0.5 else "\n").join(x.upper() if rnd.random() < 0.1 else x for x in w))
    rows += ["", None, " \n", "one", "ONE", "one two", "É a b c d e", "é a b c d e"]
    rnd.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("seed", "width"), [(1, 2), (2, 2), (3, 5)])
def test_near_duplicates(spark, monkeypatch, seed, width):
    monkeypatch.setattr(neardup, "SMALL", 4)
    rows = near_rows(seed)
    d = frame(spark, [(i, t, None) for i, t in rows] + [(5, rows[5][1], "again"), (None, "x y", "s")]).withColumn("same", F.lit(1)).withColumn("keys", F.lit(2))
    got = neardup.near_duplicates(d, 80, width).collect()
    want = plain_components(rows, width)
    assert len(got) == len(rows) + 2
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id)
        else:
            assert r.component_id is None and r.kept


def test_near_duplicates_of_nothing(spark):
    assert neardup.near_duplicates(frame(spark, [])).count() == 0
    assert [r.kept for r in neardup.near_duplicates(frame(spark, [(1, None, None), (2, "", None)])).collect()] == [True, True]


def test_chains_of_components(spark):
    rnd = random.Random(9)
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (7, 7)] + [(1000 + rnd.randrange(30), 1000 + rnd.randrange(30)) for _ in range(25)]
    at = {x: x for e in edges for x in e}
    for _ in edges:
        for a, b in edges:
            at[a] = at[b] = min(at[a], at[b])
    got = {r.doc: r.component for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: c for x, c in at.items() if any(x in e and e[0] != e[1] for e in edges)}


def test_estimates_are_unbiased():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    a, b = " ".join(words), " ".join(words[:360] + [f"v{i}" for i in rng.permutation(40)])
    sets, _ = neardup.shingles([a, b], 2)
    true = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
    same = []
    for m, c in zip(neardup.MULTIPLY, neardup.ADD):
        x, y = (s * m + c for s in sets)
        same += [x.min() == y.min(), x.max() == y.max()]
    assert abs(np.mean(same) - true) < 4 * math.sqrt(true * (1 - true) / len(same))


# ---------------------------------------------------------------- line dedup


def test_line_dedup(spark):
    rnd = random.Random(11)
    shared = ["Shared line number %02d " % i + "é" * 30 for i in range(6)]
    short = "x" * 39
    rows = []
    for i in range(60):
        ls = [rnd.choice([*shared, "own line %d of this text, which is long enough %d" % (i, rnd.random() * 9), short, "", "  "]) for _ in range(rnd.randint(1, 9))]
        rows.append((i, "\n".join(x if rnd.random() < 0.7 else f" \t{x.upper() if 'é' not in x else x}\r" for x in ls), "s"))
    rows += [(100, None, "s"), (101, "", "s"), (102, "\n", "s"), (103, "\n".join([shared[0]] * 3000), "s"), (None, shared[0], "s"), (104, "z" * 50, "s")] + [(200 + i, "y" * 45, "s") for i in range(4)]
    rows.append(rows[0])
    holders = defaultdict(set)
    for i, t, _ in rows:
        for x in (t or "").split("\n"):
            k = lowered(x.strip(WS))
            if len(k) >= 40 and i is not None:
                holders[k].add(i)
    d = frame(spark, rows).withColumn("gaps", F.lit("clash")).withColumn("n_lines", F.lit("clash"))
    got = linededup.dedup_lines(d).collect()
    assert len(got) == len(rows)
    texts = {(r[0], r[1]) for r in rows}
    for r in got:
        assert (r.doc_id, r.text) in texts and r.gaps == "clash"
        ls = (r.text or "").split("\n")
        gone = [r.doc_id is not None and len(k) >= 40 and len(holders[k]) >= 5 and max(holders[k]) != r.doc_id for k in (lowered(x.strip(WS)) for x in ls)]
        assert (r.n_lines, r.n_dropped, r.kept_text) == (len(ls), sum(gone), "\n".join(x for x, g in zip(ls, gone) if not g))
    assert sum(r.n_dropped for r in got) > 30
    assert linededup.dedup_lines(d.where("false")).count() == 0


# ---------------------------------------------------------------- extraction

PAGES = {
    "": "",
    "plain words": "plain words",
    "<p>a&amp;b &copy; &am &#233;</p>": "a&b © &am é",
    "<nav>menu</nav><article><h1>T</h1><p>One <b>two\n three</b><br><p>Four</p><aside>ad</aside><script>x='</p>'</script></article><footer>f</footer>": "T\nOne two three\nFour",
    "<body><header>site</header><main><h2>T</h2><ul><li>a<li>b</ul><div class='comments'><p>reader</p></div><form>f</form></main>": "T\na\nb",
    "<div class=ad>buy<div>now</div></div><div id=content><p>Text that is long enough to be the main text of the page.</p><p>S.</p></div><div><a href=1>l</a> <a href=2>m</a></div>": "Text that is long enough to be the main text of the page.\nS.",
    "<article><p>cut off in a ta": "cut off in a ta",
    "<article><p>x</p></div></p></span><p>y</p></article><p>after</p>": "x\ny",
    "<title>t</title><style>p{}</style><!-- c --><article><p hidden>h</p><p style='display: none'>n</p><p>v</p><div class='cookie-notice'>ok?</div></article>": "v",
    "<article><p>main</p></article><section id=comments><article class=comment><p>reader says a lot about the text above it</p></article></section>": "main",
}


@pytest.mark.parametrize("page", PAGES)
def test_main_text(page):
    assert html.main_text(page) == PAGES[page]


def test_extract(spark):
    long = "<article>" + "<p>word &amp; word</p>" * 20_000 + "</article>"
    rows = [(1, "u", None), (2, None, long), (None, "u", "<p>x"), (3, "u", "<" * 1000 + ">" * 1000), (1, "u", None), (4, "u", "<div>" * 3000 + "deep")]
    d = frame(spark, rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit("clash"))
    got = html.extract(d).collect()
    assert len(got) == 6 and all(r.n_chars == len(r.text) for r in got)
    assert [r.text for r in got if r.page_id == 2] == ["\n".join(["word & word"] * 20_000)]
    assert [r.text for r in got if r.page_id == 4] == ["deep"] and [r.text for r in got if r.page_id == 1] == ["", ""]
    assert html.extract(d.where("false")).count() == 0


# ---------------------------------------------------------------- urls

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
URLS = {
    "http://A.Example.NET/en/1?x=/fr/": ("a.example.net", "/en/1", "example.net/en/", "allow"),
    "https://b.net/EN#t": ("b.net", "/EN", "net/", "block"),
    "http://b.net": ("b.net", "", None, "allow"),
    "http://notexample.com/de/x": ("notexample.com", "/de/x", None, "allow"),
    "http://example.com/de/": ("example.com", "/de/", "example.com/de/", "block"),
    "http://x.org/fr/a://b/de/": ("x.org", "/fr/a://b/de/", "org/fr/", "allow"),
    "no scheme": ("", "", None, "allow"),
    "://": ("", "", None, "allow"),
    "http://cheappills.example.com/x": ("cheappills.example.com", "/x", None, "block"),
    "http://www.free-bets.example.org/": ("www.free-bets.example.org", "/", None, "block"),
    "http://blog.science-museum.org/en/": ("blog.science-museum.org", "/en/", None, "allow"),
    "http://ÉA.org/\n?q": ("Éa.org", "/\n", None, "allow"),
}


TRAINING = [
    *((f"http://{h}.example.net/{i}", f"<p>cheap pills and free bets, said the {h}</p>") for i, h in enumerate(["cheap-pills", "freebets", "pillsfree", "betscheap", "cheap", "pills", "freepills", "bets"] * 3)),
    *((f"http://{h}.example.net/en/{i}", "<p>the science museum and the school library</p><script>var pills;</script>") for i, h in enumerate(["science-museum", "schoollibrary", "museumschool", "library", "science", "museum"] * 3)),
]


def url_frame(spark, rows):
    return frame(spark, rows, "page_id long, url string, html string")


@pytest.fixture(scope="module")
def trained(spark):
    rows = [(i, u, h) for i, (u, h) in enumerate(TRAINING)] + [(None, None, None), (7, "no scheme", ""), (8, TRAINING[0][0], "<p>again")]
    return rows, urls.train(url_frame(spark, rows), RULES)


def test_urls(spark, trained):
    _, model = trained
    rows = [(i, u, "clash") for i, u in enumerate(URLS)] + [(99, None, "clash"), (None, "http://b.net/", "x"), (98, "http://" + "ab" * 20_000 + ".com/", "x")]
    d = frame(spark, rows, "page_id long, url string, host string").withColumn("margin", F.lit("clash")).withColumn("said", F.lit("clash"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(d, RULES, model).collect()}
    for i, u in enumerate(URLS):
        assert got[i] == URLS[u], u
    assert got[99] == ("", "", None, "allow") and got[None][3] == "block" and got[98][3] == "allow"
    assert urls.judge(d.where("false"), RULES, model).count() == 0


def test_url_model_is_plain_naive_bayes(spark, trained):
    rows, model = trained
    parts = lambda u: re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u).groups()
    hosts = {parts(u)[0].lower() for _, u, _ in rows if u and "://" in u}
    out = {r.h for r in spark.createDataFrame([(h,) for h in hosts], "h string").where(urls.held_out(F.col("h"))).collect()}
    seen = set()
    for _, u, _ in rows:
        if u and "://" in u and parts(u)[0] not in out:
            host, path = parts(u)
            said = "allow" if host.endswith("example.net") and path.startswith("/en/") else "block"
            seen |= {(host, said, t) for t in model.tokens(host, path)}
    n = {v: Counter(t for _, s, t in seen if s == v) for v in ("block", "allow")}
    words = n["block"].keys() | n["allow"].keys()
    chance = {v: {w: (n[v][w] + 1) / (sum(n[v].values()) + len(words)) for w in words} for v in n}
    assert out and words and set(model.classifier.weight) == words
    for tokens in ([], ["pills"], ["museum", "science", "free"], ["unknown", "en"]):
        want = math.log(math.prod(chance["block"].get(t, 1) for t in tokens)) - math.log(math.prod(chance["allow"].get(t, 1) for t in tokens))
        assert model.classifier.margin(tokens) == pytest.approx(want)


def test_url_words_come_from_the_pages(spark, trained):
    _, model = trained
    split = model.segmenter.split
    assert split("cheappills") == ["cheap", "pills"] and split("museumlibraryschool") == ["museum", "library", "school"] and split("zzqqxxk") == ["zzqqxxk"] and split("") == []
    assert "var" not in model.segmenter.cost
    empty = urls.train(url_frame(spark, []), RULES)
    assert empty.segmenter.split("abc") == ["abc"] and empty.classifier.margin(["abc"]) == 0
    assert empty.tokens("", "") == []


def test_url_ties_allow(spark):
    even = urls.Model(urls.Segmenter({"ab": 1}), urls.Classifier({"ab": 2, "cd": 1}, {"ab": 2, "cd": 1}))
    assert [r.verdict for r in urls.judge(url_frame(spark, [(1, "http://ab.com/ab", None)]), RULES, even).collect()] == ["allow"]


def test_url_accuracy_on_held_out_hosts(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = {(r.said, r.judged): r.n for r in urls.accuracy(pages, RULES, urls.train(pages, RULES)).collect()}
    right = sum(n for (a, b), n in rows.items() if a == b)
    assert right >= 0.8 * sum(rows.values()) and rows.get(("allow", "block"), 0) == 0


def test_segmentation_is_the_likeliest():
    """Against all ways to split, a letter run of no word being one unknown piece."""
    s = urls.Segmenter({"a": 3, "ab": 5, "ba": 4, "bab": 2})
    cost = lambda parts: sum(s.cost[p] if known else s.start + s.unknown * len(p) for p, known in parts)

    def ways(t):
        if not t:
            yield []
        for i in range(1, len(t) + 1):
            for rest in ways(t[i:]):
                if t[:i] in s.cost:
                    yield [(t[:i], True), *rest]
                yield [(t[:i], False), *rest]

    for t in ("a", "abab", "babcab", "cc", "abccba"):
        best = min(cost(w) for w in ways(t))
        parts = s.split(t)
        assert math.isclose(min(cost(list(zip(parts, k))) for k in __import__("itertools").product([True, False], repeat=len(parts)) if all(p in s.cost or not f for p, f in zip(parts, k))), best)


# ---------------------------------------------------------------- rules


def plain_metrics(t):
    t = t or ""
    w = WORD.findall(t)
    where = defaultdict(list)
    for i in range(len(w) - 2):
        where[tuple(w[i : i + 3])].append(i)
    again = {i + o for at in where.values() if len(at) > 1 for i in at for o in range(3)}
    seen, dup = set(), 0
    for x in t.split("\n"):
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(again)


def test_metrics_and_base_rules(spark):
    rnd = random.Random(12)
    rows = [(i, "".join(rnd.choice(["a", "b", "é", " ", " ", "\n", "\t", "#", "|", "\U0001f600"]) for _ in range(rnd.randint(0, 200))), "s") for i in range(200)]
    rows += [(500, None, "s"), (501, "", "s"), (502, "a b c " * 8000, "s"), (None, "x", "s"), rows[1]]
    d = frame(spark, rows).withColumn("w", F.lit("clash")).withColumn("n_words", F.lit("clash"))
    labels = frame(spark, [(1, 1), (2, None), (None, 1)], "doc_id long, quality int")
    texts = dict((r[0], r[1]) for r in rows)
    got = rules.judge(d, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        want = plain_metrics(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert r.base_failed == failed and r.kept == (not failed)
    assert rules.judge(d.where("false"), labels).count() == 0


def test_binomial_bound_is_exact():
    for n in (1, 20, 300):
        for k in range(0, n, max(1, n // 7)):
            for alpha in (0.01, 0.2):
                tail = sum(math.comb(n, j) * alpha**j * (1 - alpha) ** (n - j) for j in range(k + 1))
                assert rules.surely_below(k, n, alpha, 0.05) == (k < alpha * n and tail <= 0.05)
    assert not rules.surely_below(0, 0, 0.5, 0.5)


def test_cutoffs_keep_good_documents(spark):
    rnd = random.Random(13)
    word = lambda: "".join(rnd.choice("abcdefghijkl") for _ in range(7))
    rows, labels = [], []
    for i in range(4000):
        bad = i % 10 == 0
        rows.append((i, " ".join(word() + ("###" if bad else "") for _ in range(55)) + ("*" if rnd.random() < 0.5 else ""), "s"))
        if not bad:
            labels.append((i, 1))
    got = {r.doc_id: r for r in rules.judge(frame(spark, rows), frame(spark, labels, "doc_id long, quality int")).collect()}
    good = [i for i in got if i % 10]
    assert not any(got[i].kept for i in got if i % 10 == 0)
    assert sum(got[i].kept for i in good) >= 0.99 * len(good)


def test_cutoffs_hold_their_promise(spark):
    """False rejections of good documents, drawn anew many times, exceed alpha in at most delta of the draws, and cutoffs are found."""
    rnd = np.random.default_rng(3)
    risk = rules.Risk(alpha=0.1, delta=0.2, grid=(0.02, 0.05, 0.1, 0.2, 0.3, 0.5))
    delta = risk.delta / ((len(rules.BANDS) + 1) * len(rules.RATIOS))
    # the true chance that a good document exceeds a cutoff c, per rule
    true = {"symbol_share": lambda c: max(0.0, 0.25 - c), "dup_line_share": lambda c: 0.12 if c < 0.3 else 0.0, "repeat_share": lambda c: 0.5 * (c < 0.06)}
    draws, broken, found = 300, 0, 0
    rows = []
    for d in range(draws):
        for name in rules.RATIOS:
            x = {"symbol_share": np.maximum(0, 0.25 - rnd.random(200)), "dup_line_share": np.where(rnd.random(200) < 0.12, 0.3, 0.0), "repeat_share": np.where(rnd.random(200) < 0.5, 0.06, 0.0)}[name]
            cut = None
            for c in sorted(risk.grid, reverse=True):
                if not rules.surely_below(int((x > c).sum()), 200, risk.alpha, delta):
                    break
                cut = c
            rows.append((d, name, cut))
    for d in range(draws):
        mine = [(n, c) for k, n, c in rows if k == d and c is not None]
        found += len(mine)
        broken += any(true[n](c) > risk.alpha for n, c in mine)
    assert found > 2 * draws and broken <= risk.delta * draws


def test_cutoffs_of_both_labels(spark):
    """A sequence ends at its first failure, and of safe cutoffs the one with the largest gain is taken."""
    rows = [(i, 100, 100, s, 0, 0, 10, q) for q, shares in ((1, [0] * 280 + [12] * 3 + [4] * 17), (0, [45] * 30 + [8] * 10)) for i, s in enumerate(shares)]
    known = spark.createDataFrame(rows, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_text_lines long, quality int")
    got = rules.cutoffs(known, rules.Risk())
    # 0.1 rejects 3 of 300 good and 30 of 40 bad, 0.05 all bad at the same cost; 0.02 would reject 20 of 300: too many
    safe = [c for c in rules.GRID if rules.surely_below(sum(s > 100 * c for s in [0] * 280 + [12] * 3 + [4] * 17), 300, 0.03, 0.05 / 9)]
    gain = {c: sum(s > 100 * c for s in [45] * 30 + [8] * 10) / 40 - sum(s > 100 * c for s in [12] * 3 + [4] * 17) / 300 for c in safe}
    assert got[0, "symbol_share"] == max(safe, key=lambda c: (gain[c], c)) and min(safe) > 0.02
    assert set(got) == {(0, n) for n in rules.RATIOS} and got[0, "dup_line_share"] == max(rules.GRID)
    alone = rules.cutoffs(known.where("quality = 1"), rules.Risk())
    assert alone[0, "symbol_share"] == min(safe) and alone[0, "dup_line_share"] == min(rules.GRID)


def test_lines_of_repeated_ids(spark):
    """Rows of one id with different texts lose their own shared lines and nothing else."""
    shared = "this line is shared by many documents, word for word"
    rows = [(1, "the first text's own line, which is long enough to count\nsecond", "s"), (1, f"{shared}\nown", "s"), (1, f"{shared}\nown", "s")] + [(i, f"x{i}\n{shared}", "s") for i in range(2, 8)]
    got = sorted((r.doc_id, r.text, r.n_dropped, r.kept_text) for r in linededup.dedup_lines(frame(spark, rows)).collect())
    want = sorted((i, t, int(shared in t and i != 7), t if i == 7 else t.replace(f"{shared}\n", "").replace(f"\n{shared}", "")) for i, t, _ in rows)
    assert got == want


def test_line_plan_streams(spark):
    """Hashes are dealt by range, sorted by hash, document and position, and counted by a window."""
    lines = linededup.long_lines(frame(spark, [(i, "l" * 50, "s") for i in range(9)]))
    shared = linededup.shared_lines(lines)
    plan = shared._jdf.queryExecution().executedPlan().toString()
    window, sort, exchange = plan.index("Window ["), plan.index("Sort [k1"), plan.index("rangepartitioning(k1")
    assert window < sort < exchange and "holder" in plan[sort : plan.index("\n", sort)] and "DESC" in plan[sort : plan.index("\n", sort)] and "at#" in plan[sort : plan.index("\n", sort)]
    assert [r.holder for r in shared.collect()] == [8]


def test_a_very_long_text_and_line(spark):
    long = "\n".join(["shared and long enough to be a key by itself", "z" * 3_000_000, *(f"line {i} of its own" for i in range(50_000))])
    rows = [(i, long, "s") for i in range(5)]
    got = {r.doc_id: (r.n_lines, r.n_dropped) for r in linededup.dedup_lines(frame(spark, rows)).select("doc_id", "n_lines", "n_dropped").collect()}
    assert got == {i: (50_002, 0 if i == 4 else 2) for i in range(5)}
