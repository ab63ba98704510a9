"""Near duplicates inside a large group of texts that lie just below the limit."""

import random

import numpy as np
from test_text_operators import frame, plain_components

from inkwell.llm import neardup


def template_rows(n, twins, seed=5):
    """Texts of one template at 87 / 111; each of the last ``twins`` is at 88 / 110, 0.8 exactly, to one of the first."""
    rnd = random.Random(seed)
    base = [f"t{i}" for i in range(100)]
    own = [[f"o{d}_{i}" for i in range(11)] for d in range(n - twins)]
    for d in range(twins):
        mine = [f"p{d}_{i}" for i in range(11)]
        mine[4:6] = own[d][4:6]
        own.append(mine)
    rnd.shuffle(own)
    return [(i, " ".join(base[:40] + x + base[51:])) for i, x in enumerate(own)]


def test_links_inside_a_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 128)
    rows = template_rows(700, 60)
    want = plain_components(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(frame(spark, [(i, t, None) for i, t in rows]), 80, 2).collect()}
    assert sum(c != i for i, (_, c) in want.items()) == 60
    assert got == want


def test_form_letters(spark):
    """3,000 texts of one 396-word template: pairs share 5 words more (0.806), all others lie at 0.788."""
    base = " ".join(f"t{i}" for i in range(396))
    rows = [(d, " ".join([base, *(f"p{d // 2}_{i}" for i in range(5)), *(f"o{d}_{i}" for i in range(48))]), None) for d in range(3000)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(frame(spark, rows), 80, 2).collect()}
    assert got == {d: (448, d - d % 2) for d in range(3000)}


def test_a_very_long_text(spark):
    long = " ".join(f"w{i % 70_001}" for i in range(300_000))
    rows = [(1, long, None), (2, long + " end", None), (3, "w1 w2 w3 w4 w5", None)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(frame(spark, rows)).collect()}
    assert got == {1: (70_001, 1), 2: (70_002, 1), 3: (1, 3)}


def test_blocks_link_what_pairs_do(monkeypatch):
    monkeypatch.setattr(neardup, "WIDTH", 16)
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.choice(90, 60)).astype(np.uint64) for _ in range(60)] + [np.arange(40 + i, dtype=np.uint64) for i in range(20)]
    c = np.array([i // 2 for i in range(80)])
    for right in (np.zeros(80, bool), rng.random(80) < 0.5):
        met = [(i, j) for i in range(80) for j in range(i) if not right.any() or right[i] != right[j]]
        links = {(c[i], c[j]) for i, j in met if c[i] != c[j] and 100 * len(np.intersect1d(sets[i], sets[j])) >= 60 * len(np.union1d(sets[i], sets[j]))}

        def groups(edges):
            at = list(range(40))
            for _ in at:
                for a, b in edges:
                    at[a] = at[b] = min(at[a], at[b])
            return at

        found = neardup.similar_rows(sets, right, c, 60)
        assert links and len(found) < 40 and groups(found) == groups(links)
