"""Small tables between the steps of near dedup are whole and lie in few files, also where shuffles have many partitions."""

import os
from collections import defaultdict

import pytest
from test_text_operators import frame, plain_components

from inkwell.llm import neardup
from inkwell.sources import shared


@pytest.fixture
def files(spark, monkeypatch):
    """Files of each table that near dedup writes, by its name; shuffles have 40 partitions."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    made = defaultdict(list)

    def written(df, name, *more):
        out = shared.written(df, name, *more)
        made[name].append(sum(x.startswith("part-") for x in os.listdir(out.written_to.removeprefix("file://"))))
        return out

    monkeypatch.setattr(neardup, "written", written)
    yield made
    for k, v in held.items():
        spark.conf.set(k, v)
    shared.clean(spark)


def test_components_of_few_edges(spark, files):
    edges = [(i, i + 1) for i in range(1, 300)] + [(1000, 2000 + i) for i in range(300)]
    got = {r.doc: r.component for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 301)} | {1000: 1000} | {2000 + i: 1000 for i in range(300)}
    assert len(files["edges"]) > 2 and set(files["edges"] + files["least"]) == {1}


def test_near_duplicates(spark, files):
    rows = [(i, " ".join(f"w{i % 40}_{j}" for j in range(30)) + f" x{i % 80}") for i in range(200)] + [(200, ""), (201, None)]
    want = plain_components([(i, t) for i, t in rows])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(frame(spark, [(i, t, None) for i, t in rows]), 80, 2).collect()}
    assert got == want
    assert all(files[k] and set(files[k]) == {1} for k in ("groups", "sizes", "ids", "edges", "least"))


def test_files_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(shared, "ROWS_A_FILE", 10)
    table = shared.written(spark.range(0, 64, 1, 16), "t", 64)
    assert sorted(r.id for r in table.collect()) == list(range(64))
    assert sum(x.startswith("part-") for x in os.listdir(table.written_to.removeprefix("file://"))) == 7
    shared.clean(spark)
