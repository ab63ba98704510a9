"""Tables that Python workers write are whole and start no processes: a file that Hadoop writes has a .crc beside it, and each costs a chmod."""

import os

import pytest
from pyspark.sql import functions as F
from test_text_operators import frame, plain_components

from inkwell.llm import neardup
from inkwell.sources import shared


def names(spark, table):
    return [x for _, _, files in os.walk(shared.mounted(spark, table.written_to)) for x in files]


@pytest.fixture
def clean(spark):
    yield
    shared.clean(spark)


def test_near_dedup_writes_no_file_through_hadoop(spark, monkeypatch, clean):
    made, write = {}, neardup.written

    def written(df, name, *more):
        out = write(df, name, *more)
        made[name] = made.get(name, []) + names(spark, out)
        return out

    monkeypatch.setattr(neardup, "written", written)
    rows = [(i, " ".join(f"w{i % 40}_{j}" for j in range(30)) + f" x{i % 80}", None) for i in range(200)] + [(200, "", None), (201, None, None)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(frame(spark, rows), 80, 2).collect()}
    assert got == plain_components([(i, t) for i, t, _ in rows])
    assert {"signatures", "sets", "links", "edges", "least", "result"} <= set(made)
    assert [x for files in made.values() for x in files if not x.startswith("part-")] == []


def test_rows_of_all_kinds(spark, monkeypatch, clean):
    monkeypatch.setattr(shared, "GROUP_BYTES", 1000)
    odd = F.col("id") % 2 == 1
    d = spark.range(0, 5000, 1, 7).select("id", F.when(odd, F.concat(F.lit("é"), "id")).alias("s"), F.when(odd, F.sha1(F.col("id").cast("string").cast("binary")).cast("binary")).alias("b"), F.when(odd, F.array("id", F.lit(None))).alias("l"), odd.alias("o"), F.col("id").cast("decimal(38,0)").alias("n"))
    got = shared.worker_written(d, "t")
    assert got.dtypes == d.dtypes and sorted(got.collect()) == sorted(d.collect())
    assert len(names(spark, got)) == 7 and os.listdir(shared.mounted(spark, got.written_to)).count("_tries") == 0
    shared.forget(got)
    assert not os.path.exists(shared.mounted(spark, got.written_to))


def test_files_follow_the_rows(spark, monkeypatch, clean):
    monkeypatch.setattr(shared, "ROWS_A_FILE", 10)
    got = shared.worker_written(spark.range(0, 64, 1, 16), "t", 64)
    assert sorted(r.id for r in got.collect()) == list(range(64)) and len(names(spark, got)) == 7


def test_the_worker_that_maps_writes(spark, clean):
    def run(batches):
        for b in batches:
            yield b.slice(0, 1)

    d = shared.mapped(spark.range(0, 40, 1, 4), run, "id long")
    got = shared.worker_written(d, "t")
    assert sorted(r.id for r in d.collect()) == sorted(r.id for r in got.collect()) == [0, 10, 20, 30]
    few = shared.worker_written(d.where("id = 10"), "t")
    assert [r.id for r in few.collect()] == [10] and len(names(spark, few)) == 1


def test_empty(spark, clean):
    got = shared.worker_written(spark.range(0).select("id", F.lit("x").alias("s")), "t")
    assert got.columns == ["id", "s"] and got.collect() == [] and got.isEmpty()


def test_a_store_that_only_spark_reaches(spark, monkeypatch, tmp_path):
    (tmp_path / "shared").mkdir()
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.inkwell.link./shared", f"file://{tmp_path}/shared")
    monkeypatch.setattr(shared, "shared_folder", lambda _: "viewfs://inkwell/shared")
    got = shared.worker_written(spark.range(10), "t")
    assert shared.mounted(spark, got.written_to) is None and sorted(r.id for r in got.collect()) == list(range(10))
    shared.clean(spark)
    assert os.listdir(tmp_path / "shared") == []
