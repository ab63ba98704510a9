"""What the driver and all executors share: a folder, tables written to it, and this package."""

from __future__ import annotations

import functools
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

#: Rows in a file of a table that is known to be small.
ROWS_A_FILE = 100_000
#: A Python worker holds so many bytes of rows before it writes them as a row group.
GROUP_BYTES = 8_000_000


def reachable(spark: SparkSession) -> None:
    """Lets Python workers import this package where it is not installed but lies at the same path."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def shared_folder(spark: SparkSession) -> str:
    """A cluster names it in ``spark.checkpoint.dir``.

    Only where that is unset and all runs on this machine, as in local tests, is a temporary folder made and
    remembered in the session. Elsewhere executors would each write to a disk of their own, so that is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that the driver and all executors share (master is {master})")
        at = "file://" + tempfile.mkdtemp(prefix="inkwell-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_folder(spark)}/inkwell-{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation of what led here. The table
    stays until ``forget`` or ``clean``.

    ``rows`` says about how many rows it has at most, where that is known and ``df`` ends in a cheap step behind
    a shuffle. All rows are written, in no more files than so many need. On a mounted folder (file:) Hadoop without
    its native library starts up to three chmod processes for each file; until such a process runs chmod it shares
    all memory of its executor, and whoever adds up the memory of processes then counts the executor twice.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_A_FILE)))
    path = f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def mapped(df: DataFrame, run: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
    """``df.mapInArrow(run, schema)``, of which ``worker_written`` knows that the worker that runs ``run`` can write the rows too."""
    out = df.mapInArrow(run, schema)
    out.mapped_from = df, run
    return out


def mounted(spark: SparkSession, path: str) -> str | None:
    """The folder that ``path`` names on the mounted file system; None in a store that only Spark reaches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return store.makeQualified(at).toUri().getPath() if store.getUri().getScheme() == "file" else None


def _writer(folder: str, run: Callable[[Iterator], Iterator] | None) -> Callable[[Iterator], Iterator]:
    """Writes a task's rows, or what ``run`` makes of them, to one file in ``folder`` and gives its name; no rows, no file."""

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.parquet as pq

        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.parquet"
        # ids and hashes seldom repeat; so, tables come out about as small as Spark's, which decides how they are joined
        create = functools.partial(pq.ParquetWriter, f"{folder}/{name}", use_dictionary=False, compression="zstd")
        out, held, size = None, [], 0
        for batch in run(batches) if run else batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size >= GROUP_BYTES:
                out = out or create(held[0].schema)
                out.write_table(pa.Table.from_batches(held))
                held, size = [], 0
        if held:
            out = out or create(held[0].schema)
            out.write_table(pa.Table.from_batches(held))
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name])], names=["file"])

    return write


def worker_written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """As ``written``, but on a mounted folder (file:) Python workers write the files, which starts no processes.

    Files of tasks that were tried again or twice stay behind: the driver takes over only those that the job's
    results name. In a store that only Spark reaches, Spark writes.
    """
    spark = df.sparkSession
    path = f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    folder = mounted(spark, path)
    if folder is None:
        return written(df, name, rows)
    schema = df.schema
    source, run = getattr(df, "mapped_from", (df, None))
    if rows is not None:
        source = source.coalesce(max(1, -(-rows // ROWS_A_FILE)))
    tries = f"{folder}/_tries"
    os.makedirs(tries)
    for r in source.mapInArrow(_writer(tries, run), "file string").collect():
        os.rename(f"{tries}/{r.file}", f"{folder}/{r.file}")
    shutil.rmtree(tries, ignore_errors=True)
    out = spark.read.schema(schema).parquet(path)
    out.written_to = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def forget(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` or ``worker_written`` gave, once nothing will be computed from them again; others are left alone."""
    for t in tables:
        if getattr(t, "written_to", None):
            _delete(t.sparkSession, t.written_to)


def clean(spark: SparkSession) -> None:
    """Deletes all that this application has written, once the results that read it are used or stored."""
    _delete(spark, own_folder(spark))
