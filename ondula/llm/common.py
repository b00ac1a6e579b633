"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

ROOT = str(Path(__file__).resolve().parents[2])
#: White space that separates words everywhere in this subpackage.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"
#: Python work is done in slices of about this many text bytes, so that a worker's memory does not follow the batch size.
SLICE_BYTES = 4 << 20
#: For tables of the package's own, where the shared folder is on a local disk: Hadoop's checksummed file system sets modes by a chmod process for each file and each checksum, its raw one makes
#: plain files without a process. Other file systems (hdfs, s3a) do not see these options.
PLAIN_FILES = {"mapreduce.fileoutputcommitter.marksuccessfuljobs": "false", "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
#: Rows of a written table that one file takes, where a bound on the rows is known.
FILE_ROWS = 1 << 14

_written: dict[str, SparkSession] = {}


def text_of(column: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def reach_workers(spark: SparkSession) -> None:
    """Lets Python workers import this package when it is run from a checkout; a cluster ships it with --py-files."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, env.get("PYTHONPATH", "")]))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares: spark.checkpoint.dir. A session on one machine that has none gets a folder under its warehouse; on a cluster that is an error."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/ondula-shared"
        context.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again: cuts the lineage, survives lost executors, keeps column pruning.

    The table goes when the driver ends, or by `release`. rows: at most so many, where that is known before; a small table is then a few files and not one for each partition of its
    shuffle. On a local disk there are no checksum files and no success marker, see PLAIN_FILES.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    files = df if rows is None else df.coalesce(max(1, -(-rows // FILE_ROWS)))
    files.write.options(**PLAIN_FILES).parquet(path)
    if not _written:
        atexit.register(_remove_all)
    _written[path] = spark
    table = spark.read.schema(df.schema).parquet(path)
    table.written_at = path
    return table


def release(*tables: DataFrame) -> None:
    """Deletes written tables from which nothing more will be read."""
    for table in tables:
        spark = _written.pop(table.written_at)
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.written_at)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame) -> DataFrame:
    """Computes df into Spark's own blocks on the executors' disks, of which Hadoop makes no files. The caller unpersists it.

    For tables of a few steps that depend on the rows of their sources only, not on the order or number of their partitions: blocks that are lost with an executor are computed again.
    """
    table = df.persist(StorageLevel.DISK_ONLY)
    table.count()
    return table


def written_whole(df: DataFrame, name: str, rows: int) -> DataFrame:
    """`written` in files of FILE_ROWS rows, for a table that is small beside what its tasks read: they run as they are dealt, and only their rows are put together."""
    table = stored(df)
    try:
        return written(table, name, rows)
    finally:
        table.unpersist()


def _remove_all() -> None:
    for path, spark in _written.items():
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001 - the session may be gone when the driver ends
            return


def give_back() -> None:
    """Gives memory that is free in this process back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries than glibc
        ctypes.CDLL(None).malloc_trim(0)


def tidy(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """work, after which a worker, which waits for later tasks, keeps no free memory."""

    def then(batches: Iterator) -> Iterator:
        try:
            yield from work(batches)
        finally:
            give_back()

    return then


def arrow_map(df: DataFrame, work: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
    reach_workers(df.sparkSession)
    return df.mapInArrow(tidy(work), schema)


_kept: dict = {}


def keep(owner, make: Callable[[], object]):
    """What a Python worker keeps for its later tasks. Only one owner's is kept: what a stage before has left goes."""
    if owner not in _kept:
        _kept.clear()
        _kept[owner] = make()
    return _kept[owner]


def slices(batches: Iterator, column: str = "text", limit: int = SLICE_BYTES) -> Iterator:
    """Cuts Arrow record batches so that a piece holds about `limit` bytes of text, and one row at least."""
    for batch in batches:
        at, held = 0, 0
        lengths = batch.column(column).cast("binary")
        sizes = [0 if not v.is_valid else len(v.as_buffer() or b"") for v in lengths]
        for i, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(at, i - at)
                at, held = i, 0
            held += size
        if at < batch.num_rows:
            yield batch.slice(at)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
