"""Tables written between jobs, in the folder that all executors share.

A written table cuts lineage and survives the loss of any executor. The folder
is the session's ``spark.checkpoint.dir``. Where that is unset, a session whose
executors live in this process (tests, a laptop) writes under the local temp
directory; on a cluster that would be a folder of each machine's own, and is an error.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager, contextmanager, suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a task reads or gets where a table is dealt by its rows.
ROWS_OF_TASK = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session, as a URI."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    return f"file://{tempfile.gettempdir()}/checkpoints"


class Scratch:
    """Tables written inside the ``with`` block are deleted at its end, but for those that were kept.

    Blocks may lie in one another; what an inner one keeps belongs to the outer one.
    """

    _open: list[Scratch] = []

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.made: dict[str, None] = {}
        self.kept: list[str] = []

    def __enter__(self) -> Scratch:
        Scratch._open.append(self)
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        """``df``, whose written tables outlive the block."""
        folders = _folders(df)
        self.kept += [p for p in self.made if any(f.endswith(p.rpartition("/")[2]) for f in folders)]
        return df

    def __exit__(self, *_) -> None:
        Scratch._open.remove(self)
        for path in self.made:
            if path not in self.kept:
                _delete(self.spark, path)
            elif Scratch._open:
                Scratch._open[-1].made[path] = None
        release(self.spark)


def materialise(df: DataFrame, label: str, rows_of_file: int = 0) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the table read back; a file has at most ``rows_of_file`` rows, if given."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomgraph/{label}-{uuid.uuid4().hex}"
    writer = df.write.option("maxRecordsPerFile", rows_of_file) if rows_of_file else df.write
    writer.parquet(path)
    if Scratch._open:
        Scratch._open[-1].made[path] = None
    return spark.read.schema(df.schema).parquet(path)


def _folders(df: DataFrame) -> set[str]:
    return {f.rpartition("/")[0] for f in df.inputFiles()}


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that ``materialise`` returned; later reads of them fail."""
    for df in tables:
        for folder in _folders(df):
            if "/loomgraph/" in folder:
                _delete(df.sparkSession, folder)


def release(spark: SparkSession) -> None:
    """Let the context cleaner drop shuffle files of finished jobs now, not when the driver next collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bounded_batches(spark: SparkSession, size: str = "4m") -> None:
    """Hand rows to Python in Arrow batches of at most ``size``, one row at least, unless the session has a bound of its own.

    The default is 64 MB, of which a task holds several copies.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, size)


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    before = {key: spark.conf.get(key) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def dealt_by_rows(spark: SparkSession, rows: int, each: int = ROWS_OF_TASK) -> AbstractContextManager[None]:
    """Within the block, shuffles have a partition for about ``each`` of ``rows``, so that what a task holds doesn't grow with the input.

    Adaptive execution would join partitions up to a size in compressed bytes, which says little of a hash table.
    """
    partitions = max(-(-rows // each), spark.sparkContext.defaultParallelism)
    return _settings(spark, {"spark.sql.shuffle.partitions": str(partitions), "spark.sql.adaptive.coalescePartitions.enabled": "false"})


def read_by_rows(df: DataFrame, rows: int, each: int = ROWS_OF_TASK) -> AbstractContextManager[None]:
    """Within the block, a task reads about ``each`` of the ``rows`` that the files of ``df`` make.

    Spark deals files by bytes, a share of all for each core and 128 MB at most. Of a narrow table those are tens of
    millions of rows, and a task holds the groups that they make before they are shuffled.
    """
    spark, key = df.sparkSession, "spark.sql.files.maxPartitionBytes"
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(leaves.apply(i).stats().sizeInBytes() for i in range(leaves.size()))
    bound = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return _settings(spark, {key: f"{max(min(size * each // max(rows, 1), bound), 1)}b"})


def in_small_files(df: DataFrame, label: str, each: int = ROWS_OF_TASK) -> DataFrame:
    """``df``, written anew in files of at most ``each`` rows if a task would read more than two such files' rows.

    A row group is read by one task, however few bytes a task is dealt. Writers bound groups by bytes, so those of a
    narrow table may have tens of millions of rows.
    """
    most = df.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("rows")).agg(F.max("rows")).first()[0] or 0
    return materialise(df, label, each) if most > 2 * each else df


def tidy(function: Callable) -> Callable:
    """A function over batches that hands freed memory back to the system when its partition is done: workers are used again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # a C library without it keeps the memory
                ctypes.CDLL(None).malloc_trim(0)

    return run
