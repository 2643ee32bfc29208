"""Session helpers of the training-data operators: shared folder, written tables, table readers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of one Arrow batch: what a task holds of its input, on either side of the worker's pipe.
BATCH_BYTES = 4 << 20
#: Row groups of written tables: small, as a task holds one for each table it writes.
ROW_GROUP_BYTES = 32 << 20
#: On a local or mounted file system the checksummed form makes a second file for each and forks a process for each file's mode.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
#: Small tables of a computation of many steps: a file for each partition would cost more than the rows do.
ROWS_PER_FILE, LEAST_FILES = 200_000, 3


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one only where that setting is absent on one machine (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="emberlog-")
        atexit.register(shutil.rmtree, folder.removeprefix("file://"), ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of bounded size from here on: thousands of long texts in one batch would not fit a small worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")


def new_folder(spark: SparkSession, name: str) -> str:
    bounded_batches(spark)
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: its lineage is cut and survives lost executors.

    The folder goes when the driver ends.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.options(**PLAIN_FILES).option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    where, files = files_of(spark, path)
    files.deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def files_of(spark: SparkSession, path: str):
    """A path and the file system that holds it, in the JVM's terms."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


class Scratch:
    """Written tables of one computation, deleted at its end; what is to outlive it is written by ``stored`` before."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, new_folder(spark, name)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        where, files = files_of(self.spark, self.path)
        files.delete(where, True)

    def write(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """df written and read back; where at most ``rows`` rows are known to come, in as few files as hold them."""
        path = f"{self.path}/{name}-{uuid.uuid4().hex}"
        if rows is not None and (files := max(LEAST_FILES, -(-rows // ROWS_PER_FILE))) < partitions(self.spark):
            df = df.coalesce(files)
        df.write.options(**PLAIN_FILES).option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def carry(docs: DataFrame, read: list[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """(the columns that an operator reads and all others as one struct, the function that gives the caller's columns back).

    An operator's own results then can't clash with the caller's names.
    """
    others = [c for c in docs.columns if c not in read]
    rows = docs.select(*read, F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in others)).alias("__carried"))
    return rows, lambda out: out.select(*(F.col(c) if c in read else F.col(f"__carried.`{c}`") for c in docs.columns))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_hot(rows: DataFrame, table: DataFrame, on: str, weight: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with a table of one row for each key, whose ``weight`` says how many rows have it (``total`` in all).

    Keys with more than half a task's fair share of the rows are broadcast, so that no task gets one key's rows: there are fewer
    than two of them for each partition, and the driver holds their hashes, so that both sides are told apart by a filter (a light
    key with a heavy one's hash is broadcast too). The other keys are joined by shuffling. Keys have one type on both sides.
    """
    heavy = F.col(weight) > total // (2 * partitions(rows.sparkSession))
    mark = F.xxhash64(on)
    hashes = [r[0] for r in table.where(heavy).select(mark).distinct().collect()]
    if not hashes:
        return rows.join(table, on)
    here = mark.isin(hashes)
    return rows.where(here).join(F.broadcast(table.where(here)), on).unionByName(rows.where(~here).join(table.where(~here), on))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
