"""Derived tables that are written once and then read: the clustered log and the search index.

A table is written to the shared folder the first time a session asks for it, under a name that its input's size and time of change give,
and read from then on; it goes when the driver ends. Columns are real ones, rows are clustered by what filters ask for, and
identifiers have Bloom filters, so filters reach the Parquet scan.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import all_terms, indexed_bigrams, indexed_terms

FILE_BYTES = 128 << 20
_written: dict[tuple, str] = {}


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one only where that is unset on one machine (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="emberlog-")
        atexit.register(shutil.rmtree, folder.removeprefix("file://"), ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def kept(spark: SparkSession, name: str, source: str, make: Callable[[], DataFrame], cluster: list[str], blooms: tuple[str, ...] = ()) -> DataFrame:
    """``make()``'s rows of the table at ``source``, written once a session, ranged and sorted by ``cluster``."""
    where, files = _path(spark, source)
    size, changed = files.getContentSummary(where).getLength(), files.getFileStatus(where).getModificationTime()
    key = (spark.sparkContext.applicationId, name, source, size, changed)
    if key not in _written:
        path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        rows = make().repartitionByRange(max(1, -(-size // FILE_BYTES)), *cluster).sortWithinPartitions(*cluster)
        writer = rows.write.option("compression", "zstd")
        for column in blooms:
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        writer.parquet(path)
        target, store = _path(spark, path)
        store.deleteOnExit(target)
        _written[key] = path
    return spark.read.parquet(_written[key])


def postings(log: DataFrame) -> DataFrame:
    """term, lev_id and pair: an entry for each bounded term of each event (pair false) and each bounded adjacent pair (pair true)."""
    words = log.select("lev_id", all_terms(F.col("content")).alias("words"))
    entries = F.concat(
        F.transform(indexed_terms(F.col("words")), lambda t: F.struct(t.alias("term"), F.lit(False).alias("pair"))),
        F.transform(indexed_bigrams(F.col("words")), lambda t: F.struct(t.alias("term"), F.lit(True).alias("pair"))),
    )
    return words.select("lev_id", F.explode(entries).alias("e")).select("e.term", "lev_id", "e.pair")
