"""Streams: standing queries, the hand-over from history to live events, rate limits, stateful writes, relaying."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.codec import is_ephemeral
from ..functions.terms import live_terms
from ..operators.query import run_group
from ..operators.subscriptions import advanced_marks, match


def file_log(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int = 1) -> DataFrame:
    """A log that grows by files, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def live_matches(stream: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """conn, sub, lev_id of a streaming log: a stream-static join, without state."""
    return match(stream, subscriptions)


def deliver(stream: DataFrame, subscriptions: DataFrame, out: str, checkpoint: str, store_ephemeral: bool = False) -> StreamingQuery:
    """Write each batch's deliveries to ``out`` as Parquet, a folder for each batch, so a repeated batch replaces itself.

    Ephemeral events are delivered without moving marks; marks are the largest stored lev_id sent (``out``/marks).
    """

    def one(batch: DataFrame, number: int) -> None:
        found = match(batch, subscriptions).distinct()
        kinds = batch.select("lev_id", is_ephemeral(F.col("kind")).alias("ephemeral"))
        found = found.join(kinds, "lev_id")
        found.write.mode("overwrite").parquet(f"{out}/sent/batch={number}")
        moved = found if store_ephemeral else found.where(~F.col("ephemeral"))
        advanced_marks(moved).write.mode("overwrite").parquet(f"{out}/marks/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hand_over(log: DataFrame, filters, stored_up_to: int) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """(history, live): history holds arrivals up to a number, live takes any later log or stream from the next one on: no gap, no repeat.

    Live events are matched as standing queries match them: a search by all of the content's terms.
    """
    from ..plans.filters import group_predicate

    def later_of(later: DataFrame) -> DataFrame:
        rows = later.where(F.col("lev_id") > stored_up_to)
        if any(f.search for f in filters):
            return rows.withColumn("terms", live_terms(F.col("content"))).where(group_predicate(filters, live=True)).select(*later.columns)
        return rows.where(group_predicate(filters, live=True))

    return run_group(log.where(F.col("lev_id") <= stored_up_to), filters), later_of


class TokenBucket(StatefulProcessor):
    """A bucket for each key: it refills with time up to its burst, an admitted event takes one token; idle keys are forgotten."""

    def __init__(self, rate: float, burst: float, idle_ms: int = 600_000):
        self.rate, self.burst, self.idle_ms = rate, burst, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", "tokens double, at double", self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["at", "lev_id"])
        tokens, last = self.bucket.get() if self.bucket.exists() else (float(self.burst), float(pdf["at"].iloc[0]))
        verdicts = []
        for at in pdf["at"]:
            tokens, last = admit(tokens, last, float(at), self.rate, self.burst)
            verdicts.append(tokens >= 1)
            tokens -= tokens >= 1
        self.bucket.update((float(tokens), float(last)))
        yield pd.DataFrame({"lev_id": pdf["lev_id"], "admitted": verdicts})

    def close(self) -> None:
        pass


def admit(tokens: float, last: float, now: float, rate: float, burst: float) -> tuple[float, float]:
    """The bucket at a later time."""
    return min(burst, tokens + max(0.0, now - last) * rate), max(now, last)


def rate_limited(stream: DataFrame, key: str, rate: float, burst: float) -> DataFrame:
    """lev_id, admitted of a stream (lev_id, at in seconds, key). No rate or burst: all are admitted."""
    if not rate or not burst:
        return stream.select("lev_id", F.lit(True).alias("admitted"))
    return stream.groupBy(key).transformWithStateInPandas(TokenBucket(rate, burst), "lev_id bigint, admitted boolean", "append", "ProcessingTime")


def rate_limited_batch(log: DataFrame, key: str, rate: float, burst: float) -> DataFrame:
    """The same verdicts over a finished log, each key's rows in order."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at", "lev_id"])
        tokens, last, verdicts = float(burst), float(pdf["at"].iloc[0]), []
        for at in pdf["at"]:
            tokens, last = admit(tokens, last, float(at), rate, burst)
            verdicts.append(tokens >= 1)
            tokens -= tokens >= 1
        return pd.DataFrame({"lev_id": pdf["lev_id"], "admitted": verdicts})

    return log.select("lev_id", "at", key).groupBy(key).applyInPandas(one, "lev_id bigint, admitted boolean")


def write_stream(stream: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Append each batch's new ids to ``store``; repeats within the batch and ids already stored stay out.

    State is the store itself, so it is not bounded by a watermark; a batch that runs again overwrites its own folder.
    """

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.where(~is_ephemeral(F.col("kind"))).orderBy("lev_id").dropDuplicates(["id"])
        path = spark._jvm.org.apache.hadoop.fs.Path(store)
        found = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        if found:
            old = spark.read.parquet(store)
            new = new.join(old.where(F.col("batch") != number).select("id"), "id", "left_anti").select(*batch.columns)
        new.write.mode("overwrite").parquet(f"{store}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def to_upload(log: DataFrame, received: DataFrame, cursor: int) -> DataFrame:
    """What a relay link sends: arrivals after its cursor that it did not itself just download. The cursor moves after the send succeeded."""
    return log.where(F.col("lev_id") > cursor).join(received.select("id").distinct(), "id", "left_anti").select(*log.columns)


def reconnect_delays(first: float = 1.0, most: float = 60.0) -> Iterator[float]:
    """Waits between tries: doubling, up to a bound."""
    wait = first
    while True:
        yield wait
        wait = min(most, wait * 2)
