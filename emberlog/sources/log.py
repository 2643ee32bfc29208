"""Event logs: the adapter from the events table, JSON lines in and out, point reads and ranges.

A log has lev_id (order of arrival), created_at (seconds), pubkey, id, kind, tags (arrays of strings), idx_tags (distinct
one-letter tags as name and value) and content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.codec import CodecError, event_id, from_lower_hex, parse_strict, stored_json, verify_signature

LOG_COLUMNS = ("lev_id", "created_at", "pubkey", "id", "kind", "tags", "idx_tags", "content")
MAX_EVENT_BYTES, MAX_TAGS, MAX_TAG_BYTES = 1 << 20, 2000, 1024

#: The adapter's kinds: one each of the plain, replaceable, addressable and ephemeral classes, and a reaction.
KINDS = {"view": 1, "click": 7, "signup": 0, "purchase": 30023, "error": 20001}


def indexed(tags: Column) -> Column:
    """Distinct one-letter tags with a value of at most 255 bytes; e and p only with 64 lower-case hex digits."""
    named = F.filter(tags, lambda t: F.get(t, F.lit(0)).rlike("^[A-Za-z]$") & (F.size(t) > 1))
    pairs = F.transform(named, lambda t: F.struct(t[0].alias("name"), t[1].alias("value")))
    good = F.filter(pairs, lambda p: F.when(p["name"].isin("e", "p"), p["value"].rlike("^[0-9a-f]{64}$")).otherwise(F.octet_length(p["value"]) <= 255))
    return F.array_distinct(good)


def events_log(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The events table as a log: k is tag t, and tag d of addressable events; columns named in ``keep`` pass through."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.coalesce(*[F.when(F.col("event_type") == name, k) for name, k in KINDS.items()])
    k = F.get_json_object("props", "$.k")
    rows = events.select(
        F.col("event_id").alias("lev_id"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("created_at"),
        F.sha2(F.col("user_id").cast("string"), 256).alias("pubkey"),
        F.sha2(F.concat(F.lit("e"), F.col("event_id").cast("string")), 256).alias("id"),
        kind.alias("kind"),
        k.alias("k"),
        *keep,
    )
    tags = F.when(F.col("kind") == 30023, F.array(F.array(F.lit("d"), F.col("k")), F.array(F.lit("t"), F.col("k")))).otherwise(F.array(F.array(F.lit("t"), F.col("k"))))
    rows = rows.withColumn("tags", tags)
    return rows.withColumn("idx_tags", indexed(F.col("tags"))).withColumn("content", F.lit(""))


def documents_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table as the content side of a log: kind 1, author by source, time by doc_id."""
    return as_documents_log(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def as_documents_log(docs: DataFrame) -> DataFrame:
    """The same of any rows with the columns of documents, a stream's too."""
    return docs.select(
        F.col("doc_id").alias("lev_id"), F.col("doc_id").alias("created_at"), F.sha2("source", 256).alias("pubkey"), F.sha2(F.concat(F.lit("d"), F.col("doc_id").cast("string")), 256).alias("id"),
        F.lit(1).alias("kind"), F.array(F.array(F.lit("l"), F.col("lang"))).alias("tags"), F.array(F.struct(F.lit("l").alias("name"), F.col("lang").alias("value"))).alias("idx_tags"), F.coalesce("text", F.lit("")).alias("content"),
    )


EVENT = T.StructType([T.StructField(n, t) for n, t in (("id", T.StringType()), ("pubkey", T.StringType()), ("created_at", T.LongType()), ("kind", T.IntegerType()), ("tags", T.ArrayType(T.ArrayType(T.StringType()))), ("content", T.StringType()), ("sig", T.StringType()))])


def check_event(line: str, verify: bool = False) -> tuple[str | None, str | None]:
    """(stored form, null) of a well-formed event whose id is right (and, with ``verify``, whose signature is), or (null, reason)."""
    try:
        e = parse_strict(line)
        if not isinstance(e, dict):
            raise CodecError("not an object")
        for name, size in (("id", 32), ("pubkey", 32), ("sig", 64)):
            if not isinstance(e.get(name), str) or len(from_lower_hex(e[name])) != size:
                raise CodecError(f"bad {name}")
        for name, most in (("created_at", (1 << 63) - 1), ("kind", 65535)):
            if isinstance(e.get(name), bool) or not isinstance(e.get(name), int) or not 0 <= e[name] <= most:
                raise CodecError(f"bad {name}")
        tags = e.get("tags")
        if not isinstance(tags, list) or not all(isinstance(t, list) and t and all(isinstance(x, str) for x in t) for t in tags):
            raise CodecError("bad tags")
        if len(tags) > MAX_TAGS:
            raise CodecError("too many tags")
        if any(len(t) > 1 and len(t[1].encode()) > MAX_TAG_BYTES for t in tags):
            raise CodecError("tag value too large")
        if not isinstance(e.get("content"), str):
            raise CodecError("bad content")
        text = stored_json(e)
        if len(text.encode()) > MAX_EVENT_BYTES:
            raise CodecError("event too large")
        if event_id(e) != e["id"]:
            raise CodecError("bad event id")
        if verify and not verify_signature(e["pubkey"], e["id"], e["sig"]):
            raise CodecError("bad signature")
        return text, None
    except CodecError as error:
        return None, str(error)


def _checker(verify: bool):
    def checked(lines):
        import pandas as pd

        return pd.DataFrame([check_event(x, verify) for x in lines], columns=["payload", "reason"])

    return checked


def read_jsonl(spark: SparkSession, path: str, max_line_bytes: int = 2 * MAX_EVENT_BYTES, verify: bool = False) -> tuple[DataFrame, DataFrame]:
    """(log without lev_id, rejected lines with reasons) of JSON lines; a line over the bound is rejected unread.

    ``verify`` checks signatures too, which is some milliseconds a line.
    """
    lines = spark.read.text(path).where("trim(value) != ''")
    fits = lines.where(F.octet_length("value") <= max_line_bytes)
    check = F.pandas_udf(_checker(verify), "payload string, reason string")
    checked = fits.select("value", check("value").alias("c")).select("value", "c.*")
    events = checked.where("reason is null").select("payload", F.from_json("payload", EVENT).alias("e")).select("e.*", "payload").withColumn("idx_tags", indexed(F.col("tags")))
    rejected = checked.where("reason is not null").select("value", "reason").union(lines.where(F.octet_length("value") > max_line_bytes).select(F.substring("value", 1, 200), F.lit("line too large")))
    return events, rejected


def export_rows(log: DataFrame, since: int = 0, until: int | None = None, reverse: bool = False) -> DataFrame:
    """A log's rows of a time range in order of (created_at, lev_id); ``.write.text`` of payload makes JSON lines."""
    rows = log.where(F.col("created_at") >= since)
    rows = rows if until is None else rows.where(F.col("created_at") <= until)
    return rows.orderBy(*(F.desc(c) if reverse else F.asc(c) for c in ("created_at", "lev_id")))


def by_lev_id(log: DataFrame, lev_id: int) -> DataFrame:
    return log.where(F.col("lev_id") == lev_id)


def by_id(log: DataFrame, event: str) -> DataFrame:
    return log.where(F.col("id") == event)


def changes_from(log: DataFrame, lev_id: int) -> DataFrame:
    """The change feed: rows from an arrival number on, in order."""
    return log.where(F.col("lev_id") >= lev_id).orderBy("lev_id")


def compacted(log: DataFrame, path: str, files: int, codec: str = "zstd") -> None:
    """Rewrite a log clustered by kind and time, so that both prune row groups."""
    log.repartitionByRange(files, "kind", "created_at").sortWithinPartitions("kind", "created_at", "lev_id").write.option("compression", codec).parquet(path)
