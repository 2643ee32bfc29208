"""Keeping a log whole: integrity against derived tables, digests, payload figures, deletion by filter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.filters import NO_UNTIL, Filter, stored_predicate

INDEX_COLUMNS = ("index_name", "key", "lev_id")


def expected_index(log: DataFrame) -> DataFrame:
    """index_name, key, lev_id: every entry that the indexes of a log must have."""
    entries = [F.struct(F.lit(n).alias("index_name"), F.col(c).cast("string").alias("key")) for n, c in (("id", "id"), ("pubkey", "pubkey"), ("kind", "kind"), ("created_at", "created_at"))]
    tags = F.transform(F.array_distinct("idx_tags"), lambda t: F.struct(F.lit("tag").alias("index_name"), F.concat(t["name"], F.lit("="), t["value"]).alias("key")))
    return log.select("lev_id", F.explode(F.concat(F.array(*entries), tags)).alias("x")).select("x.index_name", "x.key", "lev_id")


def check_integrity(log: DataFrame, index: DataFrame) -> DataFrame:
    """The entries that an index lacks (missing) or has beside the log (extra)."""
    both = expected_index(log).withColumn("__w", F.lit(True)).unionByName(index.select(*INDEX_COLUMNS).withColumn("__w", F.lit(False)))
    seen = both.groupBy(*INDEX_COLUMNS).agg(F.bool_or("__w").alias("want"), F.bool_or(~F.col("__w")).alias("have"))
    return seen.where(F.col("want") != F.col("have")).select(*INDEX_COLUMNS, F.when(F.col("want"), "missing").otherwise("extra").alias("problem"))


def rebuilt_index(log: DataFrame) -> DataFrame:
    """The index that a log must have, as it is written anew after check_integrity found problems."""
    return expected_index(log).distinct()


def integrity_totals(problems: DataFrame) -> DataFrame:
    return problems.groupBy("index_name").agg(F.count_if(F.col("problem") == "missing").alias("missing"), F.count_if(F.col("problem") == "extra").alias("extra"))


def check_payloads(log: DataFrame, payloads: DataFrame) -> DataFrame:
    """Events without a payload and payloads without an event."""
    both = log.select("lev_id", F.lit(1).alias("e")).join(payloads.select("lev_id", F.lit(1).alias("p")), "lev_id", "full")
    return both.where("e is null or p is null").select("lev_id", F.when(F.col("e").isNull(), "no event").otherwise("no payload").alias("problem"))


def with_payload(log: DataFrame, payloads: DataFrame) -> DataFrame:
    """Events with their payload; an event without one is dropped."""
    return log.join(payloads.select("lev_id", "payload"), "lev_id")


def payload_stats(log: DataFrame, column: str = "content") -> DataFrame:
    return log.agg(F.count("*").alias("records"), F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("bytes"), F.max(F.octet_length(column)).alias("largest"))


DIGEST_BITS, DIGEST_LEVELS = 13, 5


def log_digest(log: DataFrame, payload: str = "payload") -> DataFrame:
    """n and digest of a log in order of lev_id: rows are hashed, then runs of their hashes, then runs of those, five times.

    The order matters and the digest is the same however the log is stored. A run is a range of 2^13 numbers, so that many hashes
    (512 KB) meet in one place at the most, and five levels cover all 64-bit numbers. An empty log has the hash of nothing. Rows of
    one lev_id are in order of their hashes.
    """
    framed = F.concat(F.col("lev_id").cast("string"), F.lit(":"), F.octet_length(payload).cast("string"), F.lit(":"), F.col(payload))
    rows = log.select(F.col("lev_id").alias("at"), F.sha2(framed, 256).alias("h"), F.lit(1).cast("bigint").alias("n"))
    for _ in range(DIGEST_LEVELS):
        runs = rows.groupBy(F.shiftright("at", DIGEST_BITS).alias("run"))
        inner = F.transform(F.array_sort(F.collect_list(F.struct("at", "h"))), lambda x: x["h"])
        rows = runs.agg(F.sum("n").alias("n"), F.sha2(F.array_join(inner, ""), 256).alias("h")).select(F.col("run").alias("at"), "h", "n")
    last = F.transform(F.array_sort(F.collect_list(F.struct("at", "h"))), lambda x: x["h"])  # at most two: negative numbers and the rest
    return rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sha2(F.array_join(last, ""), 256).alias("digest"))


def delete_matching(log: DataFrame, filters: list[Filter], now: int | None = None, age: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(what stays, what goes): the events that any filter matches, and those at least ``age`` seconds old; count the second for a dry run.

    A search is matched by the event's indexed terms; limits play no part. ``age`` is an upper bound of time of its own, so a
    filter with one is refused beside it, as is a call with neither filters nor ``age``.
    """
    from functools import reduce

    if not filters and age is None:
        raise ValueError("nothing says what to delete: give filters, an age, or both")
    if age is not None and any(f.until != NO_UNTIL for f in filters):
        raise ValueError("an age and a filter's until both bound the time from above: give one")
    goes = reduce(lambda a, b: a | b, [stored_predicate(f) for f in filters]) if filters else F.lit(True)
    if age is not None:
        goes = goes & (F.col("created_at") <= now - min(age, now))
    return log.where(~F.coalesce(goes, F.lit(False))), log.where(goes)


def stored_per_author(log: DataFrame) -> DataFrame:
    return log.groupBy("pubkey").agg(F.count("*").alias("n"))


def newest(log: DataFrame) -> DataFrame:
    return log.agg(F.max("lev_id").alias("lev_id"))


def latencies(samples: DataFrame, value: str, *keys: str) -> DataFrame:
    """Count and percentiles of a measure."""
    return samples.groupBy(*keys).agg(F.count("*").alias("n"), *[F.percentile(value, p).alias(f"p{round(p * 100)}") for p in (0.5, 0.9, 0.99)], F.max(value).alias("largest"))
