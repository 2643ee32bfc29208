"""Answering requests: groups of filters with limits and caps, counts, sketches, ranked search."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.filters import Filter, predicate
from ..sources.store import postings

Visible = Callable[[DataFrame], DataFrame]
REQUEST_CAP = 2000
_NEWEST = ("created_at", "lev_id")


def _all(df: DataFrame) -> DataFrame:
    return df


def run_filter(log: DataFrame, f: Filter, visible: Visible = _all, index: DataFrame | None = None) -> DataFrame:
    """A filter's newest visible events, at most its limit. A search filter is ranked: see search_filter."""
    if f.limit == 0:
        return log.where(F.lit(False))
    if f.search:
        return search_filter(log, f, visible, index)
    return visible(log.where(predicate(f))).orderBy(*_NEWEST, ascending=False).limit(f.limit)


def run_group(log: DataFrame, filters: list[Filter], cap: int | None = REQUEST_CAP, visible: Visible = _all, index: DataFrame | None = None) -> DataFrame:
    """Filters in list order, each with its own limit; an event counts in every filter's limit but is sent once, where it came first.

    Adds filter_idx; at most ``cap`` distinct events in order of sending. The rows that meet in one place are
    at most the filters' limits, never the log.
    """
    if len(filters) > 1 and all(f.search for f in filters):
        hits = reduce(DataFrame.unionByName, [run_filter(log, f, visible, index).withColumn("filter_idx", F.lit(i)) for i, f in enumerate(filters)])
        best = hits.groupBy("lev_id").agg(F.max_by(F.struct(*hits.columns), F.struct("score", -F.col("filter_idx"))).alias("x")).select("x.*")
        ordered = best.orderBy("score", *_NEWEST, ascending=False)
        return ordered if cap is None else ordered.limit(cap)
    sent = []
    for i, f in enumerate(filters):
        rows = run_filter(log, f, visible, index).withColumn("filter_idx", F.lit(i))
        order = F.struct(F.lit(0).cast("long").alias("a"), F.col("created_at").alias("b"), F.col("lev_id").alias("c")) if not f.search else F.struct(F.col("score").alias("a"), F.col("created_at").alias("b"), F.col("lev_id").alias("c"))
        sent.append(rows.withColumn("__order", order).select(*log.columns, "filter_idx", "__order"))
    rows = reduce(DataFrame.unionByName, sent)
    first = rows.groupBy("lev_id").agg(F.min_by(F.struct(*rows.columns), "filter_idx").alias("x")).select("x.*") if len(filters) > 1 else rows
    first = first.orderBy("filter_idx", F.desc("__order"))
    return (first if cap is None else first.limit(cap)).drop("__order")


def count_group(log: DataFrame, filters: list[Filter], cap: int, visible: Visible = _all) -> DataFrame:
    """count and limited: distinct events over the group, stopped at the cap; the request cap plays no part."""
    ids = reduce(DataFrame.union, [run_filter(log, f, visible).select("lev_id") for f in filters]).distinct()
    return ids.limit(cap + 1).agg(F.count("*").alias("n")).select(F.least("n", F.lit(cap)).alias("count"), (F.col("n") > cap).alias("limited"))


# -- sketch of distinct authors ---------------------------------------------------------------------------------------


def sketch_registers(events: DataFrame, offset: int) -> DataFrame:
    """reg, rank: 256 registers by the pubkey's byte at ``offset``; rank is the zero bits that lead the next 56, plus one."""
    window = F.substring("pubkey", 2 * offset + 1, 16)
    reg = F.conv(F.substring(window, 1, 2), 16, 10).cast("int")
    value = F.conv(F.substring(window, 3, 14), 16, 10).cast("long")
    rank = F.when(value == 0, 57).otherwise(57 - F.length(F.bin(value)))
    return events.select(reg.alias("reg"), rank.alias("rank")).groupBy("reg").agg(F.max("rank").alias("rank"))


def merge_registers(*sketches: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, sketches).groupBy("reg").agg(F.max("rank").alias("rank"))


def sketch_hex(registers: DataFrame) -> DataFrame:
    """The registers as 512 hex digits; without any, all zeros."""
    found = registers.agg(F.map_from_entries(F.collect_list(F.struct("reg", "rank"))).alias("m"))
    one = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.lower(F.lpad(F.hex(F.coalesce(F.try_element_at("m", i), F.lit(0)).cast("long")), 2, "0")))
    return found.select(F.array_join(one, "").alias("hll"))


# -- ranked search ----------------------------------------------------------------------------------------------------


def document_frequency(index: DataFrame) -> DataFrame:
    """term, df over all stored events, hidden ones too, from their postings."""
    return index.where(~F.col("pair")).groupBy("term").agg(F.count("*").alias("df"))


def base_score(term_counts: list[Column]) -> Column:
    """Rarer terms weigh more: the whole part of 10^9 / (df + 1), times 100, summed."""
    return reduce(lambda a, b: a + b, [F.floor(F.lit(1_000_000_000) / (c + 1)).cast("long") * 100 for c in term_counts])


def search_filter(log: DataFrame, f: Filter, visible: Visible = _all, index: DataFrame | None = None) -> DataFrame:
    """The best events of a search filter, with score: every term, and 2 * 10^9 for each adjacent pair of the query that stands in it.

    The limit is taken before visibility: hidden events use it up. Document frequencies count hidden events too. ``index`` (the
    postings of the log) is read for the query's terms only; without one the contents are tokenised here. The ranking
    carries no contents: the best rows meet the log at the end.
    """
    terms = list(f.search.terms)
    pairs = [f"{a} {b}" for a, b in zip(f.search.phrase, f.search.phrase[1:], strict=False)]
    index = postings(log) if index is None else index
    entries = index.where((~F.col("pair") & F.col("term").isin(*terms)) | (F.col("pair") & F.col("term").isin(*pairs)) if pairs else ~F.col("pair") & F.col("term").isin(*terms))
    counts = entries.agg(*[F.count_if(~F.col("pair") & (F.col("term") == t)).alias(f"df{i}") for i, t in enumerate(terms)])
    worth = reduce(lambda a, b: a + b, [F.when(F.col("pair") & (F.col("term") == p), 2_000_000_000).otherwise(0) for p in pairs], F.lit(0)).cast("long")
    hits = entries.groupBy("lev_id").agg(F.count_if(~F.col("pair")).alias("__n"), F.sum(worth).alias("__bonus")).where(F.col("__n") == len(terms))
    narrow = log.where(predicate(f)).select("lev_id", "created_at", "id")
    scored = narrow.join(hits, "lev_id").crossJoin(F.broadcast(counts))  # one row
    scored = scored.withColumn("score", base_score([F.col(f"df{i}") for i in range(len(terms))]) + F.col("__bonus"))
    order = (F.desc("score"), F.desc("created_at"), F.asc("id"), F.desc("lev_id"))
    best = scored.select("lev_id", "created_at", "id", "score").orderBy(*order).limit(f.limit).select("lev_id", "score")  # at most the limit
    return visible(log.join(F.broadcast(best), "lev_id").select(*log.columns, "score").orderBy(*order))


def page_before(log: DataFrame, f: Filter, oldest: int) -> DataFrame:
    """The page after one whose oldest event has this time; events of the same second at the edge are skipped."""
    return run_filter(log.where(F.col("created_at") < oldest), f)


def latest_n(samples: DataFrame, n: int, order: str = "ts") -> DataFrame:
    """The last n samples of a history, oldest first."""
    return samples.orderBy(F.desc(order)).limit(n).orderBy(order)


def keep_latest(log: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key: the newest, of equal times the one with the smallest id."""
    order = Window.partitionBy(*keys).orderBy(F.desc("created_at"), F.asc("id"))
    return log.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")
