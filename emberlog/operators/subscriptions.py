"""Standing queries: subscriptions as rows, events met by equi-joins on the condition that is rarest, the rest checked after.

A subscription's filter is found by its ids, else its authors, else its tags, else its kinds; filters without any of these meet every
event. Conditions are data, so one plan serves any number of subscriptions.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import live_terms
from ..plans.filters import Filter, check_subscription_id

SCHEMA = (
    "conn bigint, sub string, filter_idx int, mark bigint, ids array<string>, authors array<string>, kinds array<int>, "
    "any_tags array<struct<name:string,values:array<string>>>, all_tags array<struct<name:string,values:array<string>>>, terms array<string>, since bigint, until bigint, "
    "how string, keys array<string>"
)


@dataclass(frozen=True)
class Subscription:
    conn: int
    sub: str
    filters: tuple[Filter, ...]
    mark: int = 0


def lookup_of(f: Filter) -> tuple[str, list[str]]:
    """How a filter is found: the kind of key, and the keys."""
    if f.ids is not None:
        return "id", list(f.ids)
    if f.authors is not None:
        return "author", list(f.authors)
    if f.all_tags:
        name = min(f.all_tags)  # every value is required, so one of them finds the filter
        return "tag", [f"{name}={f.all_tags[name][0]}"]
    if f.any_tags:
        name = min(f.any_tags, key=lambda k: len(f.any_tags[k]))
        return "tag", [f"{name}={v}" for v in f.any_tags[name]]
    if f.kinds is not None:
        return "kind", [str(k) for k in f.kinds]
    return "any", ["*"]


def subscription_table(spark: SparkSession, subscriptions: list[Subscription]) -> DataFrame:
    rows = []
    for s in subscriptions:
        check_subscription_id(s.sub)
        for i, f in enumerate(s.filters):
            how, keys = lookup_of(f)
            tags = [[(k, list(v)) for k, v in t.items()] for t in (f.any_tags, f.all_tags)]
            rows.append((s.conn, s.sub, i, s.mark, f.ids, f.authors, f.kinds, *tags, f.search.terms if f.search else None, min(f.since, (1 << 63) - 1), min(f.until, (1 << 63) - 1), how, keys))
    return spark.createDataFrame(rows, SCHEMA)


def _holds() -> Column:
    """The whole filter, from the subscription's columns; a null set does not restrict."""
    has = lambda values, x: F.col(values).isNull() | F.array_contains(values, x)
    value_in = lambda t, v: (t["name"] == v["name"]) & F.array_contains(v["values"], t["value"])
    any_tags = F.forall("any_tags", lambda v: F.exists("idx_tags", lambda t: value_in(t, v)))
    all_tags = F.forall("all_tags", lambda v: F.forall(v["values"], lambda x: F.exists("idx_tags", lambda t: (t["name"] == v["name"]) & (t["value"] == x))))
    search = F.col("sub_terms").isNull() | (F.size(F.array_except("sub_terms", "terms")) == 0)
    parts = [has("ids", F.col("id")), has("authors", F.col("pubkey")), has("kinds", F.col("kind")), F.col("created_at").between(F.col("since"), F.col("until")), any_tags, all_tags, search]
    return reduce(lambda a, b: a & b, parts)


def match(log: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """conn, sub, lev_id: the events above each subscription's mark that any of its filters matches, once each.

    Works on batch and on streaming logs (then without the final distinct: the stream's sink drops repeats by key).
    """
    subs = subscriptions.withColumnRenamed("terms", "sub_terms").withColumn("key", F.explode("keys")).drop("keys")
    events = log.withColumn("terms", live_terms(F.col("content")))
    tag_keys = F.transform("idx_tags", lambda t: F.concat(t["name"], F.lit("="), t["value"]))
    keys = F.concat(
        F.array(F.struct(F.lit("id").alias("how"), F.col("id").alias("key")), F.struct(F.lit("author").alias("how"), F.col("pubkey").alias("key")), F.struct(F.lit("kind").alias("how"), F.col("kind").cast("string").alias("key")), F.struct(F.lit("any").alias("how"), F.lit("*").alias("key"))),
        F.transform(tag_keys, lambda k: F.struct(F.lit("tag").alias("how"), k.alias("key"))),
    )
    met = events.withColumn("__k", F.explode(keys)).select("*", "__k.how", "__k.key").drop("__k").join(subs, ["how", "key"])
    found = met.where((F.col("lev_id") > F.col("mark")) & _holds()).select("conn", "sub", "lev_id")
    return found if log.isStreaming else found.distinct()


def advanced_marks(matches: DataFrame) -> DataFrame:
    """The new mark of every subscription that got something."""
    return matches.groupBy("conn", "sub").agg(F.max("lev_id").alias("mark"))


def router(log: DataFrame, groups: dict[str, list[Filter]]) -> DataFrame:
    """router_group, lev_id: the events each group of filters passes on; search filters pass nothing there."""
    from ..plans.filters import group_predicate

    names = F.array_compact(F.array(*[F.when(group_predicate(fs), F.lit(g)) for g, fs in groups.items()]))
    return log.select("lev_id", F.explode(names).alias("router_group")).select("router_group", "lev_id")


def tree_counts(log: DataFrame, trees: dict[str, list[Filter]]) -> DataFrame:
    """tree, n and fp: each named filter's size and fingerprint."""
    from .sketch import fingerprints

    routed = router(log, trees)
    return fingerprints(routed.join(log.select("lev_id", "id"), "lev_id").withColumnRenamed("router_group", "tree"), ["tree"])
