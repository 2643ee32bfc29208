"""What readers may see: moderation, vanished authors and recipients, restricted kinds.

Moderation lists and vanish markers are anti-joined on their key; Spark broadcasts them while they are small and
shuffles them otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codec import relay_name, relay_url

GIFT_WRAPS = (1059, 21059)
VANISH = 62


def without_banned(log: DataFrame, banned_events: DataFrame | None = None, banned_authors: DataFrame | None = None, allowed_kinds: list[int] | None = None) -> DataFrame:
    """Banned ids, then banned authors, then kinds outside the policy go; no policy allows all, an empty one none."""
    out = log
    if banned_events is not None:
        out = out.join(banned_events.select("id").distinct(), "id", "left_anti")
    if banned_authors is not None:
        out = out.join(banned_authors.select("pubkey").distinct(), "pubkey", "left_anti")
    if allowed_kinds is not None:
        out = out.where(F.col("kind").isin(*allowed_kinds) if allowed_kinds else F.lit(False))
    return out.select(*log.columns)


def moderation_reason(log: DataFrame, banned_events: DataFrame, banned_authors: DataFrame, allowed_kinds: list[int] | None = None) -> DataFrame:
    """The log with the first reason why an event is hidden, null where it is visible."""
    flagged = log.join(banned_events.select("id").distinct().withColumn("__e", F.lit(True)), "id", "left").join(banned_authors.select("pubkey").distinct().withColumn("__a", F.lit(True)), "pubkey", "left")
    kind_ok = F.lit(True) if allowed_kinds is None else (F.col("kind").isin(*allowed_kinds) if allowed_kinds else F.lit(False))
    return flagged.withColumn("reason", F.when(F.col("__e"), "event banned").when(F.col("__a"), "author banned").when(~kind_ok, "kind not allowed")).drop("__e", "__a")


def aimed_at(relays) -> Column:
    """Whether a vanish request names one of these relays, or all."""
    names = {relay_name(x) for x in relays} - {""}
    return F.exists("tags", lambda t: (F.get(t, F.lit(0)) == "relay") & ((F.get(t, F.lit(1)) == "ALL_RELAYS") | relay_url(F.get(t, F.lit(1))).isin(*names)))


def vanish_markers(log: DataFrame, targets: list[str]) -> DataFrame:
    """pubkey, vanished_at: the latest vanish request of each author that names one of these relays, or all."""
    return log.where((F.col("kind") == VANISH) & aimed_at(targets)).groupBy("pubkey").agg(F.max("created_at").alias("vanished_at"))


def without_vanished(log: DataFrame, markers: DataFrame) -> DataFrame:
    """Events of vanished authors up to their time go (vanish requests stay); gift wraps to vanished recipients go, whatever their time."""
    own = markers.select(F.col("pubkey").alias("__p"), "vanished_at")
    out = log.join(own, (F.col("pubkey") == F.col("__p")) & (F.col("created_at") <= F.col("vanished_at")) & (F.col("kind") != VANISH), "left_anti")
    wraps = log.where(F.col("kind").isin(*GIFT_WRAPS)).select("lev_id", F.explode("idx_tags").alias("t")).where("t.name = 'p'")
    hidden = wraps.join(own, F.col("t.value") == F.col("__p"), "left_semi").select("lev_id").distinct()
    return out.join(hidden, "lev_id", "left_anti").select(*log.columns)


def for_reader(log: DataFrame, restricted_kinds: list[int], reader: str | None) -> DataFrame:
    """Restricted kinds only go to their author and first recipient, and only where there is a recipient."""
    recipient = F.get(F.filter("idx_tags", lambda t: t["name"] == "p"), F.lit(0))["value"]
    mine = F.lit(False) if reader is None else recipient.isNotNull() & ((recipient == reader) | (F.col("pubkey") == reader))
    return log.where(~F.col("kind").isin(*restricted_kinds) | mine) if restricted_kinds else log
