"""Which events exist: duplicates, replacement, deletion, expiry, vanishing, and the exact replay of a log.

The set forms (latest_state and the tombstone joins) equal the replay where no deletion hits the newest version of a key;
replay() is the defined result: events in order of (created_at, id), each seeing what earlier ones left, nothing coming back.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codec import address_parts, is_addressable, is_replaceable
from .visibility import GIFT_WRAPS, VANISH, aimed_at

DELETE = 5


def first_d(tags: str = "idx_tags") -> Column:
    """The identifier of an event's key: empty for replaceable kinds, else the first d, else empty."""
    d = F.coalesce(F.get(F.filter(tags, lambda t: t["name"] == "d"), F.lit(0))["value"], F.lit(""))
    return F.when(is_replaceable(F.col("kind")), F.lit("")).otherwise(d)


def dedup_ids(log: DataFrame) -> DataFrame:
    """The first arrival of every id."""
    return log.withColumn("__n", F.row_number().over(Window.partitionBy("id").orderBy("lev_id"))).where("__n = 1").drop("__n")


def latest_state(log: DataFrame) -> DataFrame:
    """Replaceable and addressable events: the newest of each (pubkey, kind, d), ties to the smallest id; all others stay."""
    keyed = is_replaceable(F.col("kind")) | is_addressable(F.col("kind"))
    order = Window.partitionBy("pubkey", "kind", first_d()).orderBy(F.desc("created_at"), F.asc("id"))
    newest = log.where(keyed).withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")
    return log.where(~keyed).unionByName(newest)


def tombstones(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, pubkey) of e targets, and (kind, pubkey, d, deleted_at) of own addressable a targets with the newest deletion."""
    tags = log.where(F.col("kind") == DELETE).select("pubkey", "created_at", F.explode("idx_tags").alias("t"))
    ids = tags.where("t.name = 'e'").select(F.col("t.value").alias("id"), "pubkey").distinct()
    kind, author, d = address_parts(F.col("t.value"))
    found = tags.where("t.name = 'a'").select("pubkey", "created_at", kind.cast("int").alias("kind"), author.alias("author"), d.alias("d"))
    own = found.where((F.col("author") == F.col("pubkey")) & is_addressable(F.col("kind")))
    return ids, own.groupBy("kind", "pubkey", "d").agg(F.max("created_at").alias("deleted_at"))


def without_deleted(log: DataFrame) -> DataFrame:
    """The log without deletions' targets: by id and author (or gift wrap and recipient), whatever their order; by address up to the deletion's time."""
    ids, addresses = tombstones(log)
    out = log.join(ids.select("id", "pubkey", F.lit(True).alias("__t")), ["id", "pubkey"], "left").where(F.col("__t").isNull() | (F.col("kind") == VANISH)).drop("__t")
    wraps = log.where(F.col("kind").isin(*GIFT_WRAPS)).select("lev_id", "id", F.explode("idx_tags").alias("t")).where("t.name = 'p'").select("lev_id", "id", F.col("t.value").alias("pubkey"))
    out = out.join(wraps.join(ids, ["id", "pubkey"], "left_semi").select("lev_id").distinct(), "lev_id", "left_anti")
    out = out.withColumn("d", first_d())
    covered = (F.col("kind") == F.col("__k")) & (F.col("pubkey") == F.col("__p")) & (F.col("d") == F.col("__d")) & (F.col("created_at") <= F.col("deleted_at"))
    marks = addresses.select(F.col("kind").alias("__k"), F.col("pubkey").alias("__p"), F.col("d").alias("__d"), "deleted_at")
    return out.join(marks, covered, "left_anti").select(*log.columns)


def without_expired(log: DataFrame, expiration: Column, now: int) -> DataFrame:
    """What the sweep leaves; the newest arrival always stays. Reads never apply this by themselves."""
    last = log.agg(F.max("lev_id").alias("__last"))
    out = log.withColumn("__x", F.coalesce(expiration <= now, F.lit(False))).crossJoin(F.broadcast(last))
    return out.where(~F.col("__x") | (F.col("lev_id") == F.col("__last"))).drop("__x", "__last")


def expiration_of(tags: str = "tags") -> Column:
    """Seconds of the first expiration tag if it is digits and at least 100, else null."""
    first = F.get(F.get(F.filter(tags, lambda t: F.get(t, F.lit(0)) == "expiration"), F.lit(0)), F.lit(1))
    value = F.when(first.rlike("^[0-9]{1,18}$"), first.try_cast("bigint"))
    return F.when(value >= 100, value)


# -- exact replay -----------------------------------------------------------------------------------------------------


def replay_rows(rows: list[dict], relays: tuple[str, ...] = ()) -> list[str]:
    """Status of each event (written, duplicate, replaced, deleted) by the sequential rules; rows come in order.

    An event that a later one removed has status removed.
    """
    from ..functions.codec import CodecError, parse_address, relay_name

    relays = {relay_name(r) for r in relays} - {""}
    live: dict[str, int] = {}
    by_key: dict[tuple, str] = {}
    seen_tombs: dict[tuple, set[int]] = {}
    address_tombs: dict[tuple, dict[int, int]] = {}
    vanished: dict[str, int] = {}
    status = [""] * len(rows)

    def d_of(e):
        return "" if e["kind"] in (0, 3, 41) or 10000 <= e["kind"] < 20000 else next((t[1] for t in e["tags"] if len(t) > 1 and t[0] == "d"), "")

    def recipients(e):
        return [t[1] for t in e["tags"] if len(t) > 1 and t[0] == "p"] if e["kind"] in GIFT_WRAPS else []

    def remove(i):
        e = rows[i]
        status[i] = "removed"
        live.pop(e["id"], None)
        key = (e["pubkey"], e["kind"], d_of(e))
        if by_key.get(key) == e["id"]:
            del by_key[key]
        for tombs in (seen_tombs, address_tombs):
            for held in tombs.values():
                held.discard(i) if isinstance(held, set) else held.pop(i, None)

    for i, e in enumerate(rows):
        author, kind, at = e["pubkey"], e["kind"], e["created_at"]
        if e["id"] in live:
            status[i] = "duplicate"
            continue
        if kind == VANISH and not any(t[0] == "relay" and len(t) > 1 and (t[1] == "ALL_RELAYS" or relay_name(t[1]) in relays) for t in e["tags"]):
            status[i] = "deleted"
            continue
        if kind != VANISH and (at <= vanished.get(author, -1) or any(p in vanished for p in recipients(e))):
            status[i] = "deleted"
            continue
        if kind != VANISH and any(seen_tombs.get((e["id"], p)) for p in (author, *recipients(e))):
            status[i] = "deleted"
            continue
        keyed = kind in (0, 3, 41) or 10000 <= kind < 20000 or 30000 <= kind < 40000
        key, holder = (author, kind, d_of(e)), None
        if keyed and (other := by_key.get(key)) is not None:
            old = rows[live[other]]
            if (old["created_at"], [-ord(c) for c in old["id"]]) > (at, [-ord(c) for c in e["id"]]):
                status[i] = "replaced"
                continue
            holder = live[other]
        if 30000 <= kind < 40000 and max(address_tombs.get((kind, author, d_of(e)), {}).values(), default=-1) >= at:
            status[i] = "deleted"
            continue
        gone = [] if holder is None else [holder]
        if kind == DELETE:
            for t in e["tags"]:
                if len(t) < 2:
                    continue
                if t[0] == "e":
                    if t[1] in live:
                        target = rows[live[t[1]]]
                        if target["kind"] != VANISH and (target["pubkey"] == author or author in recipients(target)):
                            gone.append(live[t[1]])
                    seen_tombs.setdefault((t[1], author), set()).add(i)
                elif t[0] == "a":
                    try:
                        k, p, d = parse_address(t[1])
                    except CodecError:
                        continue
                    if p == author and 30000 <= k < 40000:
                        other = by_key.get((p, k, d))
                        if other is not None and rows[live[other]]["created_at"] <= at:
                            gone.append(live[other])
                        address_tombs.setdefault((k, p, d), {})[i] = at
        if kind == VANISH:
            vanished[author] = max(vanished.get(author, -1), at)
        live[e["id"]] = i
        status[i] = "written"
        if keyed:
            by_key[key] = e["id"]
        for g in dict.fromkeys(gone):
            if status[g] == "written" and g != i:
                remove(g)
                if keyed:
                    by_key[key] = e["id"]
    return status


def replay(log: DataFrame, relays: tuple[str, ...] = ()) -> DataFrame:
    """lev_id and status of every event after replay in order of (created_at, id), author by author.

    Deletions, replacements and vanish requests act on their author's own events, so authors are independent groups; gift wraps
    are decided after that by joins on their recipients' deletions and vanish requests. An author's whole history is one
    task's group.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["created_at", "id", "lev_id"], kind="stable")
        rows = [{"id": r.id, "pubkey": r.pubkey, "kind": r.kind, "created_at": r.created_at, "tags": [list(t) for t in r.tags]} for r in pdf.itertuples()]
        return pd.DataFrame({"lev_id": pdf["lev_id"].to_numpy(), "status": replay_rows(rows, relays)})

    own = log.select("lev_id", "id", "pubkey", "kind", "created_at", "tags").groupBy("pubkey").applyInPandas(one, "lev_id bigint, status string")
    wraps = log.where(F.col("kind").isin(*GIFT_WRAPS)).select("lev_id", "id", F.explode("idx_tags").alias("t")).where("t.name = 'p'").select("lev_id", "id", F.col("t.value").alias("pubkey"))
    ids, _ = tombstones(log.join(own.where("status = 'written'"), "lev_id", "left_semi"))
    gone = wraps.join(ids, ["id", "pubkey"], "left_semi").select("lev_id").union(wraps.join(log.where((F.col("kind") == VANISH) & aimed_at(relays)).select("pubkey"), "pubkey", "left_semi").select("lev_id")).distinct()
    return own.join(gone.withColumn("__g", F.lit(True)), "lev_id", "left").select("lev_id", F.when(F.col("__g") & (F.col("status") == "written"), "removed").otherwise(F.col("status")).alias("status"))


def status_counts(statuses: DataFrame) -> DataFrame:
    return statuses.groupBy("status").agg(F.count("*").alias("n"))
