"""Range fingerprints and set reconciliation between two logs of (created_at, id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 16


LIMBS = 16


def _limb(i: int) -> Column:
    """The i-th little-endian 16-bit part of a 64-digit hex id."""
    at = 4 * i + 1
    return F.conv(F.concat(F.substring("id", at + 2, 2), F.substring("id", at, 2)), 16, 10).cast("long")


def limb_sums(items: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n and s0 to s15 of every group: ordinary sums of the ids' 16-bit parts, which add and subtract (exact to 2^47 rows)."""
    return items.groupBy(*keys).agg(F.count("*").alias("n"), *[F.sum(_limb(i)).alias(f"s{i}") for i in range(LIMBS)])


def _varint(n: Column) -> Column:
    """n in hex, 7 bits a byte, highest first, all but the last with the top bit."""
    one = lambda k: F.lpad(F.hex(F.pmod(F.shiftright(n, 7 * k), F.lit(128)) + (128 if k else 0)), 2, "0")
    out = F.concat(*[one(k) for k in range(8, -1, -1)])
    for size in range(8, 0, -1):
        out = F.when(n < 1 << 7 * size, F.concat(*[one(k) for k in range(size - 1, -1, -1)])).otherwise(out)
    return out


def fingerprint_of(sums: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n and fp from limb sums: the ids' sum as little-endian 256-bit numbers, with the count, hashed to 16 bytes."""
    rows, parts = sums, []
    for i in range(LIMBS):
        rows = rows.withColumn(f"s{i}", F.col(f"s{i}") + (F.shiftright(f"s{i - 1}", 16) if i else 0))
        word = F.lpad(F.hex(F.pmod(F.col(f"s{i}"), F.lit(1 << 16))), 4, "0")
        parts += [F.substring(word, 3, 2), F.substring(word, 1, 2)]
    return rows.select(*keys, "n", F.substring(F.sha2(F.unhex(F.concat(*parts, _varint(F.col("n")))), 256), 1, 32).alias("fp"))


def fingerprints(items: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n and fp of every group."""
    return fingerprint_of(limb_sums(items, keys), keys)


def split_range(items: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """items with bucket 1 to 16 in order of (created_at, id), the first ones one larger; fewer than 32 items are bucket 0, to be listed.

    Ranges are split within ``keys``. Without keys the whole set is one range: ranked() finds places without gathering it.
    """
    if keys:
        part = Window.partitionBy(*keys)
        place, total = F.row_number().over(part.orderBy("created_at", "id")), F.count("*").over(part)
        rows = items.withColumn("__place", place).withColumn("__total", total)
    else:
        rows, n = ranked(items)
        rows = rows.withColumn("__total", F.lit(n))
    small, more = F.floor(F.col("__total") / BUCKETS), F.col("__total") % BUCKETS
    edge = more * (small + 1)  # the first ``more`` buckets are one larger
    bucket = F.when(F.col("__place") <= edge, F.ceil(F.col("__place") / (small + 1))).otherwise(more + F.ceil((F.col("__place") - edge) / F.greatest(small, F.lit(1))))
    return rows.withColumn("bucket", F.when(F.col("__total") < 2 * BUCKETS, 0).otherwise(bucket).cast("int")).drop("__place", "__total")


def ranked(items: DataFrame) -> tuple[DataFrame, int]:
    """(items with __place from 1 in order of (created_at, id), their number).

    Slots of time are counted, the counts (a row for each slot) are summed in order, and items are numbered within their slot. A slot is
    a 4096th of the time covered, or a second where that is more; equal times beyond one slot's size are one task's.
    """
    span = items.agg(F.min("created_at").alias("a"), F.max("created_at").alias("b"), F.count("*").alias("n")).first()
    width = max(1, -(-((span.b or 0) - (span.a or 0) + 1) // 4096))
    slotted = items.withColumn("__slot", F.floor((F.col("created_at") - (span.a or 0)) / width))
    counts = slotted.groupBy("__slot").agg(F.count("*").alias("__n"))  # 4096 rows at the most
    before = counts.withColumn("__before", F.sum("__n").over(Window.orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1))).select("__slot", F.coalesce("__before", F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__slot").orderBy("created_at", "id"))
    rows = slotted.withColumn("__own", own).join(F.broadcast(before), "__slot")
    return rows.withColumn("__place", F.col("__before") + F.col("__own")).drop("__slot", "__own", "__before"), span.n


def range_bounds(items: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The least (created_at, id prefix) that tells each bucket's first item from the item before it, the last of the bucket before."""
    keys = keys or []
    item = F.struct("created_at", "id")
    ends = split_range(items, keys).where("bucket > 0").groupBy(*keys, "bucket").agg(F.min(item).alias("first"), F.max(item).alias("last"))
    before = ends.select(*keys, (F.col("bucket") + 1).alias("bucket"), "last.*")  # a row for each bucket
    before = before.withColumnsRenamed({"created_at": "__t", "id": "__i"})
    edges = ends.select(*keys, "bucket", "first.*").join(F.broadcast(before) if not keys else before, [*keys, "bucket"])
    same = F.aggregate(F.sequence(F.lit(1), F.lit(32)), F.lit(0), lambda a, k: F.when((a == k - 1) & (F.col("id").substr(F.lit(1), 2 * k) == F.col("__i").substr(F.lit(1), 2 * k)), k).otherwise(a))
    prefix = F.when(F.col("created_at") != F.col("__t"), F.lit("")).otherwise(F.col("id").substr(F.lit(1), 2 * F.least(same + 1, F.lit(32))))
    return edges.select(*keys, "bucket", F.col("created_at").alias("bound_at"), prefix.alias("bound_id"))


def prefix_fingerprints(items: DataFrame, keys: list[str]) -> DataFrame:
    """Limb sums of every key's items together with all smaller keys'; ``difference`` of two of them is a range's fingerprint.

    One row for each key is ordered, not the items: give keys that are ranges (of time, say), not single items.
    """
    running = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    names = ["n", *(f"s{i}" for i in range(LIMBS))]
    return limb_sums(items, keys).select(*keys, *[F.sum(c).over(running).alias(c) for c in names])


def difference(later: DataFrame, earlier: DataFrame, on: list[str]) -> DataFrame:
    """on, n and fp of what ``later`` has beyond ``earlier`` (limb sums by the same keys; none is zero): erased items and ranges' edges alike."""
    names = ["n", *(f"s{i}" for i in range(LIMBS))]
    both = later.alias("l").join(earlier.alias("e"), on, "left")
    sums = both.select(*on, *[(F.col(f"l.{c}") - F.coalesce(F.col(f"e.{c}"), F.lit(0))).alias(c) for c in names])
    return fingerprint_of(sums, on)


def applied(sums: DataFrame, inserted: DataFrame, erased: DataFrame, keys: list[str]) -> DataFrame:
    """A tree's limb sums after a batch of inserts and erasures, without reading its items again; empty groups go."""
    names = ["n", *(f"s{i}" for i in range(LIMBS))]
    less = limb_sums(erased, keys).select(*keys, *[(-F.col(c)).alias(c) for c in names])
    rows = sums.select(*keys, *names).unionByName(limb_sums(inserted, keys)).unionByName(less)
    return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in names]).where("n != 0")


def reconcile(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """id, created_at and side (have: only mine, need: only theirs) of what two sets do not share."""
    on = ["created_at", "id"]
    mine, theirs = mine.select(*on).distinct(), theirs.select(*on).distinct()
    return mine.join(theirs, on, "left_anti").withColumn("side", F.lit("have")).unionByName(theirs.join(mine, on, "left_anti").withColumn("side", F.lit("need")))


def differing_ranges(mine: DataFrame, theirs: DataFrame, seconds: int) -> DataFrame:
    """The time ranges whose fingerprints differ: only their ids need be compared."""
    slot = F.floor(F.col("created_at") / seconds).alias("slot")
    a, b = (fingerprints(x.select("id", slot), ["slot"]).select("slot", F.col("fp").alias(n)) for x, n in ((mine, "a"), (theirs, "b")))
    return a.join(b, "slot", "full").where("not (a <=> b)").select("slot")

