"""Admission of events: ordered reasons, quotas, proof of work, report queue, policy callables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.codec import cut_text, is_ephemeral, leading_zero_bits
from .state import expiration_of
from .visibility import VANISH, aimed_at, vanish_markers

REPORT, MAX_REPORT_TARGETS = 1984, 64


@dataclass(frozen=True)
class Policy:
    """Limits of admission; ``now`` is a parameter, so that a run can be repeated."""

    now: int
    newer: int = 900
    older: int = 94_608_000
    ephemeral_older: int = 60
    min_pow: int = 0
    allowed_kinds: tuple[int, ...] | None = None
    reader: str | None = None
    repost_guard: bool = True
    protected: bool = True
    relays: tuple[str, ...] | None = None


def timestamp_reason(p: Policy, created_at: Column, kind: Column, expiration: Column | None = None) -> Column:
    """Why a time is refused: too early (vanish requests never are), too late, expired; null if it is not."""
    earliest = F.when(is_ephemeral(kind), F.lit(max(0, p.now - p.ephemeral_older))).otherwise(F.lit(max(0, p.now - p.older)))
    early = (created_at < earliest) & (kind != VANISH)
    reason = F.when(early & is_ephemeral(kind), "ephemeral event expired").when(early, "created_at too early").when(created_at > p.now + p.newer, "created_at too late")
    return reason if expiration is None else reason.when(expiration <= p.now, "event expired")


def first_reason(log: DataFrame, p: Policy, banned_events: DataFrame | None = None, banned_authors: DataFrame | None = None, allowed_authors: DataFrame | None = None, vanished: DataFrame | None = None, stored: DataFrame | None = None) -> DataFrame:
    """The log with the first reason, in the fixed order of checks, why an event is refused; null where it is admitted."""
    out, flags = log, {}
    for name, table, key in (("banned event", banned_events, "id"), ("banned author", banned_authors, "pubkey"), ("allowed", allowed_authors, "pubkey"), ("duplicate", stored, "id")):
        if table is not None:
            flags[name] = f"__{len(flags)}"
            out = out.join(table.select(key).distinct().withColumn(flags[name], F.lit(True)), key, "left")
    if vanished is not None:
        out = out.join(vanished.groupBy("pubkey").agg(F.max("vanished_at").alias("__v")), "pubkey", "left")
    has = lambda name: F.coalesce(F.col(flags[name]), F.lit(False)) if name in flags else F.lit(False)
    reason = timestamp_reason(p, F.col("created_at"), F.col("kind"), expiration_of())
    if p.allowed_kinds is not None:
        reason = reason.when(~F.col("kind").isin(*p.allowed_kinds) if p.allowed_kinds else F.lit(True), "kind not allowed")
    reason = reason.when(has("banned event"), "event banned").when(has("banned author"), "author banned")
    if allowed_authors is not None:
        reason = reason.when(~has("allowed"), "author not allowed")
    if vanished is not None:
        reason = reason.when((F.col("created_at") <= F.col("__v")) & (F.col("kind") != VANISH), "author vanished")
    if p.relays is not None:
        reason = reason.when((F.col("kind") == VANISH) & ~aimed_at(p.relays), "vanish request for another relay")
    if p.min_pow:
        reason = reason.when(leading_zero_bits(F.col("id")) < p.min_pow, "not enough work")
    if p.repost_guard:
        reason = reason.when(F.col("kind").isin(6, 16) & F.contains("content", F.lit('["-"]')), "repost of a protected event")
    if p.protected:
        mine = F.lit(False) if p.reader is None else F.col("pubkey") == p.reader
        reason = reason.when(F.exists("tags", lambda t: F.get(t, F.lit(0)) == "-") & ~mine, "protected event")
    reason = reason.when(has("duplicate"), "duplicate")
    return out.withColumn("reason", reason).select(*log.columns, "reason")


def reason_counts(judged: DataFrame) -> DataFrame:
    return judged.groupBy(F.coalesce("reason", F.lit("admitted")).alias("reason")).agg(F.count("*").alias("n"))


def within_author_quota(log: DataFrame, quota: int, stored: DataFrame | None = None) -> DataFrame:
    """Events in order of arrival until each author, with what is stored, has ``quota``."""
    place = F.row_number().over(Window.partitionBy("pubkey").orderBy("lev_id"))
    out = log.withColumn("__n", place)
    if stored is not None:
        out = out.join(stored.groupBy("pubkey").agg(F.count("*").alias("__s")), "pubkey", "left").withColumn("__n", F.col("__n") + F.coalesce("__s", F.lit(0)))
    return out.where(F.col("__n") <= quota).select(*log.columns)


def batches_within_quota(log: DataFrame, quota: int, batch: int, stored: int = 0) -> DataFrame:
    """batch_no, n, accepted: batches of ``batch`` arrivals; one that would go beyond the global quota is refused whole and does not count."""
    sizes = log.groupBy(F.floor((F.col("lev_id")) / batch).cast("long").alias("batch_no")).agg(F.count("*").alias("n"))

    def accept(batches):
        total = stored
        for pdf in batches:
            said = []
            for n in pdf["n"]:
                said.append(total + n <= quota)
                total += n * said[-1]
            yield pdf.assign(accepted=said)

    # What a batch may do depends on all before it: one task reads a row for each batch, in order, and holds one number.
    return sizes.repartition(1).sortWithinPartitions("batch_no").mapInPandas(accept, "batch_no bigint, n bigint, accepted boolean")


def pow_bits(log: DataFrame) -> DataFrame:
    return log.select("lev_id", leading_zero_bits(F.col("id")).cast("int").alias("bits"))


def report_queue(log: DataFrame, most: int = MAX_REPORT_TARGETS) -> DataFrame:
    """target, reporter, reason: of every reported event the latest report; a report counts its first ``most`` e tags."""
    targets = F.slice(F.filter("idx_tags", lambda t: t["name"] == "e"), 1, most)
    rows = log.where(F.col("kind") == REPORT).select("lev_id", "pubkey", cut_text(F.col("content")).alias("reason"), F.posexplode(targets).alias("pos", "t"))
    last = F.max_by(F.struct("pubkey", "reason"), F.struct("lev_id", "pos")).alias("x")
    return rows.groupBy(F.col("t.value").alias("target")).agg(last).select("target", F.col("x.pubkey").alias("reporter"), "x.reason")


ACCEPT, REJECT, SHADOW = "accept", "reject", "shadowReject"
#: What a sender is told of each outcome: whether it counts as accepted, and the message.
MESSAGES = {"written": (True, ""), "duplicate": (True, "duplicate: have this event"), "replaced": (True, "replaced: have newer event"), "deleted": (False, "blocked: event deleted"), ACCEPT: (True, ""), REJECT: (False, "blocked"), SHADOW: (True, "")}


def answers(outcomes: DataFrame, column: str = "status") -> DataFrame:
    """``outcomes`` with ok and message; an outcome without a message of its own is not accepted."""
    said = F.create_map(*[F.lit(x) for k, (ok, text) in MESSAGES.items() for x in (k, f"{int(ok)}{text}")])
    one = F.coalesce(F.try_element_at(said, F.col(column)), F.lit("0"))
    return outcomes.withColumn("ok", F.substring(one, 1, 1) == "1").withColumn("message", F.substring(one, 2, 200))


def apply_policy(log: DataFrame, policy: Callable[[dict], str]) -> DataFrame:
    """The log with action: a callable's verdict on every event; an error or an unknown verdict rejects. Shadow-rejected events answer OK but are not stored."""

    def judge(batches):
        for batch in batches:
            verdicts = []
            for row in batch.select(columns).to_pylist():
                try:
                    said = policy(row)
                except Exception:  # a failing policy must not admit anything
                    said = REJECT
                verdicts.append(said if said in (ACCEPT, REJECT, SHADOW) else REJECT)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(verdicts, pa.string())], names)

    names = [*log.columns, "action"]
    columns = [c for c in ("lev_id", "created_at", "pubkey", "id", "kind", "content") if c in names]
    return log.mapInArrow(judge, T.StructType([*log.schema.fields, T.StructField("action", T.StringType())]))


def fold_control(control: DataFrame) -> DataFrame:
    """The moderation state that a control log (seq, method, subject, reason) leaves: the last word on each subject.

    ban and allow of a thing replace each other; an un-method clears it; a judged event's report is cleared.
    """
    thing = F.regexp_extract("method", "(pubkey|event|ip|kind|role)$", 1)
    verb = F.regexp_replace("method", "(pubkey|event|ip|kind|role)$", "")
    last = control.groupBy(thing.alias("thing"), "subject").agg(F.max_by(F.struct(verb.alias("verb"), "reason"), "seq").alias("x"))
    return last.where(~F.col("x.verb").isin("unban", "unallow", "unblock", "disallow", "delete")).select("thing", "subject", F.col("x.verb").alias("state"), F.col("x.reason").alias("reason"))


def write_permitted(authors: DataFrame, state: DataFrame, roles: DataFrame, allow_list_only: bool = False) -> DataFrame:
    """pubkey, permitted: a ban wins; then, with an allow-list in force, being on it or having any role."""
    of = lambda s: state.where((F.col("thing") == "pubkey") & (F.col("state") == s)).select(F.col("subject").alias("pubkey"), F.lit(True).alias(f"__{s}"))
    out = authors.join(of("ban"), "pubkey", "left").join(of("allow"), "pubkey", "left").join(roles.select("pubkey").distinct().withColumn("__role", F.lit(True)), "pubkey", "left")
    allowed = F.coalesce("__allow", F.lit(False)) | F.coalesce("__role", F.lit(False)) | F.lit(not allow_list_only)
    return out.select("pubkey", (~F.coalesce("__ban", F.lit(False)) & allowed).alias("permitted"))


# -- management -------------------------------------------------------------------------------------------------------

#: Bounds of the moderation state, and the roles that have a meaning of their own.
MAX_RECORDS, MAX_ROLES, MAX_ROLES_OF_AUTHOR, MAX_REASON_BYTES = 100_000, 1_000, 64, 512
ADMIN, MODERATOR = "admin", "moderator"


def fold_roles(control: DataFrame) -> DataFrame:
    """pubkey, role: the assignments that a control log (seq, method, subject, role) leaves.

    putrole and deleterole act on ``role`` alone, assignrole and unassignrole on subject and role. Deleting a role strips it from all
    who have it; assigning a role that does not exist at the time does nothing, built-in roles always exist. An author keeps the
    first 64 of the roles in force.
    """
    of = lambda *methods: control.where(F.col("method").isin(*methods))
    last = of("assignrole", "unassignrole").groupBy(F.col("subject").alias("pubkey"), "role").agg(F.max(F.struct("seq", "method")).alias("x")).where("x.method = 'assignrole'").select("pubkey", "role", F.col("x.seq").alias("seq"))
    # Of a role's rows only two matter: its last deletion, which strips all assignments before it, and the first row that makes it anew.
    deleted = of("deleterole").groupBy("role").agg(F.max("seq").alias("__deleted"))
    made = of("putrole").join(deleted, "role", "left").where(F.col("__deleted").isNull() | (F.col("seq") > F.col("__deleted"))).groupBy("role").agg(F.min("seq").alias("__made"))
    seen = last.join(deleted, "role", "left").join(made, "role", "left")
    exists = F.col("role").isin(ADMIN, MODERATOR, "member") | F.coalesce(F.col("__made") < F.col("seq"), F.lit(False))
    stripped = F.coalesce(F.col("__deleted") > F.col("seq"), F.lit(False))
    place = F.row_number().over(Window.partitionBy("pubkey").orderBy("seq", "role"))
    return seen.where(exists & ~stripped).withColumn("__n", place).where(F.col("__n") <= MAX_ROLES_OF_AUTHOR).select("pubkey", "role")


def management_levels(authors: DataFrame, roles: DataFrame, operators: tuple[str, ...] = ()) -> DataFrame:
    """pubkey, level: admin for operators and the admin role, then moderator, else none."""
    own = roles.groupBy("pubkey").agg(F.max(F.when(F.col("role") == ADMIN, 2).when(F.col("role") == MODERATOR, 1).otherwise(0)).alias("__l"))
    level = F.when(F.col("pubkey").isin(*operators) | (F.col("__l") == 2), ADMIN).when(F.col("__l") == 1, MODERATOR).otherwise("none")
    return authors.join(own, "pubkey", "left").select("pubkey", level.alias("level"))


def accepted_control(control: DataFrame) -> DataFrame:
    """The control rows within bounds: reasons of at most 512 bytes, and of each kind of record the first 100,000 subjects (1,000 roles).

    A role is counted by its name, whoever makes it and however often.
    """
    rows = control.where(F.coalesce(F.octet_length("reason"), F.lit(0)) <= MAX_REASON_BYTES)
    adds = F.col("method").rlike("^(ban|allow|block|put)")
    # What a row is about: putrole acts on its role, all other methods on their subject.
    thing = F.when(F.col("method") == "putrole", F.col("role")).otherwise(F.col("subject")) if "role" in control.columns else F.col("subject")
    first = rows.where(adds).groupBy("method", thing.alias("__thing")).agg(F.min("seq").alias("__first"))
    most = F.when(F.col("method") == "putrole", MAX_ROLES).otherwise(MAX_RECORDS)
    # Places are taken within a method; a method's subjects beyond its bound are what is refused.
    late = first.withColumn("__n", F.row_number().over(Window.partitionBy("method").orderBy("__first"))).where(F.col("__n") > most).select("method", "__thing")
    return rows.withColumn("__thing", thing).join(late, ["method", "__thing"], "left_anti").select(*control.columns)


def open_reports(reports: DataFrame, state: DataFrame) -> DataFrame:
    """The report queue (target, ...) without the events that were banned or allowed: they are judged."""
    judged = state.where((F.col("thing") == "event") & F.col("state").isin("ban", "allow")).select(F.col("subject").alias("target"))
    return reports.join(judged, "target", "left_anti")


def judge_batch(batch: DataFrame, p: Policy, control: DataFrame, vanished: DataFrame | None = None, stored: DataFrame | None = None) -> DataFrame:
    """A writer's batch with the first reason why an event is refused.

    Management rows that arrived with the batch count before any of its events, and so do the batch's own vanish requests, wherever
    they stand in it: an earlier event of the same author is refused too.
    """
    state = fold_control(control)
    banned = lambda thing, name: state.where((F.col("thing") == thing) & (F.col("state") == "ban")).select(F.col("subject").alias(name))
    own = vanish_markers(batch, list(p.relays or ()))
    markers = own if vanished is None else own.unionByName(vanished.select("pubkey", "vanished_at"))
    return first_reason(batch, p, banned("event", "id"), banned("pubkey", "pubkey"), vanished=markers, stored=stored)
