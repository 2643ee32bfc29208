"""The filter language: parsing, limits, cost, and compilation to Column predicates.

A filter is a JSON object of optional conditions that must all hold; a group is a list of filters of which one must. Everything here
runs on the driver over the filter's text; data is only touched by the predicates it returns.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.codec import CodecError, from_lower_hex, parse_address, parse_strict
from ..functions.terms import SearchQuery, all_terms, indexed_terms, parse_search

NO_UNTIL = (1 << 64) - 1
MAX_LIMIT, MAX_COUNT_LIMIT, MAX_TAGS, MAX_AND, MAX_SET_BYTES, MAX_VALUE_BYTES = 500, 1_000_001, 3, 16, 65_535, 255


class FilterError(ValueError):
    """A filter that is refused; the message says why."""


@dataclass(frozen=True)
class Filter:
    ids: tuple[str, ...] | None = None
    authors: tuple[str, ...] | None = None
    kinds: tuple[int, ...] | None = None
    any_tags: dict[str, tuple[str, ...]] = field(default_factory=dict)
    all_tags: dict[str, tuple[str, ...]] = field(default_factory=dict)
    search: SearchQuery | None = None
    since: int = 0
    until: int = NO_UNTIL
    limit: int = MAX_LIMIT

    @property
    def is_full_scan(self) -> bool:
        return not (self.ids or self.authors or self.kinds or self.any_tags or self.all_tags or self.search)

    @property
    def is_index_only(self) -> bool:
        """Whether one index of the event log answers it: one condition at most, or author and kind."""
        parts = sum(x is not None for x in (self.ids, self.authors, self.kinds, self.search)) + len(self.any_tags)
        return not self.all_tags and (parts <= 1 or (parts == 2 and self.authors is not None and self.kinds is not None))


def _unsigned(value, what: str, most: int = NO_UNTIL) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or not 0 <= value <= most:
        raise FilterError(f"{what} is not an unsigned integer up to {most}")
    return value


def _items(value, what: str) -> list:
    if not isinstance(value, list):
        raise FilterError(f"{what} is not a list")
    if not value:
        raise FilterError(f"{what} has no items")
    return value


def _texts(value, what: str, identifiers: bool) -> tuple[str, ...]:
    """A set of strings: sorted by bytes, without repeats, of bounded size; identifiers are 64 lower-case hex digits."""
    items = _items(value, what)
    if not all(isinstance(x, str) for x in items):
        raise FilterError(f"{what} holds something other than text")
    try:
        sizes = {x: len(from_lower_hex(x)) if identifiers else len(x.encode()) for x in items}
    except CodecError as e:
        raise FilterError(f"{what}: {e}") from None
    if any(n != 32 if identifiers else n > MAX_VALUE_BYTES for n in sizes.values()):
        raise FilterError(f"{what} item has a wrong size")
    if sum(sizes.values()) > MAX_SET_BYTES:
        raise FilterError(f"{what} holds more than {MAX_SET_BYTES} bytes")
    return tuple(sorted(sizes, key=str.encode))


def parse_filter(source: str | dict, max_limit: int = MAX_LIMIT, max_tags: int = MAX_TAGS, max_and: int = MAX_AND) -> Filter:
    """A filter from its JSON; values that ``&x`` requires are taken out of ``#x``, which goes when nothing is left."""
    given = source
    if isinstance(source, str):
        try:
            given = parse_strict(source)
        except CodecError as e:
            raise FilterError(str(e)) from None
    if not isinstance(given, dict):
        raise FilterError("not an object")
    found: dict = {"any_tags": {}, "all_tags": {}, "limit": max_limit}
    for key, value in given.items():
        if key in ("ids", "authors"):
            found[key] = _texts(value, key, True)
        elif key == "kinds":
            found[key] = tuple(sorted({_unsigned(k, "kind", 65535) for k in _items(value, key)}))
        elif key[:1] in ("#", "&"):
            _items(value, key)
            if not re.fullmatch("[A-Za-z]", key[1:]):
                raise FilterError(f"{key} does not name a one-letter tag")
            found["any_tags" if key[0] == "#" else "all_tags"][key[1]] = _texts(value, key, key[1] in "ep")
        elif key in ("since", "until"):
            found[key] = _unsigned(value, key)
        elif key == "limit":
            found[key] = min(_unsigned(value, key), max_limit)
        elif key == "search":
            if not isinstance(value, str):
                raise FilterError("search not a string")
            try:
                found[key] = parse_search(value)
            except ValueError as e:
                raise FilterError(f"search: {e}") from None
        else:
            raise FilterError(f"no condition is named {key}")
    left = {k: tuple(v for v in vs if v not in found["all_tags"].get(k, ())) for k, vs in found["any_tags"].items()}
    found["any_tags"] = {k: vs for k, vs in left.items() if vs}
    if len({*found["any_tags"], *found["all_tags"]}) > max_tags:
        raise FilterError(f"more than {max_tags} tag names")
    if sum(map(len, found["all_tags"].values())) > max_and:
        raise FilterError(f"more than {max_and} required tag values")
    return Filter(**found)


def parse_group(source: str | dict | list, **limits) -> list[Filter]:
    given = parse_strict(source) if isinstance(source, str) else source
    return [parse_filter(f, **limits) for f in (given if isinstance(given, list) else [given])]


def for_count(filters: list[Filter], sources: list[dict], max_count: int) -> list[Filter]:
    """The filters of a COUNT: one without a limit of its own stops just beyond the cap."""
    return [f if "limit" in s else replace(f, limit=max_count + 1) for f, s in zip(filters, sources, strict=True)]


def _has_tag(name: str, values: tuple[str, ...]) -> Column:
    return F.exists("idx_tags", lambda t: (t["name"] == name) & t["value"].isin(*values))


def predicate(f: Filter, live: bool = False) -> Column:
    """Everything but search as a predicate over id, pubkey, kind, created_at and idx_tags, pushed down where Parquet can.

    ``live``: also the search, as standing queries match it: every term among the event's terms (column terms), in any order.
    """
    parts = []
    for column, values in (("id", f.ids), ("pubkey", f.authors), ("kind", f.kinds)):
        if values is not None:
            parts.append(F.col(column).isin(*values))
    if f.since:
        parts.append(F.col("created_at") >= F.lit(f.since) if f.since < 1 << 63 else F.lit(False))
    if f.until < (1 << 63) - 1:
        parts.append(F.col("created_at") <= F.lit(f.until))
    parts += [_has_tag(name, values) for name, values in f.any_tags.items()]
    parts += [_has_tag(name, (value,)) for name, values in f.all_tags.items() for value in values]
    if live and f.search:
        parts.append(F.size(F.array_except(F.array(*map(F.lit, f.search.terms)), "terms")) == 0)
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def stored_predicate(f: Filter) -> Column:
    """All of a filter over stored events: its search is matched by the indexed terms of their content."""
    if not f.search:
        return predicate(f)
    terms = indexed_terms(all_terms(F.col("content")))
    return reduce(lambda a, b: a & b, [F.array_contains(terms, t) for t in f.search.terms], predicate(f))


def group_predicate(filters: list[Filter], live: bool = False) -> Column:
    """Whether any filter matches. Outside live matching a filter with a search matches nothing."""
    return reduce(lambda a, b: a | b, [predicate(f, live) if live or f.search is None else F.lit(False) for f in filters], F.lit(False))


def estimated_cost(filters: list[Filter], count_only: bool = False) -> int:
    """What a request may touch, before any data is read."""
    total = 0
    for f in filters:
        if f.search:
            base = 250
        elif f.ids is not None:
            base = len(f.ids)
        elif f.all_tags or f.any_tags:
            base = 25 if f.all_tags else 25 * len(f.any_tags)
        elif f.authors is not None:
            base = 5 if f.kinds is not None else 10 * len(f.authors)
        elif f.kinds is not None:
            base = 100 * len(f.kinds)
        else:
            base = 500 if f.since or f.until != NO_UNTIL else 1000
        total += max(1, base + 25 * sum(map(len, f.all_tags.values())))
    return 2 * total if count_only else total


@dataclass(frozen=True)
class Validator:
    """Optional limits of requests."""

    min_filters: int = 0
    max_filters: int = 1 << 62
    max_kinds: int = 1 << 62
    allowed_kinds: frozenset[int] = frozenset()
    scoped: bool = False

    def check(self, filters: list[Filter]) -> None:
        if not self.min_filters <= len(filters) <= self.max_filters:
            raise FilterError(f"{len(filters)} filters are too few or too many")
        for f in filters:
            if len(f.kinds or ()) > self.max_kinds:
                raise FilterError(f"{len(f.kinds)} kinds are more than {self.max_kinds}")
            if self.allowed_kinds and (bad := next((k for k in f.kinds or () if k not in self.allowed_kinds), None)) is not None:
                raise FilterError(f"kind not allowed: {bad}")
            single = [f.authors, *(tags.get(x) for tags in (f.any_tags, f.all_tags) for x in "pe")]
            if self.scoped and not any(s is not None and len(s) == 1 for s in single):
                raise FilterError("not scoped to one author, p tag or e tag")


def fully_restricted(filters: list[Filter], restricted: set[int]) -> bool:
    """Every filter asks for restricted kinds only: the request needs a reader's name."""
    return bool(restricted and filters) and all(f.kinds is not None and set(f.kinds) <= restricted for f in filters)


def may_count(filters: list[Filter], restricted: set[int], reader: str | None) -> bool:
    """A COUNT that could include restricted kinds must be about the reader alone."""
    for f in filters if restricted else ():
        if f.kinds is None or set(f.kinds) & restricted:
            if reader is None or not any(s is not None and set(s) == {reader} for s in (f.authors, f.any_tags.get("p"), f.all_tags.get("p"))):
                return False
    return True


def sketch_offset(filters: list[Filter]) -> int | None:
    """Where in a pubkey the distinct-author sketch reads; None if the request has no sketch."""
    import hashlib

    if len(filters) != 1 or filters[0].all_tags or len(filters[0].any_tags) != 1:
        return None
    ((name, values),) = filters[0].any_tags.items()
    if len(values) != 1:
        return None
    seed = values[0]
    if not re.fullmatch("[0-9a-f]{64}", seed):
        try:
            seed = parse_address(values[0])[1]
        except CodecError:
            seed = hashlib.sha256(values[0].encode()).hexdigest()
    return int(seed[32], 16) + 8


def without_required_tags(f: Filter) -> Filter:
    """For peers that don't know ``&x``: asks for any of its values instead, a superset to be filtered again."""
    return replace(f, all_tags={}, any_tags=f.any_tags | {k: tuple(sorted({*v}, key=str.encode)) for k, v in f.all_tags.items()})


SUBSCRIPTION_ID = re.compile(r'[\x20-\x21\x23-\x5B\x5D-\x7E]{1,64}')


def check_subscription_id(text: str) -> str:
    """1 to 64 printable ASCII characters other than quote and backslash."""
    if not SUBSCRIPTION_ID.fullmatch(text):
        raise FilterError("not a subscription name")
    return text
