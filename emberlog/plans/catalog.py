"""Queries over the event log by name, and the SQL that gives the same rows."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import codec
from ..functions.terms import all_terms, indexed_terms, live_terms
from ..operators import admission, maintain, query, sketch, state, subscriptions, visibility
from ..sources import log as source
from ..sources.store import kept, postings
from ..streaming import live
from .filters import parse_filter, parse_group, sketch_offset, without_required_tags

_QUERIES, _SQL = {}, {}


def _author(n: int) -> str:
    return hashlib.sha256(str(n).encode()).hexdigest()


def _event(n: int) -> str:
    return hashlib.sha256(f"e{n}".encode()).hexdigest()


def plain_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The adapter's log, written once a session, clustered by kind and time."""
    return kept(spark, "log", f"{sf_dir}/events.parquet", lambda: source.events_log(spark, sf_dir), ["kind", "created_at", "lev_id"], ("id", "pubkey"))


def tagged_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The adapter's log with a second t tag (the user's last digit), so that events have several tags; written once a session."""

    def make() -> DataFrame:
        rows = source.events_log(spark, sf_dir, ("value", "user_id")).withColumn("u", F.concat(F.lit("u"), (F.col("user_id") % 10).cast("string")))
        return rows.withColumn("tags", F.concat("tags", F.array(F.array(F.lit("t"), F.col("u"))))).withColumn("idx_tags", source.indexed(F.col("tags")))

    return kept(spark, "tagged", f"{sf_dir}/events.parquet", make, ["kind", "created_at", "lev_id"], ("id", "pubkey"))


def text_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The postings of the documents' log, written once a session, clustered by term."""
    return kept(spark, "postings", f"{sf_dir}/documents.parquet", lambda: postings(source.documents_log(spark, sf_dir)), ["term", "lev_id"])


LOG = """log AS (
  SELECT event_id AS lev_id, CAST(floor(epoch(ts)) AS BIGINT) AS created_at, sha256(CAST(user_id AS VARCHAR)) AS pubkey, sha256('e' || event_id) AS id,
         CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 7 WHEN 'signup' THEN 0 WHEN 'purchase' THEN 30023 ELSE 20001 END AS kind,
         json_extract_string(props, '$.k') AS k, 'u' || (user_id % 10) AS u, value, user_id
  FROM events)"""


def social_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log with deletions, vanish requests and gift wraps, made of the events' own columns.

    Errors are deletions of the author's event before (odd k), of the author's address with the same k (even k), or vanish requests (k = 7);
    clicks with k under 10 are gift wraps to one of seven users.
    """
    from pyspark.sql import Window

    rows = tagged_log(spark, sf_dir)
    k = F.col("k").cast("int")
    before = F.lag("id").over(Window.partitionBy("pubkey").orderBy("lev_id"))
    error = F.col("kind") == 20001
    kind = F.when(error & (k == 7), 62).when(error, 5).when((F.col("kind") == 7) & (k < 10), 1059).otherwise(F.col("kind"))
    rows = rows.withColumn("__before", before).withColumn("__kind", kind)
    target = F.when(k % 2 == 1, F.array(F.lit("e"), F.coalesce("__before", F.lit("")))).otherwise(F.array(F.lit("a"), F.concat(F.lit("30023:"), F.col("pubkey"), F.lit(":"), F.col("k"))))
    tags = F.when(F.col("__kind") == 62, F.array(F.array(F.lit("relay"), F.lit("ALL_RELAYS")))).when(F.col("__kind") == 5, F.array(target)).when(F.col("__kind") == 1059, F.array(F.array(F.lit("p"), F.sha2((F.col("user_id") % 7 + 1).cast("string"), 256)))).otherwise(F.col("tags"))
    rows = rows.withColumn("tags", tags).withColumn("kind", F.col("__kind")).withColumn("idx_tags", source.indexed(F.col("tags")))
    return rows.drop("__before", "__kind")


SOCIAL = (
    LOG
    + """, social AS (
  SELECT lev_id, created_at, pubkey, id, k, user_id,
         CASE WHEN kind = 20001 AND k = '7' THEN 62 WHEN kind = 20001 THEN 5 WHEN kind = 7 AND CAST(k AS INT) < 10 THEN 1059 ELSE kind END AS kind,
         CASE WHEN kind = 20001 AND k <> '7' AND CAST(k AS INT) % 2 = 1 THEN lag(id) OVER (PARTITION BY pubkey ORDER BY lev_id) END AS e,
         CASE WHEN kind = 20001 AND CAST(k AS INT) % 2 = 0 THEN k END AS a,
         CASE WHEN kind = 7 AND CAST(k AS INT) < 10 THEN sha256(CAST(user_id % 7 + 1 AS VARCHAR)) END AS p
  FROM log)"""
)

COLUMNS = ("lev_id", "created_at", "kind")


def _add(name: str, run, sql: str | None = None) -> None:
    _QUERIES[name] = run
    if sql:
        _SQL[name] = sql


def _filtered(name: str, filter_json: dict, where: str, limit: int | None = None) -> None:
    f = parse_filter(filter_json)
    n = f.limit if limit is None else limit
    _add(name, lambda s, d: query.run_filter(tagged_log(s, d), f).select(*COLUMNS), f"WITH {LOG} SELECT lev_id, created_at, kind FROM log WHERE {where} ORDER BY created_at DESC, lev_id DESC LIMIT {n}")


_in = lambda values: ", ".join(f"'{v}'" for v in values)
_filtered("filter_ids", {"ids": [_event(n) for n in (1, 5, 9, 11, 999_999)]}, f"id IN ({_in([_event(n) for n in (1, 5, 9, 11, 999_999)])})")
_filtered("filter_authors", {"authors": [_author(3), _author(4)]}, f"pubkey IN ({_in([_author(3), _author(4)])})")
_filtered("filter_kinds", {"kinds": [1, 30023], "limit": 100}, "kind IN (1, 30023)")
_filtered("filter_author_kind", {"authors": [_author(2), _author(7)], "kinds": [1], "limit": 50}, f"pubkey IN ({_in([_author(2), _author(7)])}) AND kind = 1")
_filtered("filter_tag_or", {"kinds": [1, 7], "#t": ["3", "4", "5"], "limit": 50}, "kind IN (1, 7) AND k IN ('3', '4', '5')")
_filtered("filter_tag_and", {"&t": ["5", "u3"]}, "k = '5' AND u = 'u3'")
_filtered("filter_tag_and_or_overlap", {"&t": ["u3"], "#t": ["u3", "5", "6", "7"]}, "u = 'u3' AND k IN ('5', '6', '7')")
_filtered("filter_two_tag_keys", {"#d": ["1", "2", "3"], "#t": ["u1", "u2"]}, "kind = 30023 AND k IN ('1', '2', '3') AND u IN ('u1', 'u2')")
_filtered("filter_since_until", {"since": 1704300000, "until": 1704400000}, "created_at BETWEEN 1704300000 AND 1704400000")
_filtered("filter_full_scan", {}, "TRUE")
_filtered("filter_limit_zero", {"kinds": [1], "limit": 0}, "FALSE")

_NEW = "row_number() OVER (ORDER BY created_at DESC, lev_id DESC)"


def _group_sql(parts: list[tuple[str, int]], tail: str) -> str:
    filters = [f"SELECT * FROM (SELECT *, {i} AS f FROM log WHERE {w} ORDER BY created_at DESC, lev_id DESC LIMIT {n})" for i, (w, n) in enumerate(parts)]
    return f"WITH {LOG}, hit AS ({' UNION ALL '.join(filters)}), first AS (SELECT lev_id, created_at, kind, min(f) AS filter_idx FROM hit GROUP BY 1, 2, 3) {tail}"


def _grouped(name: str, filters: list[dict], parts: list[tuple[str, int]], cap: int) -> None:
    fs = parse_group(filters)
    tail = f"SELECT lev_id, created_at, kind, filter_idx FROM first ORDER BY filter_idx, created_at DESC, lev_id DESC LIMIT {cap}"
    _add(name, lambda s, d: query.run_group(tagged_log(s, d), fs, cap).select(*COLUMNS, "filter_idx"), _group_sql(parts, tail))


_grouped("group_union", [{"kinds": [1], "limit": 60}, {"kinds": [7], "limit": 40}], [("kind = 1", 60), ("kind = 7", 40)], 2000)
_grouped("group_limit_overlap", [{"kinds": [1], "limit": 30}, {"kinds": [1, 7], "limit": 30}], [("kind = 1", 30), ("kind IN (1, 7)", 30)], 2000)
_grouped("request_cap", [{"kinds": [1], "limit": 50}, {"kinds": [0], "limit": 50}], [("kind = 1", 50), ("kind = 0", 50)], 70)

_PAGE = {"authors": [_author(1)], "kinds": [1, 7], "limit": 20}
_PAGE_WHERE = f"pubkey = '{_author(1)}' AND kind IN (1, 7)"
_filtered("deep_page_1", _PAGE, _PAGE_WHERE)
_EDGE = 1705200000
_add("deep_page_2", lambda s, d: query.page_before(tagged_log(s, d), parse_filter(_PAGE), _EDGE).select(*COLUMNS), f"WITH {LOG} SELECT lev_id, created_at, kind FROM log WHERE {_PAGE_WHERE} AND created_at < {_EDGE} ORDER BY created_at DESC, lev_id DESC LIMIT 20")
_RANGE = "created_at BETWEEN 1704300000 AND 1704900000"
for _name, _back in (("export_forward", False), ("export_reverse", True)):
    _add(_name, lambda s, d, back=_back: source.export_rows(plain_log(s, d), 1704300000, 1704900000, back).select("lev_id", "created_at", "id"), f"WITH {LOG} SELECT lev_id, created_at, id FROM log WHERE {_RANGE}")
_add("point_read", lambda s, d: source.by_lev_id(plain_log(s, d), 77).unionByName(source.by_id(plain_log(s, d), _event(78))).select(*COLUMNS), f"WITH {LOG} SELECT lev_id, created_at, kind FROM log WHERE lev_id = 77 OR id = '{_event(78)}'")
_add("change_feed", lambda s, d: source.changes_from(plain_log(s, d), 500).select(*COLUMNS), f"WITH {LOG} SELECT lev_id, created_at, kind FROM log WHERE lev_id >= 500")
_add("newest_arrival", lambda s, d: maintain.newest(plain_log(s, d)), "SELECT max(event_id) AS lev_id FROM events")

# -- counts and sketches
_COUNT = [{"kinds": [1]}, {"#t": ["u3"]}]
_add("count_group", lambda s, d: query.count_group(tagged_log(s, d), parse_group(_COUNT, max_limit=1_000_001), 1_000_000), f"WITH {LOG} SELECT least(count(*), 1000000) AS count, count(*) > 1000000 AS limited FROM log WHERE kind = 1 OR u = 'u3'")
_add("count_capped", lambda s, d: query.count_group(tagged_log(s, d), parse_group(_COUNT, max_limit=101), 100), _group_sql([("kind = 1", 101), ("u = 'u3'", 101)], "SELECT least(count(*), 100) AS count, count(*) > 100 AS limited FROM (SELECT DISTINCT lev_id FROM first LIMIT 101)"))
_SKETCH = parse_group([{"#t": ["5"]}])
_AT = sketch_offset(_SKETCH)


def _registers(where: str) -> str:
    value = f"CAST('0x' || substr(pubkey, {2 * _AT + 3}, 14) AS BIGINT)"
    return f"SELECT CAST('0x' || substr(pubkey, {2 * _AT + 1}, 2) AS INT) AS reg, CAST(max(CASE WHEN {value} = 0 THEN 57 ELSE 57 - length(bin({value})) END) AS INT) AS rank FROM log WHERE {where} GROUP BY 1"


_add("hll_registers", lambda s, d: query.sketch_registers(tagged_log(s, d).where("k = '5'"), _AT), f"WITH {LOG} {_registers("k = '5'")}")
_add("hll_merge", lambda s, d: query.merge_registers(*[query.sketch_registers(tagged_log(s, d).where(w), _AT) for w in ("k = '5' and lev_id % 2 = 0", "k = '5' and lev_id % 2 = 1")]), f"WITH {LOG} {_registers("k = '5'")}")
_add("hll_hex", lambda s, d: query.sketch_hex(query.sketch_registers(tagged_log(s, d).where("k = '5'"), _AT)), f"WITH {LOG}, r AS ({_registers("k = '5'")}) SELECT string_agg(lpad(lower(to_hex(coalesce(rank, 0))), 2, '0'), '' ORDER BY i) AS hll FROM (SELECT unnest(generate_series(0, 255)) AS i) LEFT JOIN r ON reg = i")
_add("events_per_author", lambda s, d: maintain.stored_per_author(plain_log(s, d)), f"WITH {LOG} SELECT pubkey, count(*) AS n FROM log GROUP BY 1")
_add("latency_percentiles", lambda s, d: maintain.latencies(s.read.parquet(f"{d}/events.parquet"), "value", "event_type"), "SELECT event_type, count(*) AS n, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.9) AS p90, quantile_cont(value, 0.99) AS p99, max(value) AS largest FROM events GROUP BY 1")

# -- search
WORDS = """word AS (
  SELECT doc_id, unnest(generate_series(1, len(w))) AS pos, unnest(w) AS term
  FROM (SELECT doc_id, list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}]+'), lambda x: lower(x)) AS w FROM documents)),
term AS (SELECT doc_id, term FROM (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY min(pos)) AS n FROM word WHERE strlen(term) <= 64 GROUP BY doc_id, term) WHERE n <= 256),
pair AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY doc_id ORDER BY min(pos)) AS n FROM
  (SELECT a.doc_id, a.pos, a.term || ' ' || b.term AS p FROM word a JOIN word b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE strlen(a.term) <= 64 AND strlen(b.term) <= 64) GROUP BY doc_id, p) WHERE n <= 256)"""


def _search_sql(terms: list[str], phrase: list[str], limit: int, more: str = "") -> str:
    df = " + ".join(f"(1000000000 // (1 + (SELECT count(*) FROM term WHERE term = '{t}'))) * 100" for t in terms)
    pairs = [f"{a} {b}" for a, b in zip(phrase, phrase[1:], strict=False)]
    bonus = " + ".join([f"CASE WHEN EXISTS (SELECT 1 FROM pair WHERE pair.doc_id = h.doc_id AND p = '{p}') THEN 2000000000 ELSE 0 END" for p in pairs] or ["0"])
    return f"""hit AS (SELECT doc_id FROM term WHERE term IN ({_in(terms)}) GROUP BY doc_id HAVING count(*) = {len(terms)}),
scored AS (SELECT h.doc_id AS lev_id, CAST({df} + {bonus} AS BIGINT) AS score FROM hit h {more})
SELECT lev_id, score FROM scored ORDER BY score DESC, lev_id DESC LIMIT {limit}"""


def _searched(name: str, filter_json: dict, terms: list[str], phrase: list[str], limit: int) -> None:
    f = parse_filter(filter_json)
    _add(name, lambda s, d: query.search_filter(source.documents_log(s, d), f, index=text_index(s, d)).select("lev_id", "score"), f"WITH {WORDS}, {_search_sql(terms, phrase, limit)}")


_add("terms_df", lambda s, d: query.document_frequency(text_index(s, d)), f"WITH {WORDS} SELECT term, count(*) AS df FROM term GROUP BY 1")
_searched("search_ranked", {"search": "the and", "limit": 40}, ["and", "the"], ["the", "and"], 40)
_searched("search_phrase", {"search": "under the mit license lang:en", "limit": 20}, ["license", "mit", "the", "under"], ["under", "the", "mit", "license"], 20)
_searched("search_rare", {"search": "apache", "limit": 500}, ["apache"], ["apache"], 500)
_MULTI = [{"search": "license", "limit": 5}, {"search": "the", "limit": 5}]
_add(
    "search_multi",
    lambda s, d: query.run_group(source.documents_log(s, d), parse_group(_MULTI), index=text_index(s, d)).select("lev_id", "score"),
    f"""WITH {WORDS}, a AS (SELECT doc_id AS lev_id, CAST((1000000000 // (1 + (SELECT count(*) FROM term WHERE term = 'license'))) * 100 AS BIGINT) AS score FROM term WHERE term = 'license' ORDER BY doc_id DESC LIMIT 5),
b AS (SELECT doc_id AS lev_id, CAST((1000000000 // (1 + (SELECT count(*) FROM term WHERE term = 'the'))) * 100 AS BIGINT) AS score FROM term WHERE term = 'the' ORDER BY doc_id DESC LIMIT 5)
SELECT lev_id, max(score) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1""",
)
_MIXED = [{"search": "license", "limit": 5}, {"#l": ["de"], "limit": 5}]
_add(
    "mixed_search_group",
    lambda s, d: query.run_group(source.documents_log(s, d), parse_group(_MIXED), index=text_index(s, d)).select("lev_id", "filter_idx"),
    f"""WITH {WORDS}, a AS (SELECT doc_id AS lev_id, 0 AS f FROM term WHERE term = 'license' ORDER BY doc_id DESC LIMIT 5),
b AS (SELECT doc_id AS lev_id, 1 AS f FROM documents WHERE lang = 'de' ORDER BY doc_id DESC LIMIT 5)
SELECT lev_id, min(f) AS filter_idx FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1""",
)


def _hidden(s: SparkSession, d: str) -> DataFrame:
    banned = s.read.parquet(f"{d}/labels.parquet").where("toxic = 1").select(F.sha2(F.concat(F.lit("d"), F.col("doc_id").cast("string")), 256).alias("id"))
    f = parse_filter({"search": "the", "limit": 100})
    return query.search_filter(source.documents_log(s, d), f, lambda x: visibility.without_banned(x, banned_events=banned), text_index(s, d)).select("lev_id", "score")


_add("search_hidden_consumes_limit", _hidden, f"WITH {WORDS}, s AS (SELECT doc_id AS lev_id, CAST((1000000000 // (1 + (SELECT count(*) FROM term WHERE term = 'the'))) * 100 AS BIGINT) AS score FROM term WHERE term = 'the' ORDER BY doc_id DESC LIMIT 100) SELECT * FROM s WHERE lev_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
_add(
    "live_terms_match",
    lambda s, d: source.documents_log(s, d).select("lev_id", live_terms(F.col("content")).alias("terms")).where(F.array_contains("terms", "license") & F.array_contains("terms", "the")).select("lev_id"),
    f"WITH {WORDS} SELECT doc_id AS lev_id FROM word WHERE term IN ('license', 'the') GROUP BY 1 HAVING count(DISTINCT term) = 2",
)
_add("terms_indexed", lambda s, d: source.documents_log(s, d).select("lev_id", F.size(indexed_terms(all_terms(F.col("content")))).cast("long").alias("n")), f"WITH {WORDS} SELECT d.doc_id AS lev_id, (SELECT count(*) FROM term t WHERE t.doc_id = d.doc_id) AS n FROM documents d")

# -- visibility
_BAD = [_author(n) for n in (2, 3, 5)]
_seen = lambda s, d: tagged_log(s, d)
_lists = lambda s: (s.createDataFrame([(_event(n),) for n in range(100, 140)], "id string"), s.createDataFrame([(a,) for a in _BAD], "pubkey string"))
_add("banned_author", lambda s, d: visibility.without_banned(_seen(s, d), banned_authors=_lists(s)[1]).select(*COLUMNS), f"WITH {LOG} SELECT lev_id, created_at, kind FROM log WHERE pubkey NOT IN ({_in(_BAD)})")
_add("banned_event", lambda s, d: visibility.without_banned(_seen(s, d), banned_events=_lists(s)[0]).select(*COLUMNS), f"WITH {LOG} SELECT lev_id, created_at, kind FROM log WHERE id NOT IN ({_in([_event(n) for n in range(100, 140)])})")
_add("kind_policy", lambda s, d: visibility.without_banned(_seen(s, d), allowed_kinds=[0, 1]).select(*COLUMNS), f"WITH {LOG} SELECT lev_id, created_at, kind FROM log WHERE kind IN (0, 1)")
_add(
    "moderation_reason",
    lambda s, d: visibility.moderation_reason(_seen(s, d), *_lists(s), [0, 1, 7]).select("lev_id", "reason"),
    f"WITH {LOG} SELECT lev_id, CASE WHEN id IN ({_in([_event(n) for n in range(100, 140)])}) THEN 'event banned' WHEN pubkey IN ({_in(_BAD)}) THEN 'author banned' WHEN kind NOT IN (0, 1, 7) THEN 'kind not allowed' END AS reason FROM log",
)
_MARKS = "mark AS (SELECT pubkey, max(created_at) AS vanished_at FROM social WHERE kind = 62 GROUP BY 1)"
_add("vanish_markers", lambda s, d: visibility.vanish_markers(social_log(s, d), []), f"WITH {SOCIAL}, {_MARKS} SELECT * FROM mark")


def _vanished(s: SparkSession, d: str, kinds: str) -> DataFrame:
    rows = social_log(s, d)
    markers = visibility.vanish_markers(rows.where("user_id % 3 = 0"), [])
    return visibility.without_vanished(rows, markers).where(kinds).select(*COLUMNS)


_MARKS_3 = "mark AS (SELECT pubkey, max(created_at) AS vanished_at FROM social WHERE kind = 62 AND user_id % 3 = 0 GROUP BY 1)"
_OWN = "NOT EXISTS (SELECT 1 FROM mark m WHERE m.pubkey = s.pubkey AND s.created_at <= m.vanished_at AND s.kind <> 62)"
_add("vanish_author", lambda s, d: _vanished(s, d, "kind != 1059"), f"WITH {SOCIAL}, {_MARKS_3} SELECT lev_id, created_at, kind FROM social s WHERE kind <> 1059 AND {_OWN}")
_add("vanish_recipient", lambda s, d: _vanished(s, d, "kind = 1059"), f"WITH {SOCIAL}, {_MARKS_3} SELECT lev_id, created_at, kind FROM social s WHERE kind = 1059 AND {_OWN} AND p NOT IN (SELECT pubkey FROM mark)")
_add("restricted_reader", lambda s, d: visibility.for_reader(social_log(s, d), [1059, 7], _author(3)).select(*COLUMNS), f"WITH {SOCIAL} SELECT lev_id, created_at, kind FROM social WHERE kind NOT IN (1059, 7) OR (p IS NOT NULL AND (p = '{_author(3)}' OR pubkey = '{_author(3)}'))")

# -- state
_add("dedup_id", lambda s, d: state.dedup_ids(plain_log(s, d).unionByName(plain_log(s, d).where("lev_id % 3 = 0").withColumn("lev_id", F.col("lev_id") + 1_000_000))).select(*COLUMNS), f"WITH {LOG} SELECT lev_id, created_at, kind FROM log")
_LATEST = "SELECT lev_id, created_at, kind FROM (SELECT *, row_number() OVER (PARTITION BY pubkey, kind, {d} ORDER BY created_at DESC, id) AS n FROM log WHERE kind = {kind}) WHERE n = 1"
_add("latest_replaceable", lambda s, d: state.latest_state(plain_log(s, d)).where("kind = 0").select(*COLUMNS), f"WITH {LOG} " + _LATEST.format(d="''", kind=0))
_add("latest_addressable", lambda s, d: state.latest_state(plain_log(s, d)).where("kind = 30023").select(*COLUMNS), f"WITH {LOG} " + _LATEST.format(d="k", kind=30023))
_TOMB = f"WITH {SOCIAL} SELECT lev_id, created_at, kind FROM social s WHERE NOT (kind <> 62 AND EXISTS (SELECT 1 FROM social t WHERE t.kind = 5 AND t.e = s.id AND t.pubkey = s.pubkey)) AND NOT (kind = 30023 AND EXISTS (SELECT 1 FROM social t WHERE t.kind = 5 AND t.a = s.k AND t.pubkey = s.pubkey AND t.created_at >= s.created_at))"
_add("without_deleted", lambda s, d: state.without_deleted(social_log(s, d)).select(*COLUMNS), _TOMB)
_add("tombstone_id", lambda s, d: state.tombstones(social_log(s, d))[0], f"WITH {SOCIAL} SELECT DISTINCT e AS id, pubkey FROM social WHERE kind = 5 AND e IS NOT NULL")
_add("tombstone_address", lambda s, d: state.tombstones(social_log(s, d))[1], f"WITH {SOCIAL} SELECT CAST(30023 AS INT) AS kind, pubkey, a AS d, max(created_at) AS deleted_at FROM social WHERE kind = 5 AND a IS NOT NULL GROUP BY pubkey, a")
_add("expire_sweep", lambda s, d: state.without_expired(tagged_log(s, d), F.col("created_at") + F.col("k").cast("int") * 10_000, 1_705_500_000).select(*COLUMNS), f"WITH {LOG} SELECT lev_id, created_at, kind FROM log WHERE created_at + CAST(k AS INT) * 10000 > 1705500000 OR lev_id = (SELECT max(lev_id) FROM log)")
_TIMES = lambda: F.when(F.col("k").cast("int") % 3 == 0, F.concat(F.lit("x"), "k")).when(F.col("k").cast("int") % 3 == 1, F.col("k")).otherwise(F.concat("k", F.lit("00")))
_add("expiration_tag", lambda s, d: plain_log(s, d).withColumn("tags", F.array(F.array(F.lit("expiration"), _TIMES()), F.array(F.lit("expiration"), F.lit("5000")))).select("lev_id", state.expiration_of().alias("at")), f"WITH {LOG} SELECT lev_id, CASE WHEN CAST(k AS INT) % 3 = 2 THEN CAST(k AS BIGINT) * 100 END AS at FROM log")
_add("replay_status", lambda s, d: state.status_counts(state.replay(social_log(s, d))))
_add("no_resurrection", lambda s, d: state.replay(social_log(s, d)).where("status = 'written'").join(social_log(s, d), "lev_id").where("kind = 30023").select(*COLUMNS))
_add("age_delete", lambda s, d: maintain.delete_matching(tagged_log(s, d), [parse_filter({"kinds": [20001]})], 1706000000, 86400)[0].select(*COLUMNS), f"WITH {LOG} SELECT lev_id, created_at, kind FROM log WHERE NOT (kind = 20001 AND created_at <= 1706000000 - 86400)")

# -- sets
_mine, _theirs = "lev_id % 10 != 3", "lev_id % 10 != 5"
for _name, _side, _a, _b in (("reconcile_have", "have", _mine, _theirs), ("reconcile_need", "need", _theirs, _mine)):
    _add(_name, lambda s, d, side=_side: sketch.reconcile(plain_log(s, d).where(_mine), plain_log(s, d).where(_theirs)).where(F.col("side") == side), f"WITH {LOG} SELECT created_at, id, '{_side}' AS side FROM log WHERE {_a} AND NOT ({_b})")


def _fingerprint_sql(source_sql: str, key: str) -> str:
    limbs = ", ".join(f"sum(CAST('0x' || {' || '.join(f'substr(id, {8 * i + 1 + 2 * j}, 2)' for j in (3, 2, 1, 0))} AS BIGINT)) AS s{i}" for i in range(8))
    carries, c = [], "0"
    out = []
    for i in range(8):
        out.append(f"({f'c{i - 1}' if i else '0'} + s{i}) % 4294967296 AS r{i}, ({f'c{i - 1}' if i else '0'} + s{i}) // 4294967296 AS c{i}")
    steps = f"sums AS (SELECT {key}, count(*) AS n, {limbs} FROM ({source_sql}) GROUP BY {key})"
    last = "sums"
    for i in range(8):
        steps += f", x{i} AS (SELECT *, {out[i]} FROM {last})"
        last = f"x{i}"
    byte = lambda i: " || ".join(f"substr(lpad(lower(to_hex(CAST(r{i} AS BIGINT))), 8, '0'), {p}, 2)" for p in (7, 5, 3, 1))
    varint = "CASE WHEN n < 128 THEN lpad(lower(to_hex(n)), 2, '0') WHEN n < 16384 THEN lpad(lower(to_hex(n // 128 + 128)), 2, '0') || lpad(lower(to_hex(n % 128)), 2, '0') ELSE lpad(lower(to_hex(n // 16384 + 128)), 2, '0') || lpad(lower(to_hex(n // 128 % 128 + 128)), 2, '0') || lpad(lower(to_hex(n % 128)), 2, '0') END"
    return f"WITH {LOG}, {steps} SELECT {key}, n, substr(sha256(unhex({' || '.join(byte(i) for i in range(8))} || {varint})), 1, 32) AS fp FROM {last}"


_add("range_fingerprints", lambda s, d: sketch.fingerprints(sketch.split_range(plain_log(s, d)), ["bucket"]), _fingerprint_sql("SELECT id, CAST(ntile(16) OVER (ORDER BY created_at, id) AS INT) AS bucket FROM log", "bucket"))
_add("kind_fingerprints", lambda s, d: sketch.fingerprints(plain_log(s, d), ["kind"]), _fingerprint_sql("SELECT id, kind FROM log", "kind"))
_add("range_bounds", lambda s, d: sketch.range_bounds(plain_log(s, d)), f"""WITH {LOG}, b AS (SELECT created_at, id, CAST(ntile(16) OVER w AS INT) AS bucket, lag(created_at) OVER w AS t, lag(id) OVER w AS i FROM log WINDOW w AS (ORDER BY created_at, id)),
c AS (SELECT *, lag(bucket) OVER (ORDER BY created_at, id) AS last FROM b)
SELECT bucket, created_at AS bound_at, CASE WHEN created_at <> t THEN '' ELSE substr(id, 1, 2 * (SELECT min(j) FROM generate_series(1, 32) g(j) WHERE substr(id, 1, 2 * j) <> substr(i, 1, 2 * j))) END AS bound_id FROM c WHERE last <> bucket""")
_add("prefix_fingerprints", lambda s, d: sketch.fingerprint_of(sketch.prefix_fingerprints(plain_log(s, d), ["kind"]), ["kind"]), _fingerprint_sql("SELECT a.id, b.kind FROM log a JOIN (SELECT DISTINCT kind FROM log) b ON a.kind <= b.kind", "kind"))


def _updated(s: SparkSession, d: str) -> DataFrame:
    """A tree after a batch: some items came, some went."""
    rows = plain_log(s, d)
    before = sketch.limb_sums(rows.where("lev_id % 10 < 7"), ["kind"])
    return sketch.fingerprint_of(sketch.applied(before, rows.where("lev_id % 10 >= 7"), rows.where("lev_id % 10 = 1"), ["kind"]), ["kind"])


_add("tree_update", _updated, _fingerprint_sql("SELECT id, kind FROM log WHERE lev_id % 10 <> 1", "kind"))
_add("differing_ranges", lambda s, d: sketch.differing_ranges(plain_log(s, d), plain_log(s, d).where("lev_id % 977 != 5"), 3600), f"WITH {LOG} SELECT DISTINCT created_at // 3600 AS slot FROM log WHERE lev_id % 977 = 5")

# -- standing queries
_SUBS = [
    subscriptions.Subscription(1, "authors", tuple(parse_group([{"authors": [_author(1), _author(9)], "kinds": [1]}]))),
    subscriptions.Subscription(2, "kinds", tuple(parse_group([{"kinds": [0, 7], "since": 1705000000}]))),
    subscriptions.Subscription(3, "tags", tuple(parse_group([{"#t": ["5", "6"]}, {"&t": ["u3", "9"]}]))),
    subscriptions.Subscription(4, "all", tuple(parse_group([{"until": 1704300000}]))),
    subscriptions.Subscription(5, "marked", tuple(parse_group([{"kinds": [1]}])), 5000),
]
_MATCH = {
    "match_by_author": (1, f"pubkey IN ({_in([_author(1), _author(9)])}) AND kind = 1"),
    "match_by_kind": (2, "kind IN (0, 7) AND created_at >= 1705000000"),
    "match_by_tag": (3, "k IN ('5', '6') OR (u = 'u3' AND k = '9')"),
    "match_any": (4, "created_at <= 1704300000"),
    "watermark_skip": (5, "kind = 1 AND lev_id > 5000"),
}
for _name, (_conn, _where) in _MATCH.items():
    _add(_name, lambda s, d, c=_conn: subscriptions.match(tagged_log(s, d), subscriptions.subscription_table(s, _SUBS)).where(F.col("conn") == c), f"WITH {LOG} SELECT CAST({_conn} AS BIGINT) AS conn, '{next(x.sub for x in _SUBS if x.conn == _conn)}' AS sub, lev_id FROM log WHERE lev_id > 0 AND ({_where})")
_ROUTES = {"up": parse_group([{"kinds": [1, 7]}]), "down": parse_group([{"#t": ["u1"]}, {"kinds": [0]}]), "never": parse_group([{"search": "x"}])}
_add("router_groups", lambda s, d: subscriptions.router(tagged_log(s, d), _ROUTES), f"WITH {LOG} SELECT 'up' AS router_group, lev_id FROM log WHERE kind IN (1, 7) UNION ALL SELECT 'down', lev_id FROM log WHERE u = 'u1' OR kind = 0")
_FOLDED = parse_filter({"&t": ["5", "u3"]})
_add("compatible_superset", lambda s, d: query.run_filter(query.run_filter(tagged_log(s, d), without_required_tags(_FOLDED)), _FOLDED).select(*COLUMNS), f"WITH {LOG} SELECT lev_id, created_at, kind FROM (SELECT * FROM log WHERE k = '5' OR u = 'u3' ORDER BY created_at DESC, lev_id DESC LIMIT 500) WHERE k = '5' AND u = 'u3'")

# -- admission
_POLICY = admission.Policy(now=1_706_000_000, newer=100_000, older=1_500_000, ephemeral_older=1_000_000, min_pow=1, allowed_kinds=(0, 1, 7, 20001))
_REASON = f"""CASE WHEN created_at < 1706000000 - 1000000 AND kind = 20001 THEN 'ephemeral event expired' WHEN kind <> 20001 AND created_at < 1706000000 - 1500000 THEN 'created_at too early' WHEN created_at > 1706100000 THEN 'created_at too late'
WHEN kind NOT IN (0, 1, 7, 20001) THEN 'kind not allowed' WHEN id IN ({_in([_event(n) for n in range(100, 140)])}) THEN 'event banned' WHEN pubkey IN ({_in(_BAD)}) THEN 'author banned' WHEN substr(id, 1, 1) > '7' THEN 'not enough work' WHEN lev_id % 5 = 0 THEN 'duplicate' END"""


def _judged(s: SparkSession, d: str) -> DataFrame:
    rows = tagged_log(s, d)
    return admission.first_reason(rows, _POLICY, *_lists(s), stored=rows.where("lev_id % 5 = 0"))


_add("first_reject_reason", lambda s, d: _judged(s, d).select("lev_id", "reason"), f"WITH {LOG} SELECT lev_id, {_REASON} AS reason FROM log")
_add("reason_counts", lambda s, d: admission.reason_counts(_judged(s, d)), f"WITH {LOG} SELECT coalesce({_REASON}, 'admitted') AS reason, count(*) AS n FROM log GROUP BY 1")
_add("pow_bits", lambda s, d: admission.pow_bits(plain_log(s, d)), f"WITH {LOG} SELECT lev_id, CAST(4 * length(regexp_extract(id, '^0*')) + CASE WHEN substr(id, 1 + length(regexp_extract(id, '^0*')), 1) = '1' THEN 3 WHEN substr(id, 1 + length(regexp_extract(id, '^0*')), 1) IN ('2', '3') THEN 2 WHEN substr(id, 1 + length(regexp_extract(id, '^0*')), 1) IN ('4', '5', '6', '7') THEN 1 ELSE 0 END AS INT) AS bits FROM log")
_add("quota_author", lambda s, d: admission.within_author_quota(plain_log(s, d), 40, plain_log(s, d).where("lev_id % 7 = 0")).select(*COLUMNS), f"WITH {LOG}, o AS (SELECT pubkey, count(*) AS c FROM log WHERE lev_id % 7 = 0 GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY pubkey ORDER BY lev_id) AS n FROM log) SELECT lev_id, created_at, kind FROM r LEFT JOIN o USING (pubkey) WHERE n + coalesce(c, 0) <= 40")
_add("quota_global", lambda s, d: admission.batches_within_quota(plain_log(s, d), 4000, 512), f"""WITH RECURSIVE {LOG}, b AS (SELECT lev_id // 512 AS batch_no, count(*) AS n FROM log GROUP BY 1),
r AS (SELECT batch_no, n, n <= 4000 AS accepted, CASE WHEN n <= 4000 THEN n ELSE 0 END AS total FROM b WHERE batch_no = (SELECT min(batch_no) FROM b)
UNION ALL SELECT b.batch_no, b.n, r.total + b.n <= 4000, r.total + CASE WHEN r.total + b.n <= 4000 THEN b.n ELSE 0 END FROM r JOIN b ON b.batch_no = r.batch_no + 1) SELECT batch_no, n, accepted FROM r""")


def _reports(s: SparkSession, d: str) -> DataFrame:
    rows = social_log(s, d)
    return rows.where((F.col("kind") == 5) & F.exists("idx_tags", lambda t: t["name"] == "e")).withColumn("kind", F.lit(admission.REPORT)).withColumn("content", F.concat(F.lit("spam "), F.col("k")))


_add("report_queue", lambda s, d: admission.report_queue(_reports(s, d)), f"WITH {SOCIAL} SELECT e AS target, pubkey AS reporter, 'spam ' || k AS reason FROM (SELECT *, row_number() OVER (PARTITION BY e ORDER BY lev_id DESC) AS n FROM social WHERE kind = 5 AND e IS NOT NULL) WHERE n = 1")
_add("policy_callable", lambda s, d: admission.apply_policy(plain_log(s, d), lambda e: admission.SHADOW if e["kind"] == 0 else admission.ACCEPT if e["kind"] == 1 else 1 / 0).select("lev_id", "action"), f"WITH {LOG} SELECT lev_id, CASE kind WHEN 0 THEN 'shadowReject' WHEN 1 THEN 'accept' ELSE 'reject' END AS action FROM log")


def _control(s: SparkSession, d: str) -> DataFrame:
    rows = s.read.parquet(f"{d}/events.parquet")
    method = F.when(F.col("event_type") == "view", "banpubkey").when(F.col("event_type") == "click", "unbanpubkey").otherwise("allowpubkey")
    return admission.fold_control(rows.select(F.col("event_id").alias("seq"), method.alias("method"), F.col("user_id").cast("string").alias("subject"), F.col("props").alias("reason")))


_add("control_fold", _control, "SELECT 'pubkey' AS thing, subject, CASE event_type WHEN 'view' THEN 'ban' ELSE 'allow' END AS state, props AS reason FROM (SELECT *, CAST(user_id AS VARCHAR) AS subject, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1 AND event_type <> 'click'")



def _odd(s: SparkSession, d: str) -> DataFrame:
    """Events with an expiration, protected ones, and vanish requests for another relay."""
    k = F.col("k").cast("int") % 5
    tags = F.when(k == 0, F.array(F.array(F.lit("expiration"), F.lit("1704500000")))).when(k == 1, F.array(F.array(F.lit("-")))).when(k == 2, F.array(F.array(F.lit("relay"), F.lit("wss://Elsewhere.example/")))).otherwise(F.col("tags"))
    return tagged_log(s, d).withColumn("tags", tags).withColumn("kind", F.when((F.col("kind") == 20001) & (k == 2), 62).otherwise(F.col("kind")))


_LONG = dict(newer=10**9, older=10**9, ephemeral_older=10**9)
_add("first_reject_odd", lambda s, d: admission.first_reason(_odd(s, d), admission.Policy(now=1_706_000_000, **_LONG, relays=("here.example",), reader=_author(3))).select("lev_id", "reason"), f"WITH {LOG} SELECT lev_id, CASE WHEN CAST(k AS INT) % 5 = 0 THEN 'event expired' WHEN CAST(k AS INT) % 5 = 2 AND kind = 20001 THEN 'vanish request for another relay' WHEN CAST(k AS INT) % 5 = 1 AND pubkey <> '{_author(3)}' THEN 'protected event' END AS reason FROM log")
_NO_CONTROL = lambda s: s.createDataFrame([], "seq bigint, method string, subject string, reason string")
_add("batch_vanish", lambda s, d: admission.judge_batch(social_log(s, d), admission.Policy(now=1_706_000_000, **_LONG, relays=()), _NO_CONTROL(s)).select("lev_id", "reason"), f"WITH {SOCIAL}, {_MARKS} SELECT lev_id, CASE WHEN kind <> 62 AND created_at <= vanished_at THEN 'author vanished' END AS reason FROM social LEFT JOIN mark USING (pubkey)")
_BANS = lambda s: s.createDataFrame([(1, "banpubkey", _author(2), "r"), (2, "banevent", _event(101), "r"), (3, "unbanpubkey", _author(2), ""), (4, "banpubkey", _author(5), "r")], "seq bigint, method string, subject string, reason string")
_add("batch_control", lambda s, d: admission.judge_batch(plain_log(s, d), admission.Policy(now=1_706_000_000, **_LONG, relays=()), _BANS(s)).select("lev_id", "reason"), f"WITH {LOG} SELECT lev_id, CASE WHEN id = '{_event(101)}' THEN 'event banned' WHEN pubkey = '{_author(5)}' THEN 'author banned' END AS reason FROM log")


def _role_log(s: SparkSession, d: str) -> DataFrame:
    """Views assign a role and clicks take it away; signups make the role curator and some errors delete it."""
    k = F.get_json_object("props", "$.k").cast("int")
    rows = s.read.parquet(f"{d}/events.parquet").withColumn("k", k).where("event_type in ('view', 'click', 'signup') or (event_type = 'error' and k = 7)")
    method = F.when(F.col("event_type") == "view", "assignrole").when(F.col("event_type") == "click", "unassignrole").when(F.col("event_type") == "signup", "putrole").otherwise("deleterole")
    role = F.when(~F.col("event_type").isin("view", "click"), "curator").when(F.col("k") % 3 == 0, "admin").when(F.col("k") % 3 == 1, "moderator").otherwise("curator")
    return rows.select(F.col("event_id").alias("seq"), method.alias("method"), F.col("user_id").cast("string").alias("subject"), role.alias("role"), F.lit("").alias("reason"))


_ROLES = """c AS (SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS pubkey, event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
a AS (SELECT pubkey, CASE k % 3 WHEN 0 THEN 'admin' WHEN 1 THEN 'moderator' ELSE 'curator' END AS role, max(seq) AS seq, arg_max(event_type, seq) AS t FROM c WHERE event_type IN ('view', 'click') GROUP BY 1, 2),
p AS (SELECT seq, event_type FROM c WHERE event_type = 'signup' OR (event_type = 'error' AND k = 7)),
held AS (SELECT pubkey, role FROM a WHERE t = 'view' AND (role <> 'curator' OR ((SELECT arg_max(p.event_type, p.seq) FROM p WHERE p.seq < a.seq) = 'signup' AND NOT EXISTS (SELECT 1 FROM p WHERE p.event_type = 'error' AND p.seq > a.seq))))"""
_add("role_assignments", lambda s, d: admission.fold_roles(admission.accepted_control(_role_log(s, d))), f"WITH {_ROLES} SELECT * FROM held")
_add("management_levels", lambda s, d: admission.management_levels(s.read.parquet(f"{d}/events.parquet").select(F.col("user_id").cast("string").alias("pubkey")).distinct(), admission.fold_roles(_role_log(s, d)), ("3",)), f"WITH {_ROLES} SELECT pubkey, CASE WHEN pubkey = '3' OR pubkey IN (SELECT pubkey FROM held WHERE role = 'admin') THEN 'admin' WHEN pubkey IN (SELECT pubkey FROM held WHERE role = 'moderator') THEN 'moderator' ELSE 'none' END AS level FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS pubkey FROM events)")
_add("answers", lambda s, d: admission.answers(plain_log(s, d).select("lev_id", F.when(F.col("kind") == 0, "replaced").when(F.col("kind") == 1, "written").when(F.col("kind") == 7, "deleted").otherwise("strange").alias("status"))), f"WITH {LOG} SELECT lev_id, CASE kind WHEN 0 THEN 'replaced' WHEN 1 THEN 'written' WHEN 7 THEN 'deleted' ELSE 'strange' END AS status, kind IN (0, 1) AS ok, CASE kind WHEN 0 THEN 'replaced: have newer event' WHEN 7 THEN 'blocked: event deleted' ELSE '' END AS message FROM log")

# -- maintenance
_drop = lambda s, d: maintain.expected_index(tagged_log(s, d)).where("lev_id % 100 != 7").unionByName(s.createDataFrame([("id", "gone", -1), ("kind", "9", -2)], "index_name string, key string, lev_id bigint"))
_add("integrity_missing", lambda s, d: maintain.check_integrity(tagged_log(s, d), _drop(s, d)).where("problem = 'missing'"), f"WITH {LOG}, m AS (SELECT * FROM log WHERE lev_id % 100 = 7) SELECT 'id' AS index_name, id AS key, lev_id, 'missing' AS problem FROM m UNION ALL SELECT 'pubkey', pubkey, lev_id, 'missing' FROM m UNION ALL SELECT 'kind', CAST(kind AS VARCHAR), lev_id, 'missing' FROM m UNION ALL SELECT 'created_at', CAST(created_at AS VARCHAR), lev_id, 'missing' FROM m UNION ALL SELECT 'tag', 't=' || k, lev_id, 'missing' FROM m UNION ALL SELECT 'tag', 't=' || u, lev_id, 'missing' FROM m UNION ALL SELECT 'tag', 'd=' || k, lev_id, 'missing' FROM m WHERE kind = 30023")
_add("integrity_extra", lambda s, d: maintain.check_integrity(tagged_log(s, d), _drop(s, d)).where("problem = 'extra'"), "SELECT 'id' AS index_name, 'gone' AS key, CAST(-1 AS BIGINT) AS lev_id, 'extra' AS problem UNION ALL SELECT 'kind', '9', -2, 'extra'")
_add("payload_stats", lambda s, d: maintain.payload_stats(source.documents_log(s, d)), "SELECT count(*) AS records, CAST(sum(strlen(text)) AS BIGINT) AS bytes, CAST(max(strlen(text)) AS INT) AS largest FROM documents")
_add("payload_join", lambda s, d: maintain.check_payloads(plain_log(s, d), plain_log(s, d).where("lev_id % 50 != 3").select("lev_id")), f"WITH {LOG} SELECT lev_id, 'no payload' AS problem FROM log WHERE lev_id % 50 = 3")
_LEVELS = ", ".join(f"l{i + 1} AS (SELECT k >> 13 AS k, sha256(string_agg(h, '' ORDER BY k, h)) AS h, sum(n) AS n FROM l{i} GROUP BY 1)" for i in range(5))
_add("log_digest", lambda s, d: maintain.log_digest(plain_log(s, d), "id"), f"WITH {LOG}, l0 AS (SELECT lev_id AS k, sha256(lev_id || ':' || strlen(id) || ':' || id) AS h, 1 AS n FROM log), {_LEVELS} SELECT CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(h, '' ORDER BY k, h)) AS digest FROM l5")
_HELD = lambda s, d: plain_log(s, d).where("lev_id % 50 != 3").select("lev_id", F.concat(F.lit("p"), "k").alias("payload"))
_add("payload_read", lambda s, d: maintain.with_payload(plain_log(s, d), _HELD(s, d)).select("lev_id", "payload"), f"WITH {LOG} SELECT lev_id, 'p' || k AS payload FROM log WHERE lev_id % 50 <> 3")
_add("integrity_totals", lambda s, d: maintain.integrity_totals(maintain.check_integrity(tagged_log(s, d), _drop(s, d))), f"""WITH {LOG}, m AS (SELECT * FROM log WHERE lev_id % 100 = 7)
SELECT 'id' AS index_name, count(*) AS missing, 1 AS extra FROM m UNION ALL SELECT 'pubkey', count(*), 0 FROM m UNION ALL SELECT 'kind', count(*), 1 FROM m UNION ALL SELECT 'created_at', count(*), 0 FROM m UNION ALL SELECT 'tag', CAST(sum(CASE WHEN kind = 30023 THEN 3 ELSE 2 END) AS BIGINT), 0 FROM m""")
_add("index_rebuilt", lambda s, d: maintain.check_integrity(tagged_log(s, d), maintain.rebuilt_index(tagged_log(s, d))).agg(F.count("*").alias("problems")), "SELECT CAST(0 AS BIGINT) AS problems")
_add("delete_by_search", lambda s, d: maintain.delete_matching(source.documents_log(s, d), parse_group([{"search": "license the"}, {"search": "zzzznotaword"}]))[0].select("lev_id"), f"WITH {WORDS} SELECT doc_id AS lev_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM term WHERE term IN ('license', 'the') GROUP BY doc_id HAVING count(*) = 2)")
_add("metrics_last_n", lambda s, d: query.latest_n(plain_log(s, d), 50, "lev_id").select(*COLUMNS), f"WITH {LOG} SELECT lev_id, created_at, kind FROM log ORDER BY lev_id DESC LIMIT 50")
_add("tree_list", lambda s, d: subscriptions.tree_counts(tagged_log(s, d), {"notes": parse_group([{"kinds": [1]}]), "u1": parse_group([{"#t": ["u1"]}])}), _fingerprint_sql("SELECT id, 'notes' AS tree FROM log WHERE kind = 1 UNION ALL SELECT id, 'u1' FROM log WHERE u = 'u1'", "tree"))
_add("second_log_latest", lambda s, d: query.keep_latest(_orders(s, d), ["pubkey", "kind"]).select("lev_id", "pubkey", "kind"), "SELECT o_orderkey AS lev_id, CAST(o_custkey AS VARCHAR) AS pubkey, o_orderpriority AS kind FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY epoch(o_orderdate) DESC, CAST(o_orderkey AS VARCHAR)) AS n FROM orders) WHERE n = 1")


def _orders(s: SparkSession, d: str) -> DataFrame:
    o = s.read.parquet(f"{d}/orders.parquet")
    return o.select(F.col("o_orderkey").alias("lev_id"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("created_at"), F.col("o_custkey").cast("string").alias("pubkey"), F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("kind"))


# -- codecs
def _addresses(s: SparkSession, d: str) -> DataFrame:
    kind, author, name = codec.address_parts(F.col("x"))
    author_text = F.when(F.col("lev_id") % 4 == 0, F.upper("pubkey")).otherwise(F.col("pubkey"))
    address = F.concat((F.col("lev_id") * 100).cast("string"), F.lit(":"), author_text, F.lit(":a:"), F.col("k"))
    return plain_log(s, d).select("lev_id", address.alias("x")).select("lev_id", kind.alias("kind"), author.alias("author"), name.alias("d"))


_OK = "lev_id * 100 <= 65535 AND regexp_matches(x, '^[0-9]+:[0-9a-f]{64}:')"
_add("address_parse", _addresses, f"WITH {LOG}, a AS (SELECT lev_id, k, pubkey, CAST(lev_id * 100 AS VARCHAR) || ':' || CASE WHEN lev_id % 4 = 0 THEN upper(pubkey) ELSE pubkey END || ':a:' || k AS x FROM log) SELECT lev_id, CASE WHEN {_OK} THEN lev_id * 100 END AS kind, CASE WHEN {_OK} THEN pubkey END AS author, CASE WHEN {_OK} THEN 'a:' || k END AS d FROM a")
_add("relay_urls", lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", codec.relay_url(F.concat(F.lit(" wss://"), F.upper("url"), F.lit("// "))).alias("relay")), "SELECT page_id, rtrim(lower(url), '/') AS relay FROM pages")
_add("npub", lambda s, d: plain_log(s, d).select("pubkey").distinct().select("pubkey", codec.npub_column("pubkey").alias("npub")).withColumn("back", codec.decode_npub_column("npub")))
_add("canonical_json", lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", codec.canonical_json_column("props").alias("text")), "SELECT event_id, '{\"k\":' || json_extract_string(props, '$.k') || '}' AS text FROM events")


def _ids(s: SparkSession, d: str) -> DataFrame:
    rows = plain_log(s, d).select("lev_id", F.to_json(F.struct("pubkey", "created_at", "kind", "tags", "content")).alias("x"))
    return rows.select("lev_id", codec.event_id_column("x").alias("event_hash"))


_add("event_id", lambda s, d: _ids(s, d), f"""WITH {LOG} SELECT lev_id, sha256('[0,"' || pubkey || '",' || created_at || ',' || kind || ',[' || CASE WHEN kind = 30023 THEN '["d","' || k || '"],' ELSE '' END || '["t","' || k || '"]],""]') AS event_hash FROM log""")

# -- streams
_STREAM = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def _as_log(rows: DataFrame) -> DataFrame:
    kind = F.coalesce(*[F.when(F.col("event_type") == n, k) for n, k in source.KINDS.items()])
    k = F.get_json_object("props", "$.k")
    return rows.select(F.col("event_id").alias("lev_id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("created_at"), F.sha2(F.col("user_id").cast("string"), 256).alias("pubkey"), F.sha2(F.concat(F.lit("e"), F.col("event_id").cast("string")), 256).alias("id"), kind.alias("kind"), F.array(F.struct(F.lit("t").alias("name"), k.alias("value"))).alias("idx_tags"), F.lit("").alias("content"))


def _run(s: SparkSession, frame: DataFrame, name: str) -> DataFrame:
    """The rows of a finished run of a stream, from a memory sink."""
    import uuid

    view = f"{name}_{uuid.uuid4().hex}"
    q = frame.writeStream.format("memory").queryName(view).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return s.table(view)


def _table_stream(s: SparkSession, d: str, name: str, schema: T.StructType) -> DataFrame:
    """A table as a stream, whether it is one file or a folder of files: a plain path must be a folder, a pattern may match either."""
    return s.readStream.schema(schema).parquet(f"{d}/{{{name}}}.parquet")


def _stream(s: SparkSession, d: str) -> DataFrame:
    return _as_log(_table_stream(s, d, "events", _STREAM))


_add("stream_match", lambda s, d: _run(s, live.live_matches(_stream(s, d), subscriptions.subscription_table(s, _SUBS[:1])), "matches"), f"WITH {LOG} SELECT CAST(1 AS BIGINT) AS conn, 'authors' AS sub, lev_id FROM log WHERE lev_id > 0 AND ({_MATCH['match_by_author'][1]})")


def _handed(s: SparkSession, d: str) -> DataFrame:
    filters = parse_group([{"kinds": [0], "limit": 500}])
    log = plain_log(s, d)
    history, later = live.hand_over(log, filters, 2000)
    return history.select("lev_id").union(_run(s, later(_stream(s, d)).select("lev_id"), "later"))


_add("stream_handoff", _handed, f"WITH {LOG} SELECT lev_id FROM log WHERE kind = 0 AND lev_id > 2000 UNION ALL SELECT lev_id FROM (SELECT lev_id FROM log WHERE kind = 0 AND lev_id <= 2000 ORDER BY created_at DESC, lev_id DESC LIMIT 500)")


def _searched_live(s: SparkSession, d: str) -> DataFrame:
    """A search handed over from history to a stream of the documents."""
    filters = parse_group([{"search": "license", "limit": 5}])
    log = source.documents_log(s, d)
    history, later = live.hand_over(log, filters, 100)
    stream = _table_stream(s, d, "documents", s.read.parquet(f"{d}/documents.parquet").schema)
    return history.select("lev_id").union(_run(s, later(source.as_documents_log(stream)).select("lev_id"), "found"))


_add("stream_search_handoff", _searched_live, f"WITH {WORDS} SELECT DISTINCT doc_id AS lev_id FROM word WHERE term = 'license' AND doc_id > 100 UNION ALL SELECT doc_id FROM (SELECT doc_id FROM term WHERE term = 'license' AND doc_id <= 100 ORDER BY doc_id DESC LIMIT 5)")
_add("token_bucket", lambda s, d: live.rate_limited_batch(plain_log(s, d).withColumn("at", F.col("created_at").cast("double")), "pubkey", 0.0001, 3))
_add("upload_feed", lambda s, d: live.to_upload(plain_log(s, d), plain_log(s, d).where("lev_id % 2 = 0"), 700).select(*COLUMNS), f"WITH {LOG} SELECT lev_id, created_at, kind FROM log WHERE lev_id > 700 AND lev_id % 2 <> 0")


def queries() -> dict:
    return dict(_QUERIES)


def oracle() -> dict:
    return dict(_SQL)
