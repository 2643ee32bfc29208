"""Benchmark decontamination by winnowing.

Both sides are cut into words, every ``gram`` consecutive words are hashed, and of each run of ``window - gram + 1``
hashes the smallest are fingerprints, so any shared span of ``window`` words has a shared fingerprint. The benchmark's
fingerprints travel to the documents, matches are extended word by word along their diagonal, and runs of at least
``window`` words count. A benchmark beyond one block of bounded size takes a scan of the documents for each further block, which
writes its hits only; these come back to the texts by the texts' hash. Documents' fingerprints never leave the task, and while the
hits of further blocks fit a broadcast, documents are never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtext import ALNUM, blocks, gram_hashes, row_bounds, span_hashes, spans, strings
from .shared import carry, stored, table

WINDOW, GRAM = 10, 6
#: Bytes of benchmark text in one broadcast block; larger benchmarks take several scans of the documents.
ITEM_BLOCK_BYTES = 16 << 20
#: Word comparisons held in memory at once while hits are extended.
COMPARE_AT_ONCE = 1 << 20
#: Texts with hits in further blocks that are broadcast; more are joined.
BROADCAST_ROWS = 100_000

ADDED = "n_words bigint, spans array<struct<start:int,end:int>>, item_ids array<string>"


def winnowed(grams: np.ndarray, bounds: np.ndarray, size: int, width: int) -> np.ndarray:
    """Places of the grams that are smallest in some run of ``width`` within one row; bounds are the rows' word edges."""
    n = len(grams) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least = grams[:n].copy()
    for i in range(1, width):
        np.minimum(least, grams[i : i + n], out=least)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    whole = row[:n] == row[np.arange(n) + width - 1 + size - 1]
    chosen = np.zeros(len(grams), bool)
    for i in range(width):
        chosen[i : i + n] |= whole & (grams[i : i + n] == least)
    return np.flatnonzero(chosen)


def item_index(ids: list[str], texts: pa.Array, window: int, gram: int) -> dict:
    """Word hashes of the items and, sorted, their fingerprints: winnowed grams of long items, whole short items."""
    data, offsets = strings(texts)
    starts, ends, rows = spans(data, offsets, ALNUM)
    words = span_hashes(data, starts, ends, fold=True)
    bounds = row_bounds(rows, len(ids))
    hashes, item, place, size = [], [], [], []
    for i in range(len(ids)):
        own = words[bounds[i] : bounds[i + 1]]
        n = min(len(own), window)
        if not n:
            continue
        k = gram if n == window else n
        grams = gram_hashes(own, k)
        at = winnowed(grams, np.array([0, len(own)]), gram, window - gram + 1) if n == window else np.zeros(1, np.int64)
        hashes.append(grams[at])
        item.append(np.full(len(at), i))
        place.append(at)
        size.append(np.full(len(at), k))
    joined = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
    hashes, item, place, size = joined(hashes, np.uint64), joined(item, np.int64), joined(place, np.int64), joined(size, np.int64)
    short = {int(k): np.flatnonzero((size == k) & (np.diff(bounds)[item] < window)) for k in np.unique(size[np.diff(bounds)[item] < window])}
    sets = {0: np.flatnonzero(np.diff(bounds)[item] >= window)} | short
    tables = {k: at[np.argsort(hashes[at], kind="stable")] for k, at in sets.items() if len(at)}
    return {"ids": ids, "words": words, "bounds": bounds, "tables": {k: (hashes[at], item[at], place[at]) for k, at in tables.items()}}


def _flat(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges of these lengths: the range of every element, and its place in it."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def block_hits(words: np.ndarray, bounds: np.ndarray, index: dict, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hits of one block of rows: start and end among its words, row and item of each."""
    out = [np.zeros((4, 0), np.int64)]
    for k, (hashes, items, places) in index["tables"].items():
        size = k or gram
        grams = gram_hashes(words, size)
        if not len(grams):
            continue
        at = np.arange(len(grams)) if k else winnowed(grams, bounds, size, window - gram + 1)
        left = np.searchsorted(hashes, grams[at], "left")
        many = np.searchsorted(hashes, grams[at], "right") - left
        hit = np.flatnonzero(many)
        # A phrase of many items at many places: its pairs are made and extended a part at a time.
        for part in _parts(many[hit]):
            some = hit[part]
            owner, step = _flat(many[some])
            entry, where = left[some][owner] + step, at[some][owner]
            rows = np.searchsorted(bounds, where, "right") - 1
            inside = where + size <= bounds[rows + 1]
            found = np.unique(np.stack([rows, items[entry], where - places[entry]])[:, inside], axis=1)
            out.append(_extended(words, bounds, index, found, window))
    return tuple(np.concatenate(out, axis=1))


def _parts(sizes: np.ndarray) -> Iterator[slice]:
    """Runs of entries whose sizes add up to about COMPARE_AT_ONCE."""
    sums, at = np.cumsum(sizes), 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + COMPARE_AT_ONCE, "right")))
        yield slice(at, end)
        at = end


def _extended(words: np.ndarray, bounds: np.ndarray, index: dict, found: np.ndarray, window: int) -> np.ndarray:
    """The runs of at least ``window`` equal words (fewer for short items) on each (row, item, diagonal)."""
    rows, items, diagonals = found
    item_from, item_to = index["bounds"][items], index["bounds"][items + 1]
    low, high = np.maximum(bounds[rows], diagonals), np.minimum(bounds[rows + 1], diagonals + item_to - item_from)
    need = np.minimum(window, item_to - item_from)
    out = [np.zeros((4, 0), np.int64)]
    for part in _parts(high - low):
        owner, step = _flat((high - low)[part])
        owner += part.start
        place = low[owner] + step
        equal = words[place] == index["words"][place - diagonals[owner] + item_from[owner]]
        edge = np.flatnonzero(np.diff(np.concatenate([[-1], np.where(equal, owner, -1), [-1]])))
        begin, stop = edge[:-1], edge[1:]
        run = equal[begin] if len(begin) else np.zeros(0, bool)
        begin, stop = begin[run], stop[run]
        good = stop - begin >= need[owner[begin]]
        begin, stop = begin[good], stop[good]
        out.append(np.stack([place[begin], place[stop - 1] + 1, rows[owner[begin]], items[owner[begin]]]))
    return np.concatenate(out, axis=1)


def find_leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM, item_block_bytes: int = ITEM_BLOCK_BYTES) -> DataFrame:
    """Add n_words, spans (merged word ranges that some item's window covers) and item_ids (sorted strings) to ``docs``.

    ``docs`` has text, ``items`` item_id and text. Items of fewer than ``window`` words count as a whole. Null and empty texts have
    no words and no hits; items without words never hit; a null item_id reads as ``null``; items with the same id count once.
    Rows that repeat stay as many rows; columns of ``docs`` named like the results are replaced. Other columns pass through.
    Texts of any length are taken whole; empty tables give no rows (documents) or no hits (items).
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c not in ("n_words", "spans", "item_ids")]
    schema = T.StructType(docs.select(*kept).schema.fields + T._parse_datatype_string(ADDED).fields)
    items = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-total // item_block_bytes))
    none = [F.lit(0).cast("long").alias("n_words"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"), F.array().cast("array<string>").alias("item_ids")]

    def block(b: int):
        part = items if n_blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == b)
        rows = part.toArrow()
        return spark.sparkContext.broadcast(item_index(rows.column("item_id").to_pylist(), rows.column("text").combine_chunks(), window, gram))

    def mark(batches: Iterator[pa.RecordBatch], index) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _marked(batch, index.value, window, gram)

    rows = docs.select(*kept, *none)
    if n_blocks > 1:
        rows = docs.select(*kept).withColumn("__key", F.md5("text"))
        found = reduce(DataFrame.unionByName, [_hits(docs, block(b), mark) for b in range(1, n_blocks)])
        merged = stored(found.groupBy("__key").agg(F.flatten(F.collect_list("spans")).alias("__spans"), F.flatten(F.collect_list("item_ids")).alias("__items")), "leaks")  # a row for each block at the most
        rows = rows.join(F.broadcast(merged) if merged.count() <= BROADCAST_ROWS else merged, "__key", "left")
        rows = rows.select(*kept, none[0], F.coalesce("__spans", none[1]).alias("spans"), F.coalesce("__items", none[2]).alias("item_ids"))
    index = block(0)
    return rows.mapInArrow(lambda batches: mark(batches, index), schema)


def _hits(docs: DataFrame, index, mark) -> DataFrame:
    """__key (the text's MD5), spans and item_ids of the texts that a block of items hits, once for equal texts, written."""
    schema = T.StructType(T._parse_datatype_string("text string, __key string").fields + T._parse_datatype_string(ADDED).fields)
    rows = docs.where("text is not null").select("text", F.md5("text").alias("__key"), F.lit(0).cast("long").alias("n_words"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"), F.array().cast("array<string>").alias("item_ids"))
    found = rows.mapInArrow(lambda batches: mark(batches, index), schema).where(F.size("spans") > 0).select("__key", "spans", "item_ids")
    out = stored(found.dropDuplicates(["__key"]), "hits")
    index.unpersist()
    return out


def _marked(batch: pa.RecordBatch, index: dict, window: int, gram: int) -> pa.RecordBatch:
    before, names = batch.column("spans"), batch.column("item_ids").to_pylist()
    counts, starts, ends, sizes = [], [], [], []
    for first, last, data, offsets in blocks(batch.column("text")):
        begin, stop, rows = spans(data, offsets, ALNUM)
        words = span_hashes(data, begin, stop, fold=True)
        bounds = row_bounds(rows, last - first)
        counts.append(np.diff(bounds))
        lows, highs, at, items = block_hits(words, bounds, index, window, gram)
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, lows, 1)
        np.add.at(change, highs, -1)
        old = before.slice(first, last - first)
        if len(flat := old.flatten()):
            base = np.repeat(bounds[:-1], np.diff(np.frombuffer(old.buffers()[1], np.int32)[old.offset : old.offset + len(old) + 1]))
            np.add.at(change, base + flat.field("start").to_numpy(), 1)
            np.add.at(change, base + flat.field("end").to_numpy(), -1)
        covered = np.concatenate([[False], np.cumsum(change[:-1]) > 0, [False]])
        edge = covered[1:] != covered[:-1]
        cut = bounds[1:-1]
        cut = np.unique(cut[(cut > 0) & (cut < len(words))])
        cut = cut[covered[cut] & covered[cut + 1]]
        marks = np.sort(np.concatenate([np.flatnonzero(edge), cut, cut]))
        low, high = marks[0::2], marks[1::2]
        row = np.searchsorted(bounds, low, "right") - 1
        starts.append(low - bounds[row])
        ends.append(high - bounds[row])
        sizes.append(np.bincount(row, minlength=last - first))
        for r, i in zip(*np.unique(np.stack([at, items]), axis=1), strict=True) if len(at) else ():
            names[first + r].append(index["ids"][i])
    names = [sorted(set(x)) if x else [] for x in names]
    joined = lambda parts, kind: pa.array(np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind))
    each = np.concatenate([[0], np.cumsum(np.concatenate(sizes) if sizes else [])]).astype(np.int32)
    covered = pa.ListArray.from_arrays(pa.array(each), pa.StructArray.from_arrays([joined(starts, np.int32), joined(ends, np.int32)], ["start", "end"]))
    values = {"n_words": joined(counts, np.int64), "spans": covered, "item_ids": pa.array(names, pa.list_(pa.string()))}
    return pa.RecordBatch.from_arrays([values.get(n, batch.column(i)) for i, n in enumerate(batch.schema.names)], batch.schema.names)


def digest(leaks: DataFrame) -> DataFrame:
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + (x["end"] - x["start"]))
    return leaks.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digest(find_leaks(docs, table(spark, sf_dir, "benchmark")).drop("text"))


def drop_leaking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents without any benchmark window; null and empty texts stay, as nothing hits them.

    Repeated rows are judged alike; all columns of ``docs`` pass through, whatever their names; an empty table gives none.
    """
    rows, back = carry(docs, ["text"])
    return back(find_leaks(rows, table(spark, sf_dir, "benchmark")).where(F.size("spans") == 0))


def brute_force(text: str | None, items: list[tuple[object, str | None]], window: int = WINDOW) -> tuple:
    """(n_words, n_hit, n_items, items_sha256, contaminated) of one text, by trying every place; for tests."""
    import re

    def cut(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    words, hit, names = cut(text), set(), set()
    for name, t in items:
        own = cut(t)
        n = min(window, len(own))
        for j in range(len(own) - n + 1 if n else 0):
            for i in range(len(words) - n + 1):
                if words[i : i + n] == own[j : j + n]:
                    hit.update(range(i, i + n))
                    names.add("null" if name is None else str(name))
    return len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

#: The same rows by joining every window's text.
SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[j:j + n - 1], ' ') AS g
       FROM (SELECT item_id, w, least({WINDOW}, len(w)) AS n, unnest(generate_series(1, len(w) - least({WINDOW}, len(w)) + 1)) AS j FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, j, array_to_string(w[j:j + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS j FROM d JOIN (SELECT DISTINCT n FROM iw) ON len(w) >= n)),
hit AS (SELECT dw.doc_id, dw.n, dw.j, iw.item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.g = iw.g),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(j, j + n - 1)) AS p FROM hit) GROUP BY doc_id),
item AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover ON d.doc_id = cover.doc_id LEFT JOIN item ON d.doc_id = item.doc_id
"""

QUERIES = {"op1_decontaminate": op1_decontaminate}
ORACLE = {"op1_decontaminate": SQL}
