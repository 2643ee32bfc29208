"""Line dedup over overlapping three-line windows.

A line is a physical line; with ``sentences`` (which the query and the pipeline ask for) a sentence within one is a line too, so that
passages inside long lines count. Every three consecutive lines with text are hashed (128 bits); windows found more than
once keep their first occurrence, in order of document and place, and every line that a later occurrence covers is removed. The
first lines of a passage always stay somewhere: a removed line has an earlier equal one.

To find the windows only hashes and places shuffle, pre-aggregated, so a window that millions of documents share is one row for
each task. While the repeated windows are few enough they go to the documents, which then stay where they are. Beyond that
bound, occurrences shuffle again to meet the repeated windows, the documents' line numbers are gathered, and the texts shuffle
once to meet those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtext import blocks, gram_hashes, row_bounds, span_hashes
from .shared import carry, join_hot, stored, table

WIDTH = 3
#: Repeated windows (36 bytes each) that are sent to every task; more are joined.
BROADCAST_WINDOWS = 1_000_000
_NO_ID = -(1 << 63)

_STOP = np.zeros(256, bool)
_STOP[[0x21, 0x2E, 0x3F]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def cut_lines(data: np.ndarray, offsets: np.ndarray, sentences: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines with text of a block: start and end with what separates them, start and end without, and row."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    cut = np.zeros(n + 1, bool)
    cut[1:] = data == 0x0A
    if sentences:
        cut[2:n] |= _STOP[data[: n - 2]] & (data[1 : n - 1] == 0x20)
    cut[offsets] = True
    starts = np.flatnonzero(cut[:n])
    ends = np.append(starts[1:], n)
    full = np.flatnonzero(~_SPACE[data])
    first, after = np.searchsorted(full, starts), np.searchsorted(full, ends)
    some = first < after
    starts, ends, first, after = starts[some], ends[some], full[first[some]], full[after[some] - 1] + 1
    return starts, ends, first, after, np.searchsorted(offsets, starts, "right") - 1


def windows_of(data: np.ndarray, lines: tuple, n_rows: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes, row and number of the first line of every window of a block."""
    _, _, first, after, rows = lines
    bounds = row_bounds(rows, n_rows)
    one, two = (gram_hashes(span_hashes(data, first, after, second=s), width).view(np.int64) for s in (False, True))
    row = rows[: len(one)]
    inside = row == rows[len(rows) - len(one) :] if len(one) else np.zeros(0, bool)
    return one[inside], two[inside], row[inside], (np.arange(len(one)) - bounds[row])[inside]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))).withColumn("__h", F.xxhash64("text"))


def _windows(docs: DataFrame, width: int, sentences: bool) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for first, last, data, offsets in blocks(batch.column(0)):
                one, two, row, line = windows_of(data, cut_lines(data, offsets, sentences), last - first, width)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (one, two, ids[first + row], hashes[first + row], line.astype(np.int32))], ["h1", "h2", "id", "h", "line"])

    return docs.select("text", "__id", "__h").mapInArrow(each, "h1 bigint, h2 bigint, id bigint, h bigint, line int")


def _rewrite(batch: pa.RecordBatch, width: int, sentences: bool, covering) -> Iterator[pa.RecordBatch]:
    """The batch with text, n_lines and n_removed; covering(first, data, lines, n) gives row and first line of the windows to remove."""
    names = [n for n in batch.schema.names if n not in ("__id", "__h", "__lines")]
    for first, last, data, offsets in blocks(batch.column("text")):
        lines = cut_lines(data, offsets, sentences)
        rows, n = lines[4], last - first
        bounds = row_bounds(rows, n)
        row, line = covering(first, data, lines, n)
        gone = np.zeros(len(rows) + width, bool)
        for i in range(width):
            gone[bounds[row] + line + i] = True
        gone = gone[: len(rows)]
        change = np.zeros(len(data) + 1, np.int64)
        change[lines[0][gone]] += 1
        np.subtract.at(change, lines[1][gone], 1)
        stay = np.cumsum(change[:-1]) == 0
        left = np.concatenate([[0], np.cumsum(stay)])[offsets]
        text = pa.LargeStringArray.from_buffers(n, pa.py_buffer(left.astype(np.int64)), pa.py_buffer(data[stay].tobytes()))
        part = batch.slice(first, n)
        new = {"text": text.cast(batch.schema.field("text").type), "n_lines": pa.array(np.diff(bounds)), "n_removed": pa.array(np.bincount(rows[gone], minlength=n).astype(np.int64))}
        yield pa.RecordBatch.from_arrays([new.get(c, part.column(c) if c in names else None) for c in [*(x for x in names if x not in ("n_lines", "n_removed")), "n_lines", "n_removed"]], [*(x for x in names if x not in ("n_lines", "n_removed")), "n_lines", "n_removed"])


def dedup_lines(docs: DataFrame, width: int = WIDTH, sentences: bool = False, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """``docs`` (doc_id, text) with the lines of repeated windows removed from text, and n_lines and n_removed added.

    Every row stays, its text maybe empty. Null and empty texts come out empty with 0 lines; texts of fewer than ``width`` lines are
    untouched. Order is by doc_id, null first, then by the text's hash, then by place; rows that repeat in both doc_id and text
    count as one document and are treated alike. Other columns pass through; columns named n_lines or n_removed are replaced.
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    keyed = _keyed(docs.select(*kept))
    schema = T.StructType([*docs.select(*kept).schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])
    found = _windows(keyed, width, sentences)
    grouped = found.groupBy("h1", "h2").agg(F.min(F.struct("id", "h", "line")).alias("first"), F.max(F.struct("id", "h", "line")).alias("last"), F.count("*").alias("n"))
    repeated = stored(grouped.where("first != last").select("h1", "h2", "first.*", "n"), "windows")
    if repeated.count() <= broadcast_windows:
        columns = ["h1", "h2", "id", "h", "line"]
        known = {c: v.to_numpy() for c, v in zip(columns, repeated.select(*columns).toArrow().columns, strict=True)}
        order = np.argsort(known["h1"], kind="stable")
        known = spark.sparkContext.broadcast({c: v[order] for c, v in known.items()})

        def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = known.value
            for batch in batches:
                ids, hashes = batch.column("__id").to_numpy(), batch.column("__h").to_numpy()

                def covering(first, data, lines, n, ids=ids, hashes=hashes):
                    one, two, row, line = windows_of(data, lines, n, width)
                    at = np.searchsorted(seen["h1"], one)
                    later = np.zeros(len(one), bool)
                    left = np.flatnonzero(at < len(seen["h1"]))
                    while len(left):  # more than one turn only where 64-bit hashes agree by chance
                        left = left[seen["h1"][at[left]] == one[left]]
                        k = at[left]
                        same = seen["h2"][k] == two[left]
                        whole = left[same]
                        k = k[same]
                        later[whole] = (seen["id"][k] != ids[first + row[whole]]) | (seen["h"][k] != hashes[first + row[whole]]) | (seen["line"][k] != line[whole])
                        left = left[~same]
                        at[left] += 1
                        left = left[at[left] < len(seen["h1"])]
                    return row[later], line[later]

                yield from _rewrite(batch, width, sentences, covering)

        return keyed.mapInArrow(remove, schema)

    # A window of very many documents is broadcast, so that its occurrences are not one task's.
    known = repeated.select(F.struct("h1", "h2").alias("w"), F.col("id").alias("id0"), F.col("h").alias("h0"), F.col("line").alias("line0"), "n")
    total = known.agg(F.sum("n")).first()[0] or 0
    later = join_hot(found.withColumn("w", F.struct("h1", "h2")), known, "w", "n", total).where("id != id0 or h != h0 or line != line0")
    lines = later.groupBy(F.col("id").alias("__id"), F.col("h").alias("__h")).agg(F.collect_set("line").alias("__lines"))

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("__lines")

            def covering(first, data, lines, n, column=column):
                own = column.slice(first, n)
                sizes = np.array([len(x) if x is not None else 0 for x in own.to_pylist()], np.int64)
                return np.repeat(np.arange(n), sizes), own.flatten().to_numpy(zero_copy_only=False).astype(np.int64)

            yield from _rewrite(batch, width, sentences, covering)

    return keyed.join(lines, ["__id", "__h"], "left").select(*kept, "__lines").mapInArrow(rewrite, schema)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, sentences=True).select("doc_id", "n_lines", "n_removed", "text")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts without later occurrences of windows; a document that loses all its lines goes.

    n_chars, where there is such a column, follows the text. Null and empty texts stay (a null becomes empty); repeated rows are
    treated alike; all other columns pass through, whatever their names; an empty table gives none.
    """
    rows, back = carry(docs, ["doc_id", "text"])
    out = dedup_lines(rows, sentences=True).where("n_removed = 0 or n_removed < n_lines")
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("__carried", F.when(F.col("n_removed") > 0, F.col("__carried").withField("n_chars", F.char_length("text").cast(kind))).otherwise(F.col("__carried")))
    return back(out)


def brute_force(docs: list[tuple], width: int = WIDTH, sentences: bool = True) -> list[tuple[int, int, str]]:
    """(n_lines, n_removed, text) of each (doc_id, text, hash of text), by dictionaries; for tests."""
    import re

    def units(text):
        parts = re.findall(r"[^\n]*?(?:\n|[.!?] |$)" if sentences else r"[^\n]*?(?:\n|$)", text or "")
        return [p for p in parts if p]

    order = sorted({(d is not None, d or 0, h, t or "") for d, t, h in docs})
    first = {}
    for some, d, h, t in order:
        own = [u.strip(" \t\n\v\f\r") for u in units(t) if u.strip(" \t\n\v\f\r")]
        for i in range(len(own) - width + 1):
            first.setdefault(tuple(own[i : i + width]), (some, d, h, i))
    out = []
    for d, t, h in docs:
        parts = units(t)
        full = [i for i, u in enumerate(parts) if u.strip(" \t\n\v\f\r")]
        own = [parts[i].strip(" \t\n\v\f\r") for i in full]
        gone = {j for i in range(len(own) - width + 1) if first[tuple(own[i : i + width])] != (d is not None, d or 0, h, i) for j in full[i : i + width]}
        out.append((len(own), len(gone), "".join(p for i, p in enumerate(parts) if i not in gone)))
    return out


#: The same rows where doc_ids are distinct.
SQL = """
WITH u AS (SELECT doc_id, i, unit, trim(unit, E' \\t\\n\\x0B\\f\\r') AS line
           FROM (SELECT doc_id, unnest(generate_series(1, len(p))) AS i, unnest(p) AS unit FROM (SELECT doc_id, regexp_extract_all(text, '[^\\n]*?(?:\\n|[.!?] |$)') AS p FROM documents))
           WHERE unit <> ''),
l AS (SELECT doc_id, i, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM u WHERE line <> ''),
w AS (SELECT a.doc_id, a.n, a.line || chr(10) || b.line || chr(10) || c.line AS g FROM l a JOIN l b ON a.doc_id = b.doc_id AND b.n = a.n + 1 JOIN l c ON a.doc_id = c.doc_id AND c.n = a.n + 2),
later AS (SELECT doc_id, n FROM (SELECT doc_id, n, row_number() OVER (PARTITION BY g ORDER BY doc_id, n) AS k FROM w) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, n FROM (SELECT doc_id, unnest(generate_series(n, n + 2)) AS n FROM later)),
x AS (SELECT l.doc_id, l.i FROM l JOIN gone ON l.doc_id = gone.doc_id AND l.n = gone.n),
kept AS (SELECT u.doc_id, string_agg(u.unit, '' ORDER BY u.i) AS text FROM u LEFT JOIN x ON u.doc_id = x.doc_id AND u.i = x.i WHERE x.i IS NULL GROUP BY u.doc_id),
counts AS (SELECT doc_id, count(*) AS n FROM l GROUP BY doc_id),
removed AS (SELECT doc_id, count(*) AS n FROM x GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_removed, coalesce(k.text, '') AS text
FROM documents d LEFT JOIN counts c ON d.doc_id = c.doc_id LEFT JOIN removed r ON d.doc_id = r.doc_id LEFT JOIN kept k ON d.doc_id = k.doc_id
"""

QUERIES = {"op4_line_dedup": op4_line_dedup}
ORACLE = {"op4_line_dedup": SQL}
