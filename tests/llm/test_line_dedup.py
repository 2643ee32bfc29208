import pytest
from pyspark.sql import functions as F

from emberlog.llm.op4_line_dedup import brute_force, dedup_lines, drop_repeated_lines

DOCS = [
    (1, "a\nb\nc\nd"), (2, "x\nb\nc\nd\n\ne"), (None, "b. c. d! e"), (3, None), (4, ""), (5, "q\nq\nq\nq\nq\n"), (5, "q\nq\nq\nq\nq\n"), (6, "  \n \n"), (7, "One. Two. Three. four é."), (8, "z One. Two. Three. four é."),
    (9, "Start of it. One. Two. Three. four é. And on"), (10, "a\nb\nc\nd"), (5, "other\ntext\nhere\nq\nq\nq"), (11, "w " * 60_000 + "\nb\nc\nd"),
]


@pytest.mark.parametrize(("bound", "sentences"), [(1_000_000, True), (0, True), (1_000_000, False), (0, False)])
def test_brute_force(spark, bound, sentences):
    docs = spark.createDataFrame([(d, t, 1) for d, t in DOCS], "doc_id long, text string, n_lines int")
    rows = [tuple(r) for r in docs.select("doc_id", "text", F.xxhash64("text")).collect()]
    want = sorted(zip([str(d) for d, _, _ in rows], brute_force(rows, sentences=sentences), strict=True))
    got = sorted((str(r.doc_id), (r.n_lines, r.n_removed, r.text)) for r in dedup_lines(docs, sentences=sentences, broadcast_windows=bound).collect())
    assert got == want
    assert dedup_lines(docs.limit(0), broadcast_windows=bound).count() == 0


def test_stage(spark):
    docs = spark.createDataFrame([(d, t, "src", len(t or "")) for d, t in DOCS], "doc_id long, text string, source string, n_chars long")
    out = drop_repeated_lines(spark, docs, "")
    assert out.columns == docs.columns
    rows = {(r.doc_id, r.text): r.n_chars for r in out.collect()}
    assert (10, "") not in rows and (1, "a\nb\nc\nd") in rows and all(n == len(t) for (_, t), n in rows.items())


def test_stage_carries_columns(spark):
    docs = spark.createDataFrame([(d, t, -1, "x", None) for d, t in DOCS], "doc_id long, text string, n_removed int, h1 string, n_lines double")
    out = drop_repeated_lines(spark, docs, "")
    assert out.columns == docs.columns and {tuple(r)[2:] for r in out.collect()} == {(-1, "x", None)}
    assert drop_repeated_lines(spark, docs.limit(0), "").count() == 0
