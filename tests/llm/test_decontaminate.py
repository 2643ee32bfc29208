import hashlib

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from emberlog.llm.op1_decontaminate import brute_force, digest, drop_leaking, find_leaks

ITEMS = [(1, "A b c d e f g h i j K l m"), (None, "short one"), (2, None), (3, "the " * 15), (4, "q"), (4, "z z z")]
DOCS = [(1, "a b c d e f g h i j k x a b c d e f g h i j k"), (2, None), (3, ""), (4, "short one here short one"), (5, "the " * 300), (6, "q " * 5), (None, "z, z; z"), (6, "q " * 5)]


def frames(spark, docs=DOCS, items=ITEMS):
    return spark.createDataFrame([(d, t, "x", 9) for d, t in docs], "doc_id long, text string, item_id string, n_words int"), spark.createDataFrame(items, "item_id long, text string")


def test_brute_force(spark):
    docs, items = frames(spark)
    for size in (1 << 24, 10):  # one block of items, and many
        got = sorted(str(tuple(r)[1:]) for r in digest(find_leaks(docs, items, item_block_bytes=size)).collect())
        assert got == sorted(str(brute_force(t, ITEMS)) for _, t in DOCS)


def test_phrase_of_many_items_at_many_places(spark, monkeypatch):
    """Pairs are made a few at a time; the result is the same."""
    from emberlog.llm import op1_decontaminate as op

    monkeypatch.setattr(op, "COMPARE_AT_ONCE", 7)
    phrase = "a b c d e f g h i j"
    items = [(i, f"{phrase} x{i}" if i % 2 else f"x{i} {phrase} end") for i in range(12)]
    texts = pa.array([f"{phrase} " * 9, f"start {phrase} x3 {phrase}", "none of it"])
    index = op.item_index([str(i) for i, _ in items], pa.array([t for _, t in items]), op.WINDOW, op.GRAM)
    schema = ["text", "n_words", "spans", "item_ids"]
    none = [pa.array([[]] * 3, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array([[]] * 3, pa.list_(pa.string()))]
    out = op._marked(pa.RecordBatch.from_arrays([texts, pa.array([0] * 3), *none], schema), index, op.WINDOW, op.GRAM).to_pylist()
    for t, r in zip(texts.to_pylist(), out, strict=True):
        n_words, n_hit, n_items, _, _ = brute_force(t, items)
        assert (r["n_words"], sum(x["end"] - x["start"] for x in r["spans"]), len(r["item_ids"])) == (n_words, n_hit, n_items)


def test_very_long_text(spark):
    docs, items = frames(spark, [(1, "x y " * 150_000 + "a b c d e f g h i j k")])
    assert [tuple(r)[1:] for r in digest(find_leaks(docs, items.where("item_id = 1"))).collect()] == [(300_011, 11, 1, hashlib.sha256(b"1").hexdigest(), True)]


def test_empty_tables(spark):
    docs, items = frames(spark)
    assert find_leaks(docs.limit(0), items).count() == 0
    assert digest(find_leaks(docs, items.limit(0))).where("contaminated or n_items > 0").count() == 0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=40), min_size=1, max_size=6), st.lists(st.lists(st.sampled_from("ab"), max_size=14), min_size=1, max_size=4))
def test_every_span_is_found(spark, docs, items):
    docs = [(i, " ".join(d)) for i, d in enumerate(docs)]
    items = [(i, " ".join(d)) for i, d in enumerate(items)]
    a, b = frames(spark, docs, items)
    got = {r.doc_id: tuple(r)[1:] for r in digest(find_leaks(a, b)).collect()}
    assert got == {d: brute_force(t, items) for d, t in docs}


def test_stage(spark, tmp_path):
    docs, items = frames(spark)
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = drop_leaking(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3]
    odd = docs.withColumn("spans", F.lit("mine"))
    assert {tuple(r)[2:] for r in drop_leaking(spark, odd, str(tmp_path)).collect()} == {("x", 9, "mine")}
