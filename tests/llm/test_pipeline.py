"""The pipeline on the smallest documents: stages chain, and each does to its input what its operator says."""

import os

import pytest

pipeline = pytest.importorskip("corpus_pipeline")
FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_stages(spark):
    from emberlog.llm import op1_decontaminate, op4_line_dedup, op9_jaccard_join
    from emberlog.llm.shared import stored, table
    from pyspark.sql import functions as F

    docs = table(spark, FOLDER, "documents")
    columns, steps = docs.columns, [docs]
    for _, stage in pipeline.STAGES[:-1]:
        steps.append(stored(stage(spark, steps[-1], FOLDER), "step"))
        assert steps[-1].columns == columns
    texts = [{r.doc_id: r.text for r in s.collect()} for s in steps]
    assert len(texts[0]) > len(texts[1]) > len(texts[2]) and set(texts[4]) <= set(texts[3]) <= set(texts[2])
    rows = [tuple(r) for r in steps[1].select("doc_id", "text", F.xxhash64("text")).collect()]
    lines = {d: x for (d, _, _), x in zip(rows, op4_line_dedup.brute_force(rows), strict=True)}
    assert texts[2] == {d: t for d, (n, gone, t) in lines.items() if not n or gone < n}
    classes = op9_jaccard_join.brute_force(list(texts[2].items()))
    assert set(texts[3]) == {d for d, (c, _) in classes.items() if c == d}
    items = [tuple(r) for r in table(spark, FOLDER, "benchmark").select("item_id", "text").collect()]
    sample = list(texts[3].items())
    assert set(texts[4]) == {d for d, t in sample if not op1_decontaminate.brute_force(t, items)[4]}
    packed = pipeline.STAGES[-1][1](spark, steps[-1], FOLDER)
    assert {r.doc_id for r in packed.collect()} == set(texts[4])
    assert pipeline.run(spark, FOLDER).count() == packed.count()


def test_edge_cases(spark, tmp_path):
    """Null and empty texts, repeated rows, an empty table and columns named like the operators' own."""
    good = spark.read.parquet(f"{FOLDER}/documents.parquet").where("length(text) > 300")
    odd = good.limit(30).union(good.limit(30)).union(good.limit(2).selectExpr("doc_id + 100000", "cast(null as string)", "lang", "source", "n_chars"))
    odd = odd.union(good.limit(2).selectExpr("cast(null as bigint)", "''", "cast(null as string)", "source", "n_chars")).selectExpr("*", "'mine' as kept", "-7 as n_words", "-8 as n_removed", "'x' as class_key")
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{FOLDER}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    step = docs
    for _, stage in pipeline.STAGES[:-1]:
        step = stage(spark, step, str(tmp_path))
        assert step.columns == docs.columns
    rows = step.collect()
    assert {(r.kept, r.n_words, r.n_removed, r.class_key) for r in rows} == {("mine", -7, -8, "x")} and len({r.doc_id for r in rows}) == len(rows) <= 30
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
