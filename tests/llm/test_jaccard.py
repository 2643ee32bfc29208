import random

from emberlog.llm.components import components
from emberlog.llm.op9_jaccard_join import brute_force, near_duplicates, one_of_each, runs_for
from emberlog.llm.shared import Scratch


def corpus(seed=1, groups=12):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    shared = " ".join(rng.choices(vocabulary, k=60))
    docs, n = [], 0
    for g in range(groups):
        words = rng.choices(vocabulary, k=rng.randint(20, 300))
        for c in range(rng.choice([1, 1, 2, 5, 30])):
            own = list(words)
            for _ in range(c % 4):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            docs.append((n, " ".join(own) + (" " + shared if g % 2 else "")))
            n += 1
    return docs


def frame(spark, docs):
    return spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, n_links int")


def test_brute_force(spark):
    docs = corpus()
    want = brute_force(docs)
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_duplicates(frame(spark, docs)).collect()}
    assert got == want
    small = {r.doc_id: (r.class_id, r.n_links) for r in near_duplicates(frame(spark, docs), bucket=4, levels=1, tile=3, broadcast_rows=0).collect()}
    assert small == want


def test_hot_buckets(spark):
    """One passage in every text and one large group of near copies: nothing is lost however small the buckets are."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(2000)]
    passage, base = rng.choices(vocabulary, k=40), rng.choices(vocabulary, k=150)
    docs = []
    for n in range(150):
        own = list(base) if n < 60 else rng.choices(vocabulary, k=rng.randint(5, 60))
        if n < 60:
            for _ in range(n % 3):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
        docs.append((n, " ".join(passage + own)))
    docs += [(200 + d, t + " end") for d, t in docs[100:130]]
    want = brute_force(docs)
    for bucket, levels in ((16, 4), (8, 0), (64, 1)):
        got = {r.doc_id: (r.class_id, r.n_links) for r in near_duplicates(frame(spark, docs), bucket=bucket, levels=levels, tile=16, tile_bytes=1 << 14).collect()}
        assert got == want


def test_edge_cases(spark):
    docs = frame(spark, [(1, None), (2, ""), (3, "a b"), (4, "A, b!"), (5, "a b c d e f g"), (None, "a b c d e f g"), (5, "a b c d e f g"), (6, "?!")])
    got = sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in near_duplicates(docs).collect())
    assert got == [("1", "1", 0), ("2", "2", 0), ("3", "3", 1), ("4", "3", 1), ("5", "5", 2), ("5", "5", 2), ("6", "6", 0), ("None", "5", 2)]
    assert near_duplicates(docs.limit(0)).count() == 0
    kept = one_of_each(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 5, 6]


def test_very_long_texts(spark):
    rng = random.Random(3)
    words = [f"w{rng.randrange(50_000)}" for _ in range(60_000)]
    docs = [(1, " ".join(words)), (2, " ".join(words[:-500])), (3, " ".join(words[:20_000])), (4, " ".join(words[30_000:])), (5, "x" * 300_000)]
    assert {r.doc_id: (r.class_id, r.n_links) for r in near_duplicates(frame(spark, docs)).collect()} == {1: (1, 1), 2: (1, 1), 3: (3, 0), 4: (4, 0), 5: (5, 0)}


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", -1, "x", -2), (2, "a b c d e f", -3, "y", -4), (3, "other words stand here now", -5, "z", -6)], "doc_id long, text string, n_links int, h string, node int")
    assert sorted(tuple(r) for r in one_of_each(spark, docs, "").collect()) == [(1, "a b c d e f", -1, "x", -2), (3, "other words stand here now", -5, "z", -6)]


def test_runs():
    assert runs_for(0.9999) == 10 and runs_for(0.6) == 1


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (5, 5), (None, 1)]
    with Scratch(spark, "test") as scratch:
        got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a int, b int"), scratch).collect()}
        assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
        assert components(spark.createDataFrame([], "a int, b int"), scratch).count() == 0


def test_join_of_hot_keys_makes_only_matches(spark):
    """Rows without a partner are in no join's output, whatever the keys' type; hot, light, missing and null keys."""
    from pyspark.sql import functions as F

    from emberlog.llm.shared import join_hot

    keys = [1] * 5000 + [*range(2, 3000)] + [None] * 7
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i long")
    table = rows.where("k % 3 = 1").groupBy("k").agg(F.count("*").alias("n"))
    for key in (F.col("k"), F.struct("k"), F.col("k").cast("string").cast("binary")):
        out = join_hot(rows.withColumn("x", key), table.withColumn("x", key).drop("k"), "x", "n", len(keys))
        assert "LeftAnti" not in out._jdf.queryExecution().toString()
        assert sorted((r.k, r.i, r.n) for r in out.collect()) == sorted((k, i, 5000 if k == 1 else 1) for i, k in enumerate(keys) if k and k % 3 == 1)
