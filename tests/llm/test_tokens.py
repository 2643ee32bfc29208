"""Packing, token counts and shards against the library."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs
import pytest

from emberlog.llm import op5_packing, op6_token_counts, op7_sstable
from emberlog.llm.arrowtext import blocks, span_hashes
from emberlog.llm.tokencache import CachedTokenizer, HashTable

DOCS = [(3, "Hello world, it's 12 o'clock"), (1, None), (2, ""), (None, "null id"), (2, "same id"), (2, "same id"), (7, "é 日本 <|endoftext|> x"), (9, "long text goes on " * 3000), (-5, "minus")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, 1, 2) for d, t in DOCS], "doc_id long, text string, n_tokens int, start int")


def ids_of(file):
    own = CachedTokenizer(public_tokenizers.path(file), "byte", 1)
    return lambda t: own.library.encode(t or "", add_special_tokens=False).ids


def test_counts(spark, docs):
    ids = ids_of(op6_token_counts.FILE)
    got = sorted((str(r.doc_id), r.text or "", r.n_bytes, r.n_tokens, r.over_limit) for r in op6_token_counts.count_tokens(docs, public_tokenizers.path(op6_token_counts.FILE)).collect())
    assert got == sorted((str(d), t or "", len((t or "").encode()), n := len(ids(t)), n > 512) for d, t in DOCS)
    assert op6_token_counts.count_tokens(docs.limit(0), public_tokenizers.path(op6_token_counts.FILE)).count() == 0


def block_counts(own, texts):
    """op6's counts of texts by one worker's table, without a first tier, and the library's."""
    got = [c for block in blocks(pa.array(texts)) for c in op6_token_counts._block_counts(own, HashTable(1), *block)]
    return got, [len(own.library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_counts_after_a_full_table():
    """A table that starts anew, or grows for one text, changes no count."""
    own, rng = CachedTokenizer(public_tokenizers.path(op6_token_counts.FILE), "byte", 50), np.random.default_rng(5)
    for words in [*rng.integers(1, 30, 60).tolist(), 200, 20, 20, 300]:
        got, want = block_counts(own, [" ".join("".join(rng.choice(list("qxzjkvw9"), rng.integers(3, 9))) for _ in range(words))])
        assert got == want


def test_counts_of_pretokens_with_equal_hashes():
    """Swapped letters of a Thue-Morse word: a polynomial modulo 2^64 has one value for both."""
    turns = [i.bit_count() & 1 for i in range(1024)]
    texts = ["".join("ae"[i ^ j] for i in turns) for j in (0, 1)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    assert len(set(span_hashes(data, np.array([0, 1024]), np.array([1024, 2048])).tolist())) == 1
    got, want = block_counts(CachedTokenizer(public_tokenizers.path(op6_token_counts.FILE), "byte", 50), texts)
    assert got == want and want[0] != want[1]


def test_shards(spark, docs, tmp_path):
    ids = ids_of(op7_sstable.FILE)
    manifest = op7_sstable.write_shards(docs, f"file://{tmp_path}/sst", public_tokenizers.path(op7_sstable.FILE), shards=3)
    got = op7_sstable.read_shards(spark, manifest).orderBy("start").collect()
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in got]
    assert order == [None, -5, 1, 2, 2, 2, 3, 7, 9]
    want = sorted((str(d), zlib.crc32(np.array([*ids(t), 2], "<u4").tobytes())) for d, t in DOCS)
    assert sorted((str(r.doc_id), r.ids_crc32) for r in got) == want
    found = {}
    for m in manifest:
        with pyarrow.fs.LocalFileSystem().open_input_file(m.path.removeprefix("file://")) as f:
            reader = op7_sstable.ShardReader(f)
            for d in (None, -5, 2, 9, 100):
                found.setdefault(d, []).extend(x.tolist() for x in reader.get(d))
    assert found[100] == [] and found[None] == [[*ids("null id"), 2]] and len(found[2]) == 3 and found[9] == [[*ids(DOCS[7][1]), 2]]
    empty = op7_sstable.write_shards(docs.limit(0), f"file://{tmp_path}/none", public_tokenizers.path(op7_sstable.FILE), shards=3)
    assert empty == [] and op7_sstable.read_shards(spark, empty).count() == 0


def test_shard_blocks(tmp_path):
    """Many small documents in several blocks: all are found, and only those."""
    fs = pyarrow.fs.LocalFileSystem()
    with fs.open_output_stream(f"{tmp_path}/a.sst") as sink:
        writer = op7_sstable.ShardWriter(sink, 2)
        for i in range(0, 20_000, 2):
            writer.add(op7_sstable.key_of(i), np.full(i % 50, i % 1000, np.uint32))
        writer.close()
    with fs.open_input_file(f"{tmp_path}/a.sst") as source:
        reader = op7_sstable.ShardReader(source)
        assert len(reader.blocks) > 3 and reader.docs == 10_000 and [len(reader.get(i)) for i in (0, 1, 2, 7777, 19_998, 19_999)] == [1, 0, 1, 0, 1, 0]
        assert all(reader.get(i)[0].tolist() == [i % 1000] * (i % 50) for i in range(0, 20_000, 998))
    (tmp_path / "b.sst").write_bytes((tmp_path / "a.sst").read_bytes()[:-60] + b"x" * 60)
    with fs.open_input_file(f"{tmp_path}/b.sst") as source, pytest.raises(ValueError):
        op7_sstable.ShardReader(source)


def test_packing(spark, docs):
    own = CachedTokenizer(public_tokenizers.path(op5_packing.FILE), "word")
    full = lambda t: [*own.library.encode(t or "", add_special_tokens=False).ids, 1]
    out = op5_packing.pack(docs, public_tokenizers.path(op5_packing.FILE), capacity=100).collect()
    texts = {}
    for d, t in DOCS:
        texts.setdefault(d, []).append(full(t))
    places = {}
    for r in out:
        assert r.start == 100 * r.piece and any(zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for x in texts[r.doc_id])
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own_places in places.values():
        at = 0
        for offset, length in sorted(own_places):
            assert offset == at
            at += length
        assert at <= 100
    total = sum(len(x) for xs in texts.values() for x in xs)
    assert sum(r.length for r in out) == total and len(places) <= -(-total // 100) + 1
    assert op5_packing.pack(docs.limit(0), public_tokenizers.path(op5_packing.FILE)).count() == 0


def test_plan_is_best_fit_decreasing():
    rng = np.random.default_rng(3)
    for _ in range(40):
        lengths = sorted(rng.integers(1, 40, rng.integers(1, 80)).tolist(), reverse=True)
        rooms = []
        for n in lengths:  # one by one
            fit = [r for r in rooms if r >= n]
            if fit:
                rooms.remove(min(fit))
            rooms.append((min(fit) if fit else 50) - n)
        counts = {n: lengths.count(n) for n in set(lengths)}
        plan, made = op5_packing.plan_best_fit(counts, 50)
        assert made == len(rooms)
        filled = np.zeros(made, int)
        for length, _, first, n, each, offset in plan.tolist():
            assert (filled[first : first + n] == offset).all()
            filled[first : first + n] += length * each
        assert sorted(50 - filled) == sorted(rooms) and sum(p[3] * p[4] for p in plan.tolist()) == len(lengths)


def test_store_names():
    """The names that clusters give to stores are understood, without reaching them."""
    for name in ("s3a://bucket/folder", "s3n://bucket/folder"):
        store, place = op7_sstable._filesystem(f"{name}?region=us-east-1")
        assert store.type_name == "s3" and place == "bucket/folder"
    assert op7_sstable._filesystem("file:///tmp/x")[1] == "/tmp/x"


def test_unnamed_shards_go(spark, docs, tmp_path):
    folder = tmp_path / "sst"
    folder.mkdir()
    (folder / "shard-000000-left.sst").write_bytes(b"of a failed task")
    manifest = op7_sstable.write_shards(docs, f"file://{folder}", public_tokenizers.path(op7_sstable.FILE), shards=2)
    assert sorted(p.name for p in folder.glob("*.sst")) == sorted(m.path.rsplit("/", 1)[1] for m in manifest)
