"""LM scoring: a unigram word model over exact corpus counts, and a causal self-attention model on subword ids.

Five jobs, all of packed arrays dealt by hash bucket:

1. every text is encoded once and its subword ids are written; the training documents' words and ids are counted (each task
   adds up its own first);
2. bucket by bucket the counts become the word table; the frequent words, a bounded number, are broadcast;
3. the attention model is trained by a few rounds of local steps over the windows of all ids of the training documents, dealt to a bounded
   number of workers whose weights are averaged;
4. every document's ids are scored by the model;
5. the base score: the frequent words' part is added up in the task, other words are requests that meet their bucket of the word
   table, and each bucket's answers are added up for each block of documents.

A frequent word is never a request, so no bucket holds a word for every document; a bucket's task holds its part of the
word table and one request at a time.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attention
from .arrowtext import NONSPACE, blocks, give_back, span_hashes, spans
from .shared import join_hot, partitions, stored, table
from .tokencache import HashTable, worker

FILE, START_ID, END_ID = "word_bpe_49k.json", 49406, 49407
FOLDS, HELD_OUT = 5, 1
#: Frequent words that are broadcast (12 bytes each).
FREQUENT = 16_384
#: Rounds of training; workers of a round at the most (one for every four shuffle partitions).
ROUNDS, WORKERS = 3, 256

_PACKED = "kind int, bucket bigint, base bigint, n bigint, words binary, counts binary, extra binary"
_SCHEMA = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("base", pa.int64()), ("n", pa.int64()), ("words", pa.binary()), ("counts", pa.binary()), ("extra", pa.binary())])
WORDS, IDS, WINDOW, REQUEST, DOCS, ANSWER, HELD = range(7)
#: Stands for the number of documents among the id counts.
DOCUMENTS = -1


def fold_of(doc_id: int | None) -> int:
    """crc32 of the identifier as text, modulo the folds; null reads as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def _merge(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and their values' sums."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(values, first) if len(first) else values


def _bucket_cuts(words: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted words by bucket: a bucket is a range of hashes, so sorted words are sorted by bucket. Numbers and edges."""
    number = ((words >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    edge = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1], [True]])) if len(words) else np.zeros(1, np.int64)
    return number[edge[:-1]].astype(np.int64), edge


def windows_of(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All training windows of documents whose ids (each ends with the end id) follow each other: every id is the target of one."""
    lengths = lengths.astype(np.int64)
    many = -(-lengths // attention.STEP)
    at = np.concatenate([[0], np.cumsum(many * attention.STEP + attention.CONTEXT + 1)])
    full = np.full(at[-1], -1, np.int32)
    full[at[:-1] + attention.CONTEXT] = START_ID
    full[np.arange(len(ids)) + np.repeat(at[:-1] + attention.CONTEXT + 1 - (np.cumsum(lengths) - lengths), lengths)] = ids
    start = np.repeat(at[:-1], many) + (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)) * attention.STEP
    return full[start[:, None] + np.arange(attention.LENGTH + 1)]


def _keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each document's doc_id (0 where null), whether it is null, and its text's hash."""
    doc_ids = batch.column("doc_id")
    return doc_ids.fill_null(0).to_numpy(), doc_ids.is_null().to_numpy(zero_copy_only=False), batch.column("h").to_numpy()


def _gather(docs: DataFrame, buckets: int, file: str) -> DataFrame:
    """Packed rows: word counts by bucket and id counts of the training documents, and every document's ids (16 bits each).

    The ids of a block's documents are a row (WINDOW for those to train on, HELD for the others): their lengths, the documents'
    keys and the ids, so that texts are encoded once.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = worker(file, "word")
        ids_seen, n_docs = np.zeros(own.library.get_vocab_size(), np.int64), 0
        for batch in batches:
            doc_ids, none, hashes = _keys(batch)
            train = np.array([fold_of(d) != HELD_OUT for d in batch.column("doc_id").to_pylist()], bool)
            n_docs += int(train.sum())
            parts, rows = [], []
            for _, _, data, offsets in blocks(batch.column("text").take(pa.array(np.flatnonzero(train)))):
                starts, ends, _ = spans(data, offsets, NONSPACE)
                words = span_hashes(data, starts, ends, fold=True)
                words[words == 0] = 1
                parts.append(np.unique(words, return_counts=True))
            if parts:
                words, counts = _merge(*(np.concatenate(x) for x in zip(*parts, strict=True)))
                numbers, edge = _bucket_cuts(words, buckets)
                rows = [(WORDS, b, 0, e - s, words[s:e].tobytes(), counts[s:e].astype(np.uint32).tobytes(), None) for b, s, e in zip(numbers.tolist(), edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
            for first, ids, bounds in own.encode(batch.column("text")):
                n = len(bounds) - 1
                ended, lengths = np.insert(ids.astype(np.uint16), bounds[1:], END_ID), (np.diff(bounds) + 1).astype(np.int32)
                for kind, some in ((WINDOW, train[first : first + n]), (HELD, ~train[first : first + n])):
                    if not some.any():
                        continue
                    flat = ended[np.repeat(some, lengths)]
                    if kind == WINDOW:
                        ids_seen += np.bincount(flat, minlength=len(ids_seen))
                    at = first + np.flatnonzero(some)
                    keys = np.stack([doc_ids[at], none[at].astype(np.int64), hashes[at]])
                    rows.append((kind, zlib.crc32(flat.tobytes()), 0, len(at), keys.tobytes(), lengths[some].tobytes(), flat.tobytes()))
            if rows:
                yield _rows(rows)
            del parts, rows
        seen = np.flatnonzero(ids_seen)
        if n_docs:  # counted apart: a text may spell the end id's token
            yield _rows([(IDS, DOCUMENTS, 0, n_docs, None, None, None)])
            yield _rows([(IDS, i, 0, n, None, None, None) for i, n in zip(seen.tolist(), ids_seen[seen].tolist(), strict=True)])

    return docs.select("doc_id", "text", "h").mapInArrow(gather, _PACKED)


def _runs(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[tuple[int, Iterator[dict]]]:
    """(key, its rows) of sorted packed rows; rows are handed on one at a time."""
    from itertools import groupby

    rows = (r for batch in batches for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist())
    return groupby(rows, key=lambda r: r[by])


def _word_table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each bucket: its words, sorted, and their counts (64 bits)."""
    for bucket, rows in _runs(batches, "bucket"):
        words, counts, held, size = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0
        for r in rows:
            held.append((np.frombuffer(r["words"], np.uint64), np.frombuffer(r["counts"], np.uint32).astype(np.int64)))
            size += len(held[-1][0])
            if size > max(1 << 20, len(words)):
                words, counts = _merge(*(np.concatenate(x) for x in zip((words, counts), *held, strict=True)))
                held, size = [], 0
        words, counts = _merge(*(np.concatenate(x) for x in zip((words, counts), *held, strict=True)))
        yield _rows([(WORDS, bucket, int(counts.sum()), len(words), words.tobytes(), counts.tobytes(), None)])


def _frequent(words: DataFrame, each: int) -> tuple[np.ndarray, np.ndarray]:
    """Every bucket's most frequent words: ``each`` at the most, found more than once."""

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                w, c = np.frombuffer(r["words"], np.uint64), np.frombuffer(r["counts"], np.int64)
                at = np.argsort(-c, kind="stable")[:each]
                at = at[c[at] > 1]
                yield pa.RecordBatch.from_arrays([pa.array(w[at].view(np.int64)), pa.array(c[at])], ["w", "c"])

    found = words.select("words", "counts").mapInArrow(top, "w bigint, c bigint").toArrow()
    return found.column("w").to_numpy().view(np.uint64), found.column("c").to_numpy()


def _train(windows: DataFrame, vocabulary: attention.Vocabulary, rounds: int, workers: int) -> dict:
    """The attention weights after ``rounds``: each round takes its share of the windows, all of them are taken once.

    A worker takes the written ids where they are, in order, so a round gives the same weights however its tasks were run.
    """
    weights = attention.initial(vocabulary)
    sc = windows.sparkSession.sparkContext
    for k in range(rounds):
        now = sc.broadcast((weights, vocabulary))

        def local(batches: Iterator[pa.RecordBatch], now=now, k=k) -> Iterator[pa.RecordBatch]:
            trainer = attention.Trainer(*now.value, rate=0.01 / (1 + k))
            n = 0
            for batch in batches:
                for blob, lengths in zip(batch.column(0), batch.column(1), strict=True):
                    own = windows_of(np.frombuffer(blob.as_buffer(), np.uint16), np.frombuffer(lengths.as_buffer(), np.int32))
                    own = own[np.random.default_rng(len(own)).permutation(len(own))]  # a step's windows are of many documents
                    trainer.learn(own)
                    n += len(own)
            if n:
                flat = np.concatenate([trainer.w[x].ravel() for x in attention.NAMES]).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([flat], pa.binary())], ["n", "weights"])
            give_back()

        part = windows.where(F.pmod("bucket", F.lit(rounds)) == k)
        dealt = part.select("extra", "counts").coalesce(workers)
        got = sorted(dealt.mapInArrow(local, "n bigint, weights binary").collect(), key=lambda r: (r.n, bytes(r.weights)))
        if got:
            total = sum(r.n for r in got)
            flat = sum(np.frombuffer(bytes(r.weights), np.float32).astype(np.float64) * (r.n / total) for r in got)
            cuts = np.cumsum([weights[x].size for x in attention.NAMES])[:-1]
            weights = {x: y.reshape(weights[x].shape).astype(np.float32) for x, y in zip(attention.NAMES, np.split(flat, cuts), strict=True)}
        now.unpersist()
    return weights


def _model_scores(gathered: DataFrame, shared) -> DataFrame:
    """doc_id, h and score of every document, from its ids."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = attention.Scorer(*shared.value)
        for batch in batches:
            for keys, lengths, ids in zip(*batch.columns, strict=True):
                doc_ids, none, hashes = np.frombuffer(keys.as_buffer(), np.int64).reshape(3, -1)
                bounds = np.concatenate([[0], np.cumsum(np.frombuffer(lengths.as_buffer(), np.int32), dtype=np.int64)])
                scores = model.log10(np.frombuffer(ids.as_buffer(), np.uint16), bounds)
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, mask=none > 0), pa.array(hashes), pa.array(scores)], ["doc_id", "h", "score"])
            give_back()

    return gathered.where(F.col("kind").isin(WINDOW, HELD)).select("words", "counts", "extra").mapInArrow(score, "doc_id bigint, h bigint, score double")


def _ask(docs: DataFrame, buckets: int, frequent) -> DataFrame:
    """Packed rows: for each batch its documents with what the frequent words give, and the requests by bucket."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent_words, frequent_counts = frequent.value
        known_words = HashTable(max(1, len(frequent_words)))
        known_words.add(frequent_words, np.arange(len(frequent_words), dtype=np.int32))
        logs = np.log10(frequent_counts + 0.5)
        base = TaskContext.get().partitionId() << 32
        for batch in batches:
            n_docs = batch.num_rows
            tokens, known, sums = (np.zeros(n_docs) for _ in range(3))
            asked = []
            for first, last, data, offsets in blocks(batch.column("text")):
                n = last - first
                starts, ends, rows = spans(data, offsets, NONSPACE)
                words = span_hashes(data, starts, ends, fold=True)
                words[words == 0] = 1
                tokens[first:last] = np.bincount(rows, minlength=n) + 1
                at = known_words.find(words)
                hit = at >= 0
                known[first:last] = np.bincount(rows[hit], minlength=n)
                sums[first:last] = np.bincount(rows[hit], logs[at[hit]], n)
                asked.append((words[~hit], (rows[~hit] + first).astype(np.uint32)))
            held = np.array([fold_of(d) == HELD_OUT for d in batch.column("doc_id").to_pylist()], np.float64)
            doc_ids, none, hashes = _keys(batch)
            rows = [(DOCS, 0, base, n_docs, doc_ids.tobytes(), np.stack([held, tokens, known, sums, none]).tobytes(), hashes.tobytes())]
            if asked:
                words, row = (np.concatenate(x) for x in zip(*asked, strict=True))
                order = np.argsort(words, kind="stable")
                words, row = words[order], row[order]
                numbers, edge = _bucket_cuts(words, buckets)
                for b, s, e in zip(numbers.tolist(), edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                    distinct, many = np.unique(words[s:e], return_counts=True)
                    rows.append((REQUEST, b, base, n_docs, distinct.tobytes(), many.astype(np.uint32).tobytes(), row[s:e].astype(np.uint16 if n_docs <= 1 << 16 else np.uint32).tobytes()))
                del words, row, order
            del asked
            yield _rows(rows)
            del rows
            base += 1

    return docs.select("doc_id", "text", "h").mapInArrow(ask, _PACKED)


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The requests of a bucket, answered from its part of the word table, which stands before them."""
    for bucket, rows in _runs(batches, "bucket"):
        words, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for r in rows:
            if r["kind"] == WORDS:
                words, counts = np.frombuffer(r["words"], np.uint64), np.frombuffer(r["counts"], np.int64)
                continue
            wanted, many = np.frombuffer(r["words"], np.uint64), np.frombuffer(r["counts"], np.uint32)
            at = np.minimum(np.searchsorted(words, wanted), max(0, len(words) - 1))
            c = np.where(words[at] == wanted, counts[at], 0) if len(words) else np.zeros(len(wanted), np.int64)
            c = np.repeat(c, many)
            doc = np.frombuffer(r["extra"], np.uint16 if r["n"] <= 1 << 16 else np.uint32)
            own, where = np.unique(doc, return_inverse=True)
            yield _rows([(ANSWER, bucket, r["base"], r["n"], own.astype(np.uint32).tobytes(), np.bincount(where, c > 0).astype(np.uint32).tobytes(), np.bincount(where, np.log10(c + 0.5)).tobytes())])


def _total(batches: Iterator[pa.RecordBatch], norm: float, end_log: float, end_known: bool, train_tokens: int) -> Iterator[pa.RecordBatch]:
    """The documents of a block with the answers of all buckets."""
    for _, rows in _runs(batches, "base"):
        ids = hashes = each = None
        for r in rows:
            if r["kind"] == DOCS:
                ids, hashes, each = np.frombuffer(r["words"], np.int64), np.frombuffer(r["extra"], np.int64), np.frombuffer(r["counts"], np.float64).reshape(5, -1).copy()
            else:
                own = np.frombuffer(r["words"], np.uint32)
                each[2, own] += np.frombuffer(r["counts"], np.uint32)
                each[3, own] += np.frombuffer(r["extra"], np.float64)
        held, tokens, known, sums, none = each
        base = sums + end_log - tokens * norm
        columns = [pa.array(ids, mask=none > 0), pa.array(hashes), pa.array(held > 0), pa.array(tokens.astype(np.int64)), pa.array((known + end_known).astype(np.int64)), pa.array(np.full(len(ids), train_tokens, np.int64)), pa.array(base)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "h", "held_out", "n_tokens", "n_known", "train_tokens", "base_score"])


def score_documents(docs: DataFrame, file: str, rounds: int = ROUNDS, workers: int = WORKERS, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs`` (doc_id, text).

    A null or empty text is the end token alone. Rows that repeat are documents of their own; other columns are not read. Without
    training documents every count is 0 and the model keeps its first weights. ``score`` is log10 of the probability of
    the text's subword ids and its end id. Texts of any length are taken whole; an empty table gives no rows.
    """
    spark = docs.sparkSession
    buckets = partitions(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    gathered = stored(_gather(docs, buckets, file), "gathered")
    words = gathered.where(F.col("kind") == WORDS).repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_word_table, _PACKED)
    words = stored(words, "words")
    total = words.agg(F.sum("base"), F.sum("n")).first()
    n_docs = next(iter(gathered.where((F.col("kind") == IDS) & (F.col("bucket") == DOCUMENTS)).agg(F.sum("n")).first())) or 0
    train_tokens, distinct = (total[0] or 0) + n_docs, (total[1] or 0) + (n_docs > 0)
    id_counts = np.zeros(worker(file, "word").library.get_vocab_size(), np.int64)
    for r in gathered.where((F.col("kind") == IDS) & (F.col("bucket") != DOCUMENTS)).groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        id_counts[r.bucket] = r.n
    vocabulary = attention.Vocabulary(id_counts, START_ID)
    weights = _train(gathered.where(F.col("kind") == WINDOW), vocabulary, rounds, max(1, min(workers, buckets // 4)))
    scores = stored(_model_scores(gathered, spark.sparkContext.broadcast((weights, vocabulary))), "scores")
    asked = stored(_ask(docs, buckets, spark.sparkContext.broadcast(_frequent(words, max(1, frequent // buckets)))), "asked")
    requests = asked.where(F.col("kind") == REQUEST).unionByName(words)
    answers = requests.repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(_answer, _PACKED)
    norm, end_log = float(np.log10(train_tokens + 0.5 * (distinct + 1))), float(np.log10(n_docs + 0.5))
    both = asked.where(F.col("kind") == DOCS).unionByName(answers)
    out = both.repartition(buckets, "base").sortWithinPartitions("base", "kind", "bucket")
    schema = "doc_id bigint, h bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double"
    out = out.mapInArrow(lambda b: _total(b, norm, end_log, n_docs > 0, train_tokens), schema)
    # Rows of one doc_id and text have one score.
    scores = scores.groupBy(F.struct("doc_id", "h").alias("key")).agg(F.first("score").alias("score"), F.count("*").alias("n"))
    out = out.select(F.struct("doc_id", "h").alias("key"), "held_out", "n_tokens", "n_known", "train_tokens", "base_score")
    return join_hot(out, scores, "key", "n", docs.count()).select("key.doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(FILE))


QUERIES = {"op8_lm_score": op8_lm_score}
ORACLE: dict[str, str] = {}
