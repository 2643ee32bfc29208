"""Best-fit packing planned on the length histogram.

Documents become pieces of at most ``capacity`` tokens. The driver plans best-fit decreasing over the counts of the at most
``capacity`` lengths: a plan row puts a run of ranks of one length into a run of sequences. Pieces then take their slot by
their rank within their length. No piece's identity reaches the driver; a hot length is ranked in many salted
groups whose offsets are summed.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import stored, table
from .tokencache import worker

FILE, CAPACITY, END_ID = "word_bpe_49k.json", 4096, 1
#: Groups in which ranks are taken, over those of one for each length.
RANK_GROUPS = 8192


def cut_pieces(docs: DataFrame, file: str, kind: str, capacity: int, end_id: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece, and seq, which tells rows apart once they are written."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end, seq = worker(file, kind), np.array([end_id], np.uint32), TaskContext.get().partitionId() << 40
        for batch in batches:
            for first, ids, bounds in own.encode(batch.column(1)):
                rows, numbers, starts, lengths, sums = [], [], [], [], []
                for i in range(len(bounds) - 1):
                    doc = np.concatenate([ids[bounds[i] : bounds[i + 1]], end]).astype("<u4")
                    for k, start in enumerate(range(0, len(doc), capacity)):
                        piece = doc[start : start + capacity]
                        rows.append(first + i)
                        numbers.append(k)
                        starts.append(start)
                        lengths.append(len(piece))
                        sums.append(zlib.crc32(piece.tobytes()))
                seqs = seq + np.arange(len(rows))
                seq += len(rows)
                values = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64()), pa.array(seqs, pa.int64())]
                yield pa.RecordBatch.from_arrays(values, ["doc_id", "piece", "start", "length", "ids_crc32", "seq"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, seq bigint")


def plan_best_fit(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Plan rows (length, first rank, first sequence, sequences, pieces in each, offset) and the number of sequences.

    Longest first, each piece goes where the least room is left that holds it. Pieces of one length are placed together: a
    sequence with the least room takes as many as fit before the next one is looked at, as one by one they would.
    """
    rows, free, rooms, made = [], {}, [], 0

    def put_back(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in free:
                free[room] = []
                bisect.insort(rooms, room)
            free[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = free[room].pop()
                if not free[room]:
                    del free[room], rooms[at]
            else:
                room, each = capacity, capacity // length
                first, n = made, -(-left // each)
                made += n
            each = room // length
            full = min(n, left // each)
            if full:
                rows.append((length, rank, first, full, each, capacity - room))
                rank, left = rank + full * each, left - full * each
                put_back(room - each * length, first, full)
            if full < n and left and left < each:
                rows.append((length, rank, first + full, 1, left, capacity - room))
                put_back(room - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            put_back(room, first + full, n - full)
    return np.array(rows, np.int64).reshape(-1, 6), made


def pack(docs: DataFrame, file: str, kind: str = "word", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pack every text of ``docs`` (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone. Repeated rows are packed each for itself; a null doc_id stays null; other
    columns are not read; a text of any length is encoded whole and cut. No rows: no pieces. The histogram, the rank groups' sizes and the plan are what the driver sees: at
    most ``capacity`` lengths and ``capacity + RANK_GROUPS`` groups, whatever the number of documents.
    """
    spark = docs.sparkSession
    pieces = stored(cut_pieces(docs, file, kind, capacity, end_id), "pieces")
    counts = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan, _ = plan_best_fit(counts, capacity)
    total = max(1, sum(counts.values()))
    salts = spark.createDataFrame([(k, -(-n * RANK_GROUPS // total)) for k, n in counts.items()], "length bigint, salts bigint")
    keyed = pieces.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("seq"), "salts")).drop("salts")
    groups = sorted((r.length, r.salt, r["count"]) for r in keyed.groupBy("length", "salt").count().collect())
    before, seen = {}, {}
    for length, salt, n in groups:
        before[length, salt] = seen.get(length, 0)
        seen[length] = before[length, salt] + n
    group_keys = np.array([length * (RANK_GROUPS + 1) + salt for length, salt, _ in groups], np.int64)
    group_before = np.array([before[length, salt] for length, salt, _ in groups], np.int64)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    shared = spark.sparkContext.broadcast((group_keys, group_before, plan))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, offsets, rows = shared.value
        starts = rows[:, 0] * (1 << 48) + rows[:, 1]
        for batch in batches:
            length, salt, rank = (batch.column(c).to_numpy() for c in ("length", "salt", "rank"))
            rank = rank - 1 + offsets[np.searchsorted(keys, length * (RANK_GROUPS + 1) + salt)]
            slot = rows[np.searchsorted(starts, length * (1 << 48) + rank, "right") - 1]
            step = rank - slot[:, 1]
            sequence, offset = slot[:, 2] + step // slot[:, 4], slot[:, 5] + step % slot[:, 4] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ranked = keyed.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("seq")).cast("long"))
    return ranked.mapInArrow(place, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(FILE))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the pieces of every document and their slots; a null or empty text is its end id alone, repeated rows are packed each."""
    return pack(docs, public_tokenizers.path(FILE))


QUERIES = {"op5_packing": op5_packing}
ORACLE: dict[str, str] = {}
