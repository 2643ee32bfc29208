"""Token ids in sorted-string-table shards.

Documents are range-partitioned by identifier and sorted; each task encodes its range and writes one shard:
prefix-compressed blocks, a sparse block index, a Bloom filter and a footer. A lookup asks the filter, bisects the
index and reads one block. A task writes under a name of its own and the driver's manifest lists only what finished
tasks wrote; what lost executors and repeated tasks left is deleted.
"""

from __future__ import annotations

import bisect
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .arrowtext import mix
from .shared import files_of, new_folder, partitions, table
from .tokencache import worker

FILE, END_ID = "byte_bpe_50k.json", 2
MAGIC = b"EMBERSS1"
BLOCK_BYTES = 64 << 10
BLOOM_BITS_PER_KEY, BLOOM_PROBES = 10, 7
#: index offset, entries in it, filter offset, bytes of it, documents, ids, bytes of an id, CRC-32 of index and filter, magic.
FOOTER = struct.Struct("<QIQQQQBI8s")
#: offset, bytes, documents and ids before the block; the length of its first key, which follows.
INDEX = struct.Struct("<QIQQB")


def key_of(doc_id: int | None) -> bytes:
    """Keys in byte order are documents in order of doc_id, null first."""
    return b"\x00" if doc_id is None else b"\x01" + struct.pack(">Q", doc_id + (1 << 63))


def doc_of(key: bytes) -> int | None:
    return None if key == b"\x00" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _filesystem(path: str):
    """pyarrow's filesystem of a folder in any store it knows, and the path in it."""
    from pyarrow import fs

    path = re.sub("^s3[an]://", "s3://", path)  # the cluster's names for that store
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _bloom_places(keys: list[bytes], bits: int) -> np.ndarray:
    raw = np.array([zlib.crc32(k) << 32 | zlib.adler32(k) for k in keys], np.uint64)
    one, two = mix(raw), mix(raw ^ np.uint64(0xA5A5A5A5A5A5A5A5)) | np.uint64(1)
    return np.stack([(one + np.uint64(i) * two) % np.uint64(bits) for i in range(BLOOM_PROBES)])


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n, at


class ShardWriter:
    """Takes (key, ids) in order of key; equal keys are separate documents."""

    def __init__(self, sink, width: int):
        self.sink, self.width, self.at = sink, width, len(MAGIC)
        self.block, self.size, self.first, self.last = [], 0, b"", b""
        self.index, self.keys, self.docs, self.ids, self.before = [], [], 0, 0, (0, 0)
        sink.write(MAGIC)

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.size >= BLOCK_BYTES:
            self.flush()
        if not self.block:
            self.first, self.before, shared = key, (self.docs, self.ids), 0
        else:
            shared = next((i for i, (a, b) in enumerate(zip(key, self.last, strict=False)) if a != b), min(len(key), len(self.last)))
        entry = _varint(shared) + _varint(len(key) - shared) + _varint(len(ids)) + key[shared:] + ids.astype(f"<u{self.width}").tobytes()
        self.block.append(entry)
        self.size += len(entry)
        self.last = key
        self.keys.append(key)
        self.docs += 1
        self.ids += len(ids)

    def flush(self) -> None:
        if self.block:
            self.sink.write(b"".join(self.block))
            self.index.append(INDEX.pack(self.at, self.size, *self.before, len(self.first)) + self.first)
            self.at += self.size
            self.block, self.size = [], 0

    def close(self) -> None:
        self.flush()
        bits = max(64, BLOOM_BITS_PER_KEY * len(self.keys))
        filter_bits = np.zeros(-(-bits // 8) * 8, bool)
        filter_bits[_bloom_places(self.keys, bits).ravel().astype(np.int64)] = True
        bloom = struct.pack("<Q", bits) + np.packbits(filter_bits, bitorder="little").tobytes()
        index = b"".join(self.index)
        self.sink.write(index + bloom)
        self.sink.write(FOOTER.pack(self.at, len(self.index), self.at + len(index), len(bloom), self.docs, self.ids, self.width, zlib.crc32(index + bloom), MAGIC))


class ShardReader:
    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - FOOTER.size)
        index_at, n, bloom_at, bloom_size, self.docs, self.ids, self.width, crc, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != MAGIC or not index_at <= bloom_at <= bloom_at + bloom_size <= size:
            raise ValueError("not a shard, or a damaged one")
        source.seek(index_at)
        tail = source.read(bloom_at - index_at + bloom_size)
        if zlib.crc32(tail) != crc:
            raise ValueError("a damaged shard")
        self.blocks, at = [], 0
        for _ in range(n):
            *entry, length = INDEX.unpack_from(tail, at)
            at += INDEX.size
            self.blocks.append((tail[at : at + length], *entry))
            at += length
        self.bits = struct.unpack_from("<Q", tail, bloom_at - index_at)[0]
        self.bloom = np.unpackbits(np.frombuffer(tail, np.uint8, offset=bloom_at - index_at + 8), bitorder="little")

    def read_block(self, i: int) -> Iterator[tuple[bytes, int, np.ndarray]]:
        """(key, ids of the shard before it, ids) of a block's documents."""
        _, offset, size, _, before = self.blocks[i]
        self.source.seek(offset)
        data, at, key = self.source.read(size), 0, b""
        while at < size:
            shared, at = _read_varint(data, at)
            own, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + own]
            at += own
            yield key, before, np.frombuffer(data, f"<u{self.width}", n, at).astype(np.uint32)
            at += n * self.width
            before += n

    def __iter__(self) -> Iterator[tuple[bytes, int, np.ndarray]]:
        for i in range(len(self.blocks)):
            yield from self.read_block(i)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every document with this identifier."""
        key, out = key_of(doc_id), []
        if not self.docs or not self.bloom[_bloom_places([key], self.bits)[:, 0].astype(np.int64)].all():
            return out
        i = max(0, bisect.bisect_left(self.blocks, key, key=lambda b: b[0]) - 1)
        while i < len(self.blocks) and self.blocks[i][0] <= key:
            out += [ids for k, _, ids in self.read_block(i) if k == key]
            i += 1
        return out


def write_shards(docs: DataFrame, folder: str, file: str, kind: str = "byte", end_id: int | None = END_ID, shards: int | None = None) -> list[Row]:
    """Encode ``docs`` (doc_id, text) and write shards into ``folder``; returns the manifest in order: shard, path, n_docs, n_ids, start.

    Null texts are empty; every document gets the end id. Documents with a null doc_id come first, documents with the same
    doc_id stand together in order of their texts' hash; repeated rows are separate documents. No rows: no shards. The range
    key holds the text's hash too, so one repeated doc_id can be dealt over several tasks. The manifest has a row per shard.
    """
    n = shards or partitions(docs.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, out = worker(file, kind), None
        width = 2 if own.library.get_vocab_size() <= 1 << 16 and (end_id or 0) < 1 << 16 else 4
        end = np.array([] if end_id is None else [end_id], np.uint32)
        shard = TaskContext.get().partitionId()
        for batch in batches:
            names = batch.column(0).to_pylist()
            for first, ids, bounds in own.encode(batch.column(1)):
                for i in range(len(bounds) - 1):
                    if out is None:
                        store, place = _filesystem(folder)
                        store.create_dir(place)
                        path = f"{place}/shard-{shard:06d}-{uuid.uuid4().hex}.sst"
                        sink = store.open_output_stream(path)
                        out = ShardWriter(sink, width)
                    out.add(key_of(names[first + i]), np.concatenate([ids[bounds[i] : bounds[i + 1]], end]))
        if out is not None:
            out.close()
            sink.close()
            yield pa.RecordBatch.from_pylist([{"shard": shard, "name": path.rsplit("/", 1)[1], "n_docs": out.docs, "n_ids": out.ids}], pa.schema([("shard", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("__h"))
    dealt = keyed.repartitionByRange(n, "doc_id", "__h").sortWithinPartitions("doc_id", "__h").select("doc_id", "text")
    rows = sorted(dealt.mapInArrow(write, "shard int, name string, n_docs bigint, n_ids bigint").collect())
    _drop_unnamed(docs.sparkSession, folder, {r.name for r in rows})
    starts = np.cumsum([0, *(r.n_ids for r in rows)]).tolist()
    return [Row(shard=r.shard, path=f"{folder}/{r.name}", n_docs=r.n_docs, n_ids=r.n_ids, start=s) for r, s in zip(rows, starts, strict=False)]


def _drop_unnamed(spark: SparkSession, folder: str, named: set[str]) -> None:
    """Delete the shards of failed and repeated tasks, which no manifest names."""
    where, files = files_of(spark, folder)
    for status in files.listStatus(where) if named else ():
        name = status.getPath().getName()
        if name.endswith(".sst") and name not in named:
            files.delete(status.getPath(), False)


def read_shards(spark: SparkSession, manifest: list[Row]) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document, read from the files.

    Null doc_ids come back null, repeated rows as often as they were written, empty texts with their end id alone. A document's
    ids are read a block at a time, so a very long text is the most that is held. An empty manifest gives no rows.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, place = _filesystem(row["path"])
                with store.open_input_file(place) as source:
                    shard = ShardReader(source)
                    for i in range(len(shard.blocks)):
                        found = [(doc_of(k), row["start"] + s, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for k, s, ids in shard.read_block(i)]
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = [(r.path, r.start) for r in manifest]
    files = spark.createDataFrame(rows, "path string, start bigint").repartition(max(1, len(rows)))
    return files.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op7_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = new_folder(spark, "sst")
    manifest = write_shards(docs, folder, public_tokenizers.path(FILE))
    where, files = files_of(spark, folder)
    files.deleteOnExit(where)
    return read_shards(spark, manifest)


QUERIES = {"op7_sstable": op7_sstable}
ORACLE: dict[str, str] = {}
