"""Token counts by a map-side two-tier lookup.

The first tier is a compact hash table of frequent pre-tokens' lengths, broadcast to every task. Which pre-tokens are frequent is
already known: a vocabulary holds the strings that were frequent where it was made, so its entries are the table (at most as many
as the vocabulary has, under 2 MB, whatever the corpus). The second tier is the worker's own table; what both lack is encoded by
the library's model. One scan, and no pre-token ever leaves its task. The first tier changes the cost only, never a count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtext import blocks, span_hashes
from .shared import table
from .tokencache import STAND_IN, CachedTokenizer, HashTable, pretokens, worker

FILE, LIMIT = "byte_bpe_50k.json", 512
#: Texts with a longer pre-token (bytes) go to the library whole: from 512 bytes on, strings of two letters can be written whose hashes agree.
LONGEST = 256


def vocabulary_pieces(tokenizer: CachedTokenizer) -> list[bytes]:
    """The vocabulary's entries as pre-tokens' bytes, in order of their ids."""
    back = {c: b for b, c in STAND_IN.items()}
    found = sorted(tokenizer.library.get_vocab().items(), key=lambda x: x[1])
    names = [t.removesuffix("</w>") if tokenizer.kind == "word" else t for t, _ in found if t not in tokenizer.special]
    return list(dict.fromkeys(bytes(back[c] for c in t) for t in names if t and all(c in back for c in t)))


def count_tokens(docs: DataFrame, file: str, kind: str = "byte", limit: int = LIMIT, drop: tuple[str, ...] = ()) -> DataFrame:
    """Add n_bytes (UTF-8), n_tokens and over_limit to every row of ``docs`` (column text).

    Null and empty texts have 0 bytes and tokens; texts of any length are counted whole; an empty table gives no rows. Rows that repeat stay as many rows; columns of ``docs`` named like the
    results are replaced, others but those in ``drop`` pass through. Special tokens' strings inside texts are read as the library does by default.
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c not in ("n_bytes", "n_tokens", "over_limit", *drop)]
    library = CachedTokenizer(file, kind, 1)
    pieces = vocabulary_pieces(library)
    keys = _keys(pieces)
    lengths = np.fromiter((len(library.piece_ids(p)) for p in pieces), np.int32, len(pieces))
    frequent = HashTable(max(1, len(pieces)))
    frequent.add(keys, lengths)
    tier = spark.sparkContext.broadcast(frequent)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = worker(file, kind)
        for batch in batches:
            counts = [c for block in blocks(batch.column("text")) for c in _block_counts(own, tier.value, *block)]
            sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), sizes, pa.array(counts, pa.int64())], [*kept, "n_bytes", "n_tokens"])

    schema = T.StructType([*docs.select(*kept).schema.fields, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return docs.select(*dict.fromkeys([*kept, "text"])).mapInArrow(count, schema).withColumn("over_limit", F.col("n_tokens") > limit)


def _keys(pieces: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b"".join(pieces), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
    keys = span_hashes(data, np.concatenate([[0], ends[:-1]]).astype(np.int64), ends) if pieces else np.zeros(0, np.uint64)
    keys[keys == 0] = 1
    return keys


def _block_counts(own: CachedTokenizer, frequent: HashTable, first: int, last: int, data: np.ndarray, offsets: np.ndarray) -> list[int]:
    n = last - first
    if not len(data):
        return [0] * n
    starts, ends, odd = pretokens(data, offsets, own.kind)
    text = data.tobytes()
    for s in own.special:
        at = text.find(mark := s.encode())
        while at >= 0:
            odd[np.searchsorted(offsets, at, "right") - 1] = True
            at = text.find(mark, at + 1)
    rows = np.searchsorted(offsets, starts, "right") - 1
    odd[rows[ends - starts > LONGEST]] = True
    plain = ~odd[rows]
    starts, ends, rows = starts[plain], ends[plain], rows[plain]
    keys = span_hashes(data, starts, ends)
    keys[keys == 0] = 1
    lengths = frequent.find(keys).astype(np.int64)
    rare = np.flatnonzero(lengths < 0)
    if len(rare):
        entry = own.entries_of(data, starts[rare], ends[rare])  # may start the table anew: its lengths only after that
        lengths[rare] = own.lengths[entry]
    counts = np.bincount(rows, lengths, n).astype(np.int64)
    for r in np.flatnonzero(odd):
        counts[r] = len(own.whole(text[offsets[r] : offsets[r + 1]]))
    return counts.tolist()


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path(FILE), drop=("text",)).select("doc_id", "n_bytes", "n_tokens", "over_limit")


QUERIES = {"op6_token_counts": op6_token_counts}
ORACLE: dict[str, str] = {}
