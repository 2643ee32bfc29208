"""N-gram Jaccard join by chosen paths.

Texts become sets of five-word shingles; equal sets are one. In each run a set chooses each of its shingles with
probability 1 / (threshold * size) by a hash that all sets share, so two sets that are similar enough choose a common shingle with
probability over 1 - 1/e; runs repeat until the target recall. Sets that chose the same shingle share a bucket;
buckets that are too large are split again on further shingles that their sets chose, and what never splits (one large group of
near copies, or a passage that fills its texts) is compared whole, tile by tile. Within a bucket sketches are compared, and the connected candidates' whole sets are then compared exactly, all
against all within a group, in tiles of bounded size. Pairs are never emitted: a bucket gives a spanning forest, a tile the
links' numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrowtext import ALNUM, blocks, give_back, gram_hashes, mix, row_bounds, span_hashes, spans
from .components import components
from .shared import Scratch, join_hot, partitions, stored, table

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.9999
#: Sets in a bucket that are compared at once; larger buckets are contracted with PIVOTS, split at most LEVELS times on CHILDREN paths of each set, then tiled.
BUCKET, LEVELS, CHILDREN, PIVOTS = 2048, 4, 2, 16
#: Min-hashes in a set's sketch, and how many must agree for two sets to be candidates (similarity 0.8 falls short once in a million).
SKETCH, AGREE = 32, 14
#: Sets in a tile of the exact comparison and bytes of their shingles, on the average of a group.
TILE, TILE_BYTES = 512, 4 << 20
#: Rows of a matrix, shingles of a product and reached sets that are handled at once.
STRIP, PRODUCT, REACHED = 512, 2048, 64
#: Rows of identifiers (16 bytes and a key) that are broadcast to the texts; more are joined.
BROADCAST_ROWS = 500_000

_SEEDS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def runs_for(recall: float) -> int:
    """Runs after which a pair at the threshold has met with this probability."""
    return max(1, math.ceil(-math.log(1 - recall)))


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every row of a block, sorted within the row, and the rows' bounds.

    A text of fewer than ``k`` words, but not none, has one shingle of all its words.
    """
    n = len(offsets) - 1
    starts, ends, rows = spans(data, offsets, ALNUM)
    words = span_hashes(data, starts, ends, fold=True)
    bounds = row_bounds(rows, n)
    grams = gram_hashes(words, k)
    inside = rows[: len(grams)] == rows[k - 1 :] if len(grams) else np.zeros(0, bool)
    hashes, owner = [grams[inside]], [rows[: len(grams)][inside]]
    sizes = np.diff(bounds)
    for size in range(1, k):
        short = np.flatnonzero(sizes == size)
        if len(short):
            joined = np.zeros(len(short), np.uint64)
            for i in range(size):
                joined = mix(joined + words[bounds[short] + i])
            hashes.append(joined)
            owner.append(short)
    hashes, owner = np.concatenate(hashes), np.concatenate(owner)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], row_bounds(owner[new], n)


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])[bounds])


def _signatures(docs: DataFrame, k: int, threshold: float, runs: int) -> DataFrame:
    """doc_id, h, key (of the set; null without words), size, paths and sketch of every row."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in blocks(batch.column("text")):
                n = last - first
                own, bounds = shingles(data, offsets, k)
                sizes = np.diff(bounds)
                row = np.repeat(np.arange(n), sizes)
                with np.errstate(divide="ignore"):
                    limit = np.where(sizes > 0, np.minimum(2.0**64 / (threshold * np.maximum(sizes, 1)), 2.0**64 - 2048), 0).astype(np.uint64)[row]
                path, path_row = [], []
                for r in range(runs):
                    h = mix(own ^ _SEEDS[r])
                    at = np.flatnonzero(h < limit)
                    path.append(mix(h[at] + _SEEDS[r]))
                    path_row.append(row[at])
                path, path_row = np.concatenate(path), np.concatenate(path_row)
                path = path[np.argsort(path_row, kind="stable")].view(np.int64)
                sketch = np.zeros((n, SKETCH), np.uint16)
                full = np.flatnonzero(sizes)
                for r in range(SKETCH if len(full) else 0):
                    low = np.minimum.reduceat(mix(own ^ _SEEDS[128 + r]), bounds[full])
                    sketch[full, r] = (mix(low) >> np.uint64(48)).astype(np.uint16)
                key = np.stack([_sums(mix(own), bounds), _sums(mix(own ^ _SEEDS[255]), bounds)], axis=1).astype(">u8").tobytes()
                keys = pa.array([key[16 * i : 16 * i + 16] if sizes[i] else None for i in range(n)], pa.binary())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(path_row, minlength=n))]).astype(np.int32)), pa.array(path))
                sketches = pa.array([s.tobytes() for s in sketch], pa.binary())
                part = batch.slice(first, n)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("h"), keys, pa.array(sizes.astype(np.int32)), lists, sketches], ["doc_id", "h", "key", "size", "paths", "sketch"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    return rows.mapInArrow(sign, "doc_id bigint, h bigint, key binary, size int, paths array<bigint>, sketch binary")


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Runs of whole groups from batches that are sorted by ``names``: a group never straddles two results."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = np.zeros(batch.num_rows, bool)
        for c in names:
            column = batch.column(c)
            last[1:] |= np.asarray(pa.compute.not_equal(column.slice(1), column.slice(0, len(column) - 1)))
        cuts = np.flatnonzero(last)
        same = bool(held) and all(held[-1].column(c)[-1] == batch.column(c)[0] for c in names)
        if held and not same:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
        if not len(cuts):
            held.append(batch)
            continue
        whole = batch.slice(0, cuts[-1])
        yield pa.Table.from_batches([*held, whole]).combine_chunks().to_batches()[0]
        held = [batch.slice(cuts[-1])]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _labels(near: np.ndarray) -> np.ndarray:
    """The smallest index of each index's connected component, from a symmetric matrix."""
    n = len(near)
    labels = np.arange(n, dtype=np.int32)
    while True:
        new = np.minimum(labels, np.concatenate([np.where(near[i : i + STRIP], labels[None, :], np.int32(n)).min(1) for i in range(0, n, STRIP)]))
        new = new[new]
        if (new == labels).all():
            return labels
        labels = new


def _agree(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Whether each of some sketches (SKETCH, n) agrees with each of others (SKETCH, m)."""
    same = np.zeros((one.shape[1], others.shape[1]), np.uint8)
    for a, b in zip(one, others, strict=True):
        same += a[:, None] == b[None, :]
    return same >= AGREE


def _forest(sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that span the components of agreeing sketches (n, SKETCH).

    Sets that are reached meet only those that are not: many copies of one text take few passes, and memory is a few times the sketches.
    """
    sketch = np.ascontiguousarray(sketch.T)
    left, a, b = np.arange(sketch.shape[1]), [], []
    while len(left) > 1:
        reached, left = left[:1], left[1:]
        while len(reached) and len(left):
            now, reached = reached[:REACHED], reached[REACHED:]
            near = _agree(sketch[:, now], sketch[:, left])
            hit = near.any(0)
            a.append(now[near[:, hit].argmax(0)])
            b.append(left[hit])
            reached, left = np.concatenate([reached, left[hit]]), left[~hit]
    return tuple(np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (a, b))


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning edges of the candidates of every bucket (p, i, j)."""
    for run in _groups(batches, ["p", "i", "j"]):
        new = np.zeros(run.num_rows + 1, bool)
        new[[0, -1]] = True
        for c in ("p", "i", "j"):
            column = run.column(c).to_numpy()
            new[1:-1] |= column[1:] != column[:-1]
        cut = np.flatnonzero(new)
        sizes = np.diff(cut)
        sketch = np.frombuffer(b"".join(run.column("sketch").to_pylist()), np.uint16).reshape(-1, SKETCH)
        two = cut[:-1][sizes == 2]
        good = two[(sketch[two] == sketch[two + 1]).sum(1) >= AGREE]
        a, b = [good], [good + 1]
        for start, size in zip(cut[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            one, other = _forest(sketch[start : start + size])
            a.append(start + one)
            b.append(start + other)
        a, b = np.concatenate(a), np.concatenate(b)
        if len(a):
            node = run.column("node")
            yield pa.RecordBatch.from_arrays([node.take(pa.array(a)), node.take(pa.array(b))], ["a", "b"])
    give_back()


def _tile_pairs(tiles: Column, tile: Column) -> Column:
    """The pairs (i, j), i <= j, of a set's tile with every tile of its group: any two sets share one of their pairs."""
    return F.transform(F.sequence(F.lit(0), tiles - 1), lambda t: F.struct(F.least(tile, t).alias("i"), F.greatest(tile, t).alias("j")))


def _connected(dealt: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges (a, b) that span the agreeing sketches of every bucket (p, i, j)."""
    met = dealt.join(sets.select("node", "sketch"), "node").select("p", "i", "j", "node", "sketch")
    return met.repartition(partitions(sets.sparkSession), "p", "i", "j").sortWithinPartitions("p", "i", "j").mapInArrow(_stars, "a bigint, b bigint")


def _contracted(hot: DataFrame, sets: DataFrame, scratch: Scratch, bucket: int, total: int) -> tuple[DataFrame, DataFrame]:
    """(edges, ``hot`` with tile, tiles, inner and outside) of buckets that are too large.

    A bucket is dealt into tiles that share a few pivots, one for each region of its keys, so one large group of near copies becomes one
    component in a pass. ``inner`` says whether a set is in its bucket's largest component, ``outside`` how many are not: what is left
    to compare is each of those with every set.
    """
    tiles = F.ceil(2 * F.col("n") / bucket).cast("int")
    hot = scratch.write(hot.withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("node", F.lit(7)), "tiles").cast("int")), "hot", total)
    pivots = hot.groupBy("p", "tiles", F.pmod(F.xxhash64("node"), F.lit(PIVOTS)).alias("slot")).agg(F.min("node").alias("node"))
    copies = pivots.select("p", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("i"), F.lit(-1).alias("j"), "node")
    edges = scratch.write(_connected(hot.select("p", F.col("tile").alias("i"), F.lit(-1).alias("j"), "node").union(copies).distinct(), sets), "pivoted", total)
    hot = hot.join(components(edges, scratch, total), "node", "left").withColumn("root", F.coalesce("root", "node"))
    hot = scratch.write(hot, "rooted", total)
    tally = hot.groupBy("p", "root").agg(F.count("*").alias("c"), F.first("n").alias("n")).groupBy("p").agg(F.max(F.struct("c", "root")).alias("most"), F.first("n").alias("n"))
    tally = scratch.write(tally.select("p", F.col("most.root").alias("main"), (F.col("n") - F.col("most.c")).alias("outside"), F.col("n").alias("weight")), "tally", total)
    return edges, scratch.write(join_hot(hot, tally, "p", "weight", total).withColumn("inner", F.col("root") == F.col("main")).drop("weight", "main", "root"), "judged", total)


def _candidates(sets: DataFrame, scratch: Scratch, bucket: int, levels: int) -> DataFrame:
    """Edges (a, b) that connect all sets which met in a bucket and whose sketches agree.

    Only paths and nodes are dealt to find the buckets; sketches and the sets' other paths join what shares a bucket. A bucket that
    is too large is contracted first. While few of its sets are outside its largest component, these meet all others, tile by tile;
    else it is split by paths not used on the way to it. What is still too large after ``levels`` splits is cut into tiles and every
    tile meets every other: no pair is left out.
    """
    rows = sets.select("node", F.explode("paths").alias("p")).select("node", "p", F.array("p").alias("used"))
    n_rows = sets.agg(F.sum(F.size("paths"))).first()[0] or 0
    found, edges = [], []
    for level in range(levels + 1):
        counts = scratch.write(rows.groupBy("p").agg(F.count("*").alias("n")).where("n > 1"), "counts", n_rows)
        total = counts.agg(F.sum("n")).first()[0] or 0
        met = scratch.write(join_hot(rows, counts, "p", "n", total), "met", total)
        found.append(met.where(F.col("n") <= bucket).select("p", F.lit(0).alias("i"), F.lit(0).alias("j"), "node"))
        hot = met.where(F.col("n") > bucket)
        if not (n_hot := hot.count()):
            break
        pivoted, hot = _contracted(hot, sets, scratch, bucket, n_hot)
        edges.append(pivoted)
        few = F.col("outside") <= bucket // 2
        tiles = F.when(F.col("inner"), F.array("tile")).otherwise(F.sequence(F.lit(0), F.col("tiles") - 1))
        found.append(hot.where(few & (F.col("outside") > 0)).select("p", F.explode(tiles).alias("i"), F.lit(-2).alias("j"), "node"))
        hot = hot.where(~few)
        if level == levels:
            found.append(hot.select("p", "node", F.explode(_tile_pairs(F.col("tiles"), F.col("tile"))).alias("ij")).select("p", "ij.i", "ij.j", "node"))
            break
        if not hot.limit(1).count():
            break
        order = F.slice(F.array_sort(F.transform(F.array_except("paths", "used"), lambda q: F.struct(F.xxhash64(F.col("p"), q).alias("h"), q.alias("q")))), 1, CHILDREN)
        rows = hot.join(sets.select("node", "paths"), "node").select("node", "used", F.explode(order).alias("next"))
        rows = rows.select("node", F.array_sort(F.concat("used", F.array("next.q"))).alias("used"))
        n_rows = CHILDREN * n_hot
        rows = scratch.write(rows.withColumn("p", F.xxhash64("used")).dropDuplicates(["node", "p"]).select("node", "p", "used"), "split", n_rows)
    edges.append(_connected(reduce(DataFrame.unionByName, found), sets))
    return reduce(DataFrame.unionByName, edges)


def _compare(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Number of links and smallest linked set of every set of every tile pair (root, i, j)."""
    for run in _groups(batches, ["root", "i", "j"]):
        root, i, j = (run.column(c).to_numpy() for c in ("root", "i", "j"))
        new = np.ones(run.num_rows + 1, bool)
        new[1:-1] = (root[1:] != root[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        cut = np.flatnonzero(new)
        texts = run.column("shingles")
        copies, tile, nodes = (run.column(c).to_numpy() for c in ("copies", "tile", "node"))
        links, least = np.zeros(run.num_rows, np.int64), np.arange(run.num_rows)
        for start, stop in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            near = _near(texts.slice(start, stop - start), threshold)
            np.fill_diagonal(near, False)
            if i[start] != j[start]:  # the tiles' own pairs are counted where each meets itself
                near &= tile[start:stop][:, None] != tile[start:stop][None, :]
            for lo in range(0, len(near), STRIP):
                links[start + lo : min(stop, start + lo + STRIP)] = near[lo : lo + STRIP] @ copies[start:stop]
            least[start:stop] = start + _labels(near)
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(links), pa.array(nodes[least])], ["node", "links", "least"])
    give_back()


def _near(texts: pa.Array, threshold: float) -> np.ndarray:
    """Which of some sets (their hashes' bytes) are similar: exact, by products of their incidence with shared shingles, in strips."""
    n = len(texts)
    sizes = pa.compute.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) // 8
    own = np.frombuffer(b"".join(texts.to_pylist()), np.uint64)
    order = np.argsort(own, kind="stable")
    row, own = np.repeat(np.arange(n, dtype=np.int32), sizes)[order], own[order]
    new = np.ones(len(own), bool)
    new[1:] = own[1:] != own[:-1]
    del own, order
    many = np.diff(np.append(np.flatnonzero(new), len(new)))
    shared = np.repeat(many > 1, many)
    ids, row = np.cumsum(new & shared)[shared] - 1, row[shared]  # shared shingles are numbered from 0
    common = np.zeros((n, n), np.float32)
    last = int(ids[-1]) + 1 if len(ids) else 0
    for low in range(0, last, PRODUCT):
        lo, hi = np.searchsorted(ids, [low, low + PRODUCT])
        block = np.zeros((n, min(PRODUCT, last - low)), np.float32)
        block[row[lo:hi], ids[lo:hi] - low] = 1
        common += block @ block.T
    near = np.zeros((n, n), bool)
    for lo in range(0, n, STRIP):
        # Similarity is at least the threshold; common counts are whole, so only the right side is rounded.
        near[lo : lo + STRIP] = common[lo : lo + STRIP] * (1 + threshold) >= threshold * (sizes[lo : lo + STRIP, None] + sizes[None, :]) - 1e-6
    return near


def near_duplicates(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, bucket: int = BUCKET, levels: int = LEVELS, tile: int = TILE, tile_bytes: int = TILE_BYTES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, h (hash of the text), class_id, class_key and n_links of every row of ``docs`` (doc_id, text).

    class_id is the smallest doc_id of the row's class, the connected component of links (similarity at least ``threshold``);
    n_links counts the other rows that are linked to it, equal ones included. A null, empty or wordless text is a class of its
    own without links (class_id its doc_id, class_key null). Null doc_ids count as rows but never name a class of others;
    repeated rows are copies of each other. Texts of any length are taken whole: a tile of the comparison is bounded by the bytes of
    its sets, and only a single set beyond ``tile_bytes`` exceeds it. An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    with Scratch(spark, "near") as scratch:
        signed = scratch.write(_signatures(docs, words, threshold, runs_for(recall)), "signatures")
        sets = signed.where("key is not null").groupBy("key").agg(F.min(F.struct("doc_id", "h")).alias("rep"), F.count("*").alias("copies"), F.min("doc_id").alias("least_id"), F.first("size").alias("size"), F.first("paths").alias("paths"), F.first("sketch").alias("sketch"))
        sets = scratch.write(sets.withColumn("node", F.monotonically_increasing_id()), "sets", signed.count())  # numbers are fixed by writing them
        n_sets = sets.count()
        groups = components(_candidates(sets, scratch, bucket, levels), scratch, n_sets * runs_for(recall))
        members = groups.join(sets.select("node", "rep", "copies", "size"), "node")
        members = scratch.write(members.select("node", "root", "copies", "size", F.col("rep.doc_id").alias("doc_id"), F.col("rep.h").alias("h")), "members", n_sets)
        sizes = members.groupBy("root").agg(F.count("*").alias("n"), F.greatest(F.ceil(F.count("*") / tile), F.ceil(F.sum("size") * 8 / tile_bytes)).cast("int").alias("tiles"))
        n_members = members.count()
        members = join_hot(members, sizes, "root", "n", n_members).withColumn("tile", F.pmod(F.xxhash64("node"), "tiles").cast("int"))
        members = members.select("node", "root", "tiles", "copies", "tile", F.col("doc_id").alias("__id"), F.col("h").alias("__h"))
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
        wanted = members if n_members > broadcast_rows else F.broadcast(members)
        chosen = texts.join(wanted, F.col("__id").eqNullSafe(F.col("doc_id")) & (F.col("__h") == F.col("h")))

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first, last, data, offsets in blocks(batch.column("text")):
                    own, bounds = shingles(data, offsets, words)
                    part = batch.slice(first, last - first)
                    sets_of = pa.array([own[bounds[i] : bounds[i + 1]].tobytes() for i in range(last - first)], pa.binary())
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), sets_of], [*names, "shingles"])

        names = ["node", "root", "tiles", "copies", "tile"]
        whole = chosen.select(*names, "text").mapInArrow(cut, "node bigint, root bigint, tiles int, copies bigint, tile int, shingles binary")
        # Each set goes to the pairs of its tile with every tile of the group; repeated rows of one representative are one set.
        dealt = whole.select("*", F.explode(_tile_pairs(F.col("tiles"), F.col("tile"))).alias("ij")).select("node", "root", "copies", "tile", "ij.i", "ij.j", "shingles").dropDuplicates(["node", "i", "j"])
        compared = dealt.repartition(partitions(spark), "root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(lambda b: _compare(b, threshold), "node bigint, links bigint, least bigint")
        compared = scratch.write(compared, "links")
        links = compared.groupBy("node").agg(F.sum("links").alias("links"))
        roots = components(compared.select(F.col("least").alias("a"), F.col("node").alias("b")), scratch, compared.count())
        judged = sets.select("key", "node", "copies", "least_id").join(links, "node", "left").join(roots, "node", "left")
        judged = judged.select("key", "copies", "least_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("class_key"))
        judged = scratch.write(judged, "judged", n_sets)
        classes = judged.groupBy("class_key").agg(F.min("least_id").alias("class_id"), F.count("*").alias("n"))
        judged = scratch.write(join_hot(judged, classes, "class_key", "n", n_sets).select("key", "copies", "class_key", "class_id", "n_links"), "classes", n_sets)
        with_words = signed.where("key is not null").select("doc_id", "h", "key")
        total = judged.agg(F.sum("copies")).first()[0] or 0
        named = join_hot(with_words, judged, "key", "copies", total).select("doc_id", "h", "class_id", "class_key", "n_links")
        alone = signed.where("key is null").select("doc_id", "h", F.col("doc_id").alias("class_id"), F.lit(None).cast("bigint").alias("class_key"), F.lit(0).cast("bigint").alias("n_links"))
        return stored(named.unionByName(alone), "near")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "class_id", "n_links")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of every class, the row with the smallest doc_id (then the text's hash) stays, once; wordless texts stay.

    Null texts are wordless; null doc_ids come after all others. Rows that repeat in both doc_id and text are one document: the one
    whose other columns' hash is smallest stays. All columns of ``docs`` pass through, whatever their names; an empty table gives none.
    """
    found = near_duplicates(docs)
    firsts = found.where("class_key is not null").groupBy("class_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("h").alias("h"))).alias("first"), F.count("*").alias("n"))
    in_class = found.where("class_key is not null")
    judged = join_hot(in_class, firsts, "class_key", "n", in_class.count())
    gone = judged.where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("h") == F.col("first.h")))).select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"), F.lit(False).alias("__twice"))
    twice = in_class.groupBy("doc_id", "h").count().where("count > 1").select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"), F.lit(True).alias("__twice"))
    marks = stored(gone.unionByName(twice).groupBy("__id", "__h").agg(F.min("__twice").alias("__twice")), "marks")
    marks = F.broadcast(marks) if marks.count() <= BROADCAST_ROWS else marks
    here = F.col("__doc").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__h"))
    rows = docs.withColumn("__doc", F.col("doc_id").cast("long")).withColumn("__text", F.xxhash64("text")).join(marks, here, "left")
    left = rows.where("__twice is null").select(*docs.columns)
    if not marks.where("__twice").limit(1).count():
        return left
    # Rows that repeat in both doc_id and text can't be told apart above: one of them stays.
    hashable = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    one = rows.where("__twice").groupBy("__doc", "__text").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*hashable)).alias("row")).select("row.*")
    return left.unionByName(one)


def brute_force(docs: list[tuple], k: int = WORDS, threshold: float = THRESHOLD) -> dict[int, tuple]:
    """doc_id -> (class_id, n_links) for distinct doc_ids, by all pairs; for tests."""
    import re

    sets = {}
    for d, t in docs:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = dict.fromkeys(sets, 0)
    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both >= threshold * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                links[a] += 1
                links[b] += 1
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {d: (find(d), links[d]) for d in sets}


QUERIES = {"op9_jaccard_join": op9_jaccard_join}
ORACLE: dict[str, str] = {}
