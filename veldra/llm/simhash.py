"""Near-duplicate documents: SimHash fingerprints, Golay-code keys, joined and verified.

1. Each document gets a SimHash of its distinct words (weighted by squared length, as
   long words are rare) of ``segments`` x 23 bits, and a second one of 128 bits over its
   word pairs. Documents with equal word sequences are folded into one first.
2. Every 23-bit segment is decoded to the Golay codewords within distance 4 (1 or 6 of
   4096). Two segments with at most two differing bits share a codeword. By pigeonhole,
   fingerprints that differ in at most 3 * (segments - agree + 1) - 1 bits have ``agree``
   segments of at most two errors each, so they meet under some combination of codewords;
   most pairs with more errors meet as well.
3. Fingerprints are shuffled once by (first segment, codeword). Inside such a bucket the
   codewords of the later segments complete the key; candidates are compared on both
   fingerprints, and the accepted links of a bucket are reduced to a spanning forest.
   Buckets of more than ``BUCKET`` fingerprints are split into blocks, each two of which meet
   in a task of their own.
4. Connected components of the links are the groups; the least doc_id stands for each.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from . import golay
from .arrays import U64, as_array, distinct, mix, slices, words
from .classes import fold, grouped, least_ids, split
from .lists import in_blocks, streamed
from .scratch import Scratch, fresh, map_arrow, table

#: (most texts, segments, agree). There is one shape for all tables: longer keys would lose pairs that shorter ones find,
#: so which documents are reported would depend on how many others there are.
SHAPES = ((1 << 62, 6, 2),)
SEGMENTS, AGREE = SHAPES[0][1:]
#: Largest share of differing bits, of the word fingerprint and of the word-pair fingerprint.
MAX_WORD = 0.20
MAX_PAIR = 0.27
PAIR_BITS = 128
#: Runs up to this size are compared all against all at once; larger ones by breadth-first search, which is as exact.
_SMALL = 48
#: Fingerprints of a bucket that are held at once.
BUCKET = 1 << 18


def _signs(doc: np.ndarray, code: np.ndarray, weight: np.ndarray | None, n: int, blocks: int) -> np.ndarray:
    """Sign bits of the weighted sums over each document's distinct codes: (n, 64 * blocks) booleans."""
    if weight is not None:
        code = (code >> U64(4)) | (weight.astype(U64) << U64(60))
    _, code, first = distinct(doc, code, n)
    w = (code >> U64(60)).astype(np.float32) if weight is not None else np.ones(len(code), np.float32)
    sums = np.zeros((n, 64 * blocks), np.float32)
    for k in range(blocks):
        bits = np.unpackbits(mix(code + U64((k + 1) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)).view(np.uint8)).reshape(-1, 64).astype(np.float32)
        for i in range(n):
            if first[i + 1] > first[i]:
                own = w[first[i] : first[i + 1]]
                sums[i, 64 * k : 64 * k + 64] = 2 * (own @ bits[first[i] : first[i + 1]]) - own.sum()
    return sums > 0


def fingerprints(texts: pa.Array, segments: int = SEGMENTS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(segment words (n, segments), pair fingerprint (n, 2) uint64, two hashes of the word sequence (n, 2), words (n))."""
    seg, pair, whole, count = [], [], [], []
    blocks = -(-segments * golay.BITS // 64)
    for a, b in slices(texts, 1 << 19):
        n = b - a
        w = words(texts.slice(a, n))
        size = w.length
        bits = _signs(w.doc, w.hash, np.clip(size * size // 8, 1, 15), n, blocks)[:, : segments * golay.BITS].reshape(n, segments, golay.BITS)
        seg.append(bits @ (1 << np.arange(golay.BITS)))
        same = w.doc[1:] == w.doc[:-1]
        # A text of one word has that word as its only pair.
        single = np.diff(w.first) == 1
        two = np.concatenate((mix(w.hash[:-1] * U64(3) + w.hash[1:])[same], w.hash[w.first[:-1][single]]))
        doc = np.concatenate((w.doc[:-1][same] if len(w.doc) else w.doc, np.flatnonzero(single)))
        pair.append(np.packbits(_signs(doc, two, None, n, PAIR_BITS // 64), axis=1).view(U64))
        order = np.arange(len(w.hash), dtype=np.int64) - w.first[:-1][w.doc]
        both = np.zeros((n, 2), U64)
        for k, salt in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
            term = mix(w.hash + order.astype(U64) * U64(salt))
            full = np.flatnonzero(np.diff(w.first))
            if len(full):
                both[full, k] = np.add.reduceat(term, w.first[:-1][full])
        whole.append(both)
        count.append(np.diff(w.first))
    if not seg:
        return np.zeros((0, segments), np.int64), np.zeros((0, 2), U64), np.zeros((0, 2), U64), np.zeros(0, np.int64)
    return np.concatenate(seg), np.concatenate(pair), np.concatenate(whole), np.concatenate(count)


def _sketch(segments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seg, pair, whole, count = fingerprints(as_array(batch.column(1)), segments)
            keep = np.flatnonzero(count > 0)
            packed = np.concatenate((seg.astype(np.uint32).view(np.uint8).reshape(len(seg), -1), pair.view(np.uint8).reshape(len(pair), -1)), axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keep)), pa.array(whole[keep, 0].view(np.int64)), pa.array(whole[keep, 1].view(np.int64)), _binary(packed[keep])],
                ["id", "h1", "h2", "sketch"],
            )

    return run


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as an Arrow binary column."""
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def _unbinary(column: pa.Array, width: int) -> np.ndarray:
    data = np.frombuffer(column.buffers()[2], np.uint8) if len(column) else np.zeros(0, np.uint8)
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset] if len(column) else 0
    return data[at : at + len(column) * width].reshape(-1, width)


def _spread(segments: int, agree: int):
    """A row for each codeword of the segments that can come first in a combination."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _unbinary(as_array(batch.column(1)), 4 * segments + PAIR_BITS // 8)
            seg = np.ascontiguousarray(rows[:, : 4 * segments]).view(np.uint32)
            for s in range(segments - agree + 1):
                codes = golay.keys(seg[:, s])
                at, _ = np.nonzero(codes >= 0)
                bucket = s * 4096 + codes[codes >= 0].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(bucket), batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at))], ["bucket", "id", "sketch"])

    return run


def _far(a: np.ndarray, b: np.ndarray, segments: int, max_word: float, max_pair: float) -> np.ndarray:
    """True where two sketches (as uint32 words) differ too much to be near duplicates."""
    differ = np.bitwise_count(a ^ b)
    return (differ[..., :segments].sum(-1, dtype=np.int32) > max_word * segments * golay.BITS) | (differ[..., segments:].sum(-1, dtype=np.int32) > max_pair * PAIR_BITS)


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Which of the edges form a spanning forest of the graph on n nodes."""
    root = list(range(n))
    keep = np.zeros(len(a), bool)
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        while root[x] != x:
            root[x] = x = root[root[x]]
        while root[y] != y:
            root[y] = y = root[root[y]]
        if x != y:
            root[x] = y
            keep[k] = True
    return keep


def bucket_links(segment: int, sketch: np.ndarray, segments: int, agree: int, max_word: float, max_pair: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (a, b) of a spanning forest over the near duplicates that meet in one bucket."""
    n = len(sketch)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    codes = {s: golay.keys(sketch[:, s]).astype(np.int64) for s in range(segment + 1, segments)}
    for later in combinations(range(segment + 1, segments), agree - 1):
        key = np.zeros((n, 1), np.int64)
        for s in later:
            key = np.where((key[:, :, None] < 0) | (codes[s][:, None, :] < 0), -1, key[:, :, None] * 4096 + codes[s][:, None, :]).reshape(n, -1)
        row, _ = np.nonzero(key >= 0)
        order = np.argsort(key[key >= 0], kind="stable")
        row, key = row[order], key[key >= 0][order]
        bound = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        size = np.diff(bound)
        for m in np.unique(size[(size > 1) & (size <= _SMALL)]).tolist():
            rows = row[bound[:-1][size == m][:, None] + np.arange(m)]
            i, j = np.triu_indices(m, 1)
            step = max(1, (1 << 20) // len(i))
            for at in range(0, len(rows), step):
                a, b = rows[at : at + step][:, i].ravel(), rows[at : at + step][:, j].ravel()
                near = ~_far(sketch[a], sketch[b], segments, max_word, max_pair)
                found.append((a[near], b[near]))
        for first, m in zip(bound[:-1][size > _SMALL].tolist(), size[size > _SMALL].tolist()):
            rest = row[first : first + m]
            while len(rest):
                front, rest = [rest[0]], rest[1:]
                while front and len(rest):
                    at = front.pop()
                    near = ~_far(sketch[at], sketch[rest], segments, max_word, max_pair)
                    if near.any():
                        found.append((np.full(int(near.sum()), at), rest[near]))
                        front += rest[near].tolist()
                        rest = rest[~near]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = (np.concatenate(x) for x in zip(*found))
    edge = np.unique(np.minimum(a, b).astype(np.int64) << 32 | np.maximum(a, b))
    a, b = edge >> 32, edge & 0xFFFFFFFF
    keep = _forest(a, b, n)
    return a[keep], b[keep]


def _link(segments: int, agree: int, max_word: float, max_pair: float, limit: int | None):
    """Links (a, b) of each bucket; rows (bucket, id, sketch) come sorted by bucket.

    Rows of buckets of more than ``limit`` come back as they are, (bucket, id, sketch). Without a limit the buckets are those of ``in_blocks``.
    """
    width = 4 * segments + PAIR_BITS // 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, bound in streamed(batches, 1 if limit is not None else 3, limit):
            if bound is None:
                yield pa.RecordBatch.from_arrays([columns[0].cast(pa.int64()), columns[1], columns[2]], ["a", "b", "sketch"])
                continue
            bucket, ids, sketch = columns[0].to_numpy(), columns[-2].to_numpy(), np.ascontiguousarray(_unbinary(columns[-1], width)).view(np.uint32)
            for first, last in zip(bound[:-1].tolist(), bound[1:].tolist()):
                if last - first > 1:
                    a, b = bucket_links(int(bucket[first]) // 4096, sketch[first:last], segments, agree, max_word, max_pair)
                    own = ids[first:last]
                    yield pa.RecordBatch.from_arrays([pa.array(own[a], pa.int64()), pa.array(own[b], pa.int64()), pa.nulls(len(a), pa.binary())], ["a", "b", "sketch"])

    return run


def _id(docs: DataFrame) -> Column:
    """doc_id as a bigint; a number with a fraction raises, as without it it would stand for another document."""
    whole = F.col("doc_id").cast("bigint")
    if isinstance(docs.select("doc_id").schema[0].dataType, T.FractionalType):
        return F.when(whole != F.col("doc_id"), F.raise_error(F.lit("doc_id must be a whole number"))).otherwise(whole)
    return whole


def near_duplicates(docs: DataFrame, segments: int | None = None, agree: int | None = None, max_word: float = MAX_WORD, max_pair: float = MAX_PAIR) -> DataFrame:
    """(doc_id, duplicate_of) for each document that has a near duplicate with a smaller doc_id in its group.

    ``duplicate_of`` is the least doc_id of the group. Words are runs of letters and digits in lower case,
    so case, spacing and punctuation make no difference. Segments and agree are those of SHAPES where they aren't given,
    for tables of any size.

    Defined results: rows whose doc_id is null, or whose text is null or has no word, are never reported.
    Rows that share a doc_id are one document (it may belong to several groups only if their texts differ;
    the groups are then one). Equal texts are always grouped. Texts of any length are read whole. An empty
    table gives no rows. Columns besides doc_id and text are ignored, whatever their names. doc_id must be a whole number.
    """
    if (segments is None) != (agree is None) or segments is not None and not 1 <= agree <= segments:
        raise ValueError("agree must lie between 1 and segments, and both be given or neither")
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(_id(docs).alias("id"), F.col("text").cast("string").alias("text")).where("id is not null and text is not null")
    if segments is None:
        segments, agree = SHAPES[0][1:]
    sketches = scratch.save(map_arrow(rows, _sketch(segments), "id bigint, h1 bigint, h2 bigint, sketch binary"), "sketches")
    members, classes = fold(sketches, "sketch", scratch)
    classes = scratch.save(classes, "classes")
    scratch.drop("sketches")
    # One partition sees each bucket whole; sorting spills, and the Python side streams bucket by bucket.
    spread = map_arrow(classes, _spread(segments, agree), "bucket int, id bigint, sketch binary")
    schema, options = "a bigint, b bigint, sketch binary", (segments, agree, max_word, max_pair)
    links = scratch.save(map_arrow(spread.repartition("bucket").sortWithinPartitions("bucket"), _link(*options, BUCKET), schema), "links")
    edges, long = links.where("sketch is null").select("a", "b"), links.where("sketch is not null")
    if not long.isEmpty():
        again = in_blocks(long.select(F.col("a").alias("bucket"), F.col("b").alias("id"), "sketch"), "bucket", "id", BUCKET // 2).select("bucket", "x", "y", "id", "sketch")
        edges = edges.union(map_arrow(again, _link(*options, None), schema).select("a", "b"))
    least = least_ids(members, grouped(edges, members, scratch))
    scratch.drop("classes", "links")
    return members.join(least, F.col("class") == F.col("member"), "left").select(F.col("id").alias("doc_id"), F.coalesce("of", "root").alias("duplicate_of")).where("doc_id <> duplicate_of").distinct()


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The documents without those that ``near_duplicates`` reports: one of each group stays, columns unchanged whatever their names.

    All rows of a doc_id stay or go together; rows whose doc_id is null stay.
    """
    name, key = fresh(docs, "gone_", "id_")
    scratch = Scratch(docs.sparkSession)
    gone = scratch.save(near_duplicates(docs, **options).select(F.col("doc_id").alias(name)), "gone")
    # Most rows surely stay, and are neither joined nor shuffled. Filter and join see the ids as near_duplicates does.
    sure, rest = split(docs.select("*", _id(docs).alias(key)), gone, key)
    kept = rest.join(gone, F.col(key) == F.col(name), "left_anti")
    return (kept if sure is None else sure.union(kept)).drop(key)


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
