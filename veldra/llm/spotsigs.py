"""SpotSigs document fingerprints, and near duplicates by their Jaccard similarity.

A spot is an anchor (a very common word) with the chain of the next ``CHAIN`` content words.
Anchors stand all over natural prose and rarely in menus and adverts, so the set of a page's
spots says what its body says. Documents of equal sets are one class. Two classes match if the
Jaccard similarity of their sets is at least ``threshold``. Groups are the connected components
of all matching pairs, found exactly:

1. Classes with a common pair of min-hash values are compared with the one of least id among them.
   That is cheap, and joins nearly all that belongs together.
2. What is left is searched in full, but only between groups of the first round. Sets are put in
   one order, rare spots first (by the counts of all spots hashed into a table; any order would
   do). Two sets that match share at least l spots among the first n - ceil(threshold * n) + l
   of either, so only those are shuffled, with l growing with n. Sets are partitioned by length
   so that one can only match sets of its own partition and the next; lists are kept by
   (partition, spot), and sets near the upper end of a partition are guests in the next one's.
   Within a list classes are ordered by set length, and each meets only the stretch whose
   length allows the threshold. Bitmaps and the places of the shared spot bound the overlap from
   above; pairs whose shared listed spots, with all that may follow the last of them, don't reach
   the threshold are dropped; the rest is compared in full. Lists longer than ``LIST`` are set
   aside and met in blocks, each two blocks in a task of their own.
3. Every matching pair lies within a group. The sets of each group are brought together once and
   all of its pairs are compared, which gives each class its number of links. Groups of more than
   ``BLOCK`` classes are split into blocks like the lists.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .arrays import U64, as_array, buffers, distinct, mix, row_sums, slices, words
from .classes import fold, grouped, least_ids, linked, split
from .components import components
from .lists import in_blocks, streamed
from .scratch import Scratch, map_arrow, table

ANCHORS = {
    "en": "a an the is are was that this there",
    "fr": "le la les un une est que ce",
    "de": "der die das ein eine ist dass war",
    "es": "el la los un una es que fue",
}
STOP = {
    "en": "and or of to in on at by for with from as be been it its he she they we you i his her their our not but have has had were will would can do did so if no all one what which who when",
    "fr": "de des du et en dans par pour sur au aux ne pas il elle ils se son sa ses qui mais ou donc plus avec sans cette ces nous vous je",
    "de": "und in zu den von mit sich des auf für im dem nicht auch als an er sie es wie bei aus nach wird sind wir ich ihr oder aber nur noch zum zur",
    "es": "de del y a en por con para se no lo las su sus al como más pero o este esta son ser ha han le les mi si sin sobre",
}
CHAIN = 2
THRESHOLD = 0.6
MIN_SPOTS = 4
#: Pairs of min-hash values a document in the first round.
TABLES = 8
#: A further spot of the lists has to be shared for every so many of a set.
SHARE = 16
#: Table of spot counts, from which the common order is made.
CELLS = 1 << 17
BITMAP = 64
#: A length partition spans a factor of threshold ** -STEPS.
STEPS = 4
#: Rows of a list that are met in one task; longer lists are split into blocks of half as many.
LIST = 4000
#: Documents of a group that are compared at once; larger groups are split.
BLOCK = 2000
#: Rows of whole groups that a worker gathers before it compares them.
GATHER = 2000


def _hashes(lists: dict[str, str]) -> np.ndarray:
    return np.unique(words(pa.array(sorted({w for x in lists.values() for w in x.split()}))).hash)


_ANCHORS = _hashes(ANCHORS)
_COMMON = np.union1d(_ANCHORS, _hashes(STOP))


def _among(codes: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, codes), len(known) - 1)] == codes


def spots(texts: pa.Array, chain: int = CHAIN) -> tuple[np.ndarray, np.ndarray]:
    """(spots of 48 bits, bounds): ``spots[bounds[i]:bounds[i + 1]]`` is the sorted set of text i."""
    out, sizes = [], []
    for a, b in slices(texts):
        w = words(texts.slice(a, b - a))
        common = _among(w.hash, _COMMON) if len(w.hash) else np.zeros(0, bool)
        anchor = np.flatnonzero(common)
        anchor = anchor[_among(w.hash[anchor], _ANCHORS)] if len(anchor) else anchor
        content = np.flatnonzero(~common)
        at = np.searchsorted(content, anchor)
        ok = at + chain <= len(content)
        anchor, at = anchor[ok], at[ok]
        ok = w.doc[content[at + chain - 1]] == w.doc[anchor]
        anchor, at = anchor[ok], at[ok]
        code = w.hash[anchor]
        for k in range(chain):
            code = mix(code * U64(5) + w.hash[content[at + k]])
        _, code, first = distinct(w.doc[anchor], code, b - a)
        out.append(code >> U64(16))
        sizes.append(np.diff(first))
    flat = np.concatenate(out) if out else np.zeros(0, U64)
    return flat, np.concatenate(([0], np.cumsum(np.concatenate(sizes)))).astype(np.int64) if sizes else np.zeros(1, np.int64)


def _pack(codes: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Sets of 48-bit codes as binary values of 6 bytes a code."""
    data = np.ascontiguousarray(codes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * 6).astype(np.int32)), pa.py_buffer(data)])


def _unpack(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, bounds = buffers(as_array(column))
    codes = np.zeros((len(data) // 6, 8), np.uint8)
    codes[:, :6] = data.reshape(-1, 6)
    return codes.reshape(-1).view("<u8"), bounds // 6


def sequence_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(two hashes of each text's sequence of words (n, 2), its number of words)."""
    out, sizes = [], []
    for a, b in slices(texts):
        w = words(texts.slice(a, b - a))
        place = np.arange(len(w.hash), dtype=np.int64) - w.first[:-1][w.doc]
        keyed = mix(w.hash + mix(place.astype(U64)))
        out.append(np.stack([mix(row_sums(mix(keyed + U64(k)), w.first)) for k in (1, 2)], 1))
        sizes.append(np.diff(w.first))
    return (np.concatenate(out), np.concatenate(sizes)) if out else (np.zeros((0, 2), U64), np.zeros(0, np.int64))


def _sign(chain: int, least: int, copies: bool):
    """(id, h1, h2, spots): the set and two hashes of it; for texts of fewer spots no set, and hashes of their words in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_array(batch.column(1))
            codes, bounds = spots(texts, chain)
            size = np.diff(bounds)
            code_hash = np.stack([row_sums(mix(codes + U64(k << 50)), bounds) for k in (1, 2)], 1).astype(U64)
            some = size >= least
            few = np.flatnonzero(~some)
            whole, count = sequence_hashes(texts.take(pa.array(few)))
            code_hash[few] = whole
            keep = np.flatnonzero(some | np.isin(np.arange(len(size)), few[count > 0]) if copies else some)
            codes, kept = codes[np.repeat(some, size)], np.where(some, size, 0)[keep]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keep)), *(pa.array(code_hash[keep, k].view(np.int64)) for k in range(2)), _pack(codes, np.concatenate(([0], np.cumsum(kept))))], ["id", "h1", "h2", "spots"]
            )

    return run


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(CELLS, np.int64)
    for batch in batches:
        counts += np.bincount((_unpack(batch.column(0))[0] % U64(CELLS)).astype(np.int64), minlength=CELLS)
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["cell", "n"])


def _minima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        codes, bounds = _unpack(batch.column(1))
        least = [np.minimum.reduceat(mix(codes + U64((t + 1) << 50)), bounds[:-1]) for t in range(2 * TABLES)]
        keys = [mix(mix(a) + b + U64(t)).view(np.int64) for t, (a, b) in enumerate(zip(least[::2], least[1::2]))]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.concat_arrays([batch.column(0)] * TABLES)], ["key", "id"])


def list_length(n: np.ndarray, threshold: float) -> np.ndarray:
    """How many spots of a set of n are listed."""
    return np.minimum(n, n - np.ceil(threshold * n - 1e-9) + least_shared(n)).astype(np.int64)


def least_shared(n: np.ndarray) -> np.ndarray:
    """How many listed spots two matching sets share, if the smaller of both values is taken."""
    return 1 + n // SHARE


def length_part(n: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(length partition of sets of n spots, whether they can match sets of the next one)."""
    ratio = max(threshold**-STEPS, 1.01)
    part = np.floor(np.log(np.maximum(n, 1)) / np.log(ratio) + 1e-9).astype(np.int64)
    # A little too many guests do no harm.
    return part, n / threshold >= ratio ** (part + 1.0) * (1 - 1e-6)


def _lists(order_, threshold: float):
    """A row for each listed spot: (key, set length and place of the spot in the set, id, label, bitmap of the whole set).

    The key is the length partition and the spot.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = np.frombuffer(order_.value, np.int32)
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                rows = batch.slice(a, 512)
                codes, bounds = _unpack(rows.column(2))
                n = np.diff(bounds)
                doc = np.repeat(np.arange(len(n)), n)
                bits = np.zeros((len(n), BITMAP), bool)
                bits[doc, (mix(codes) % U64(BITMAP)).astype(np.int64)] = True
                bitmap = np.packbits(bits, axis=1).view(np.int64)[:, 0]
                # Rank in the common order: cell, then code (codes are sorted within a set, and the sort is stable).
                rank = np.argsort(doc << 32 | order[(codes % U64(CELLS)).astype(np.int64)], kind="stable")
                place = np.arange(len(codes)) - np.repeat(bounds[:-1], n)
                chosen = place < np.repeat(list_length(n, threshold), n)
                codes, doc, place = codes[rank][chosen], doc[chosen], place[chosen]
                part, guest = length_part(n, threshold)
                key, at = codes.astype(np.int64) | part[doc] << 48, np.arange(len(doc))
                again = np.flatnonzero(guest[doc])
                key, at = np.concatenate((key, key[again] + (1 << 48))), np.concatenate((at, again))
                doc, place = doc[at], place[at]
                take = pa.array(doc)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n[doc] << 32 | place), rows.column(0).take(take), rows.column(1).take(take), pa.array(bitmap[doc])], ["key", "place", "id", "label", "bitmap"])

    return run


def _possible(n: np.ndarray, bitmap: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether lengths and bitmaps allow rows a and b to match."""
    x, y = bitmap.view(U64)[a], bitmap.view(U64)[b]  # bits of signed numbers would be counted in their absolute value
    only_a = np.bitwise_count(x & ~y).astype(np.int64)
    only_b = np.bitwise_count(y & ~x).astype(np.int64)
    most = np.minimum(n[a] - only_a, n[b] - only_b)
    return most >= threshold * (n[a] + n[b] - most) - 1e-9


def needed_overlap(n: np.ndarray, m: np.ndarray, threshold: float) -> np.ndarray:
    return np.ceil(threshold / (1 + threshold) * (n + m) - 1e-9).astype(np.int64)


def run_pairs(n: np.ndarray, place: np.ndarray, label: np.ndarray, bitmap: np.ndarray, native: np.ndarray, block: np.ndarray | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (a, b) of one list, ordered by set length, that may match and have different labels, some at a time.

    Two guests don't meet, as they do so in their own partition; with blocks only rows of different ones do.
    """
    values, at, count = np.unique(label, return_inverse=True, return_counts=True)
    if len(values) == 1:
        return
    # Pairs within the commonest label never have to be looked at: every pair has a row of another label.
    is_minor = at != count.argmax()
    minor = np.flatnonzero(is_minor)
    low, high = np.searchsorted(n, np.ceil(n[minor] * threshold - 1e-9), "left"), np.searchsorted(n, np.floor(n[minor] / threshold + 1e-9), "right")
    span = high - low
    ends = np.cumsum(span)
    first = 0
    while first < len(minor):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + (1 << 18), "right")))
        size = span[first:last]
        a = np.repeat(minor[first:last], size)
        b = np.arange(len(a)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low[first:last], size)
        ok = (label[a] != label[b]) & (~is_minor[b] | (a < b)) & (native[a] | native[b])
        if block is not None:
            ok &= block[a] != block[b]
        a, b = a[ok], b[ok]
        ok = (np.minimum(place[a], place[b]) + 1 + np.minimum(n[a] - place[a], n[b] - place[b]) - 1 >= needed_overlap(n[a], n[b], threshold)) & _possible(n, bitmap, a, b, threshold)
        yield a[ok], b[ok]
        first = last


_MET = "a bigint, b bigint, shared bigint, rest_a bigint, rest_b bigint, least bigint, overlap bigint, kind int"


def _counted(n: np.ndarray, place: np.ndarray, ids: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> pa.RecordBatch:
    """Pairs of ids (a < b): spots shared here, spots of either after the last of them, how many must be shared in the lists and in all."""
    turned = ids[a] > ids[b]
    a, b = np.where(turned, b, a), np.where(turned, a, b)
    order = np.lexsort((ids[b], ids[a]))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.concatenate(([True], (ids[a][1:] != ids[a][:-1]) | (ids[b][1:] != ids[b][:-1])))) if len(a) else np.zeros(0, np.int64)
    shared = np.diff(np.append(first, len(a)))
    rest = [np.minimum.reduceat(n[x] - 1 - place[x], first) if len(a) else first for x in (a, b)]
    a, b = a[first], b[first]
    columns = [ids[a], ids[b], shared, *rest, np.minimum(least_shared(n[a]), least_shared(n[b])), needed_overlap(n[a], n[b], threshold)]
    return pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int64)) for c in columns), pa.array(np.zeros(len(a), np.int32))], [x.split()[0] for x in _MET.split(", ")])


def _meet(threshold: float, limit: int | None):
    """What meets in the lists, which come sorted by key and set length: rows of ``_counted`` (kind 0).

    Rows of lists longer than ``limit`` come back as they are (kind 1). Without a limit the lists are those of ``in_blocks``.
    """

    def lists(key, n, place, ids, label, bitmap, block, cross, bound) -> Iterator[pa.RecordBatch]:
        """All lists between the bounds; lists of two, the most common, at once."""
        native = length_part(n, threshold)[0] == key >> 48
        size = np.diff(bound)
        a = bound[:-1][size == 2]
        b = a + 1
        ok = (label[a] != label[b]) & (n[a] >= np.ceil(n[b] * threshold - 1e-9)) & (native[a] | native[b])
        if block is not None:
            ok &= ~cross[a] | (block[a] != block[b])
        a, b = a[ok], b[ok]
        ok = (np.minimum(place[a], place[b]) + np.minimum(n[a] - place[a], n[b] - place[b]) >= needed_overlap(n[a], n[b], threshold)) & _possible(n, bitmap, a, b, threshold)
        found, many = [(a[ok], b[ok])], 0
        for first, last in zip(bound[:-1][size > 2].tolist(), bound[1:][size > 2].tolist()):
            own = slice(first, last)
            for a, b in run_pairs(n[own], place[own], label[own], bitmap[own], native[own], block[own] if block is not None and cross[first] else None, threshold):
                if len(a):
                    found.append((a + first, b + first))
                    many += len(a)
                if many > 1 << 19:
                    yield _counted(n, place, ids, *(np.concatenate(x) for x in zip(*found)), threshold)
                    found, many = [], 0
        if found:
            yield _counted(n, place, ids, *(np.concatenate(x) for x in zip(*found)), threshold)

    names = [x.split()[0] for x in _MET.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, bound in streamed(batches, 1 if limit is not None else 3, limit):
            if bound is None:
                zero = pa.array(np.zeros(len(columns[0]), np.int64))
                yield pa.RecordBatch.from_arrays([*columns, zero, zero, pa.array(np.ones(len(columns[0]), np.int32))], names)
                continue
            key, *rest = (c.to_numpy() for c in columns)
            (x, y, block), rest = (rest[:3], rest[3:]) if limit is None else ((None, None, None), rest)
            both, ids, label, bitmap = rest
            yield from lists(key, both >> 32, both & 0xFFFFFFFF, ids, label, bitmap, block, None if x is None else x != y, bound)

    return run


def _verify(threshold: float):
    """The pairs whose sets match."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1 << 12):
                batch = whole.slice(at, 1 << 12)
                (x, i), (y, j) = _unpack(batch.column(2)), _unpack(batch.column(3))
                n, m = np.diff(i), np.diff(j)
                pair = np.concatenate((np.repeat(np.arange(len(n)), n), np.repeat(np.arange(len(m)), m))).astype(U64)
                key = np.sort(pair << U64(48) | np.concatenate((x, y)))
                both = np.bincount((key[1:][key[1:] == key[:-1]] >> U64(48)).astype(np.int64), minlength=len(n))
                ok = pa.array(np.flatnonzero(both >= threshold * (n + m - both) - 1e-9))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(ok), batch.column(1).take(ok)], ["a", "b"])

    return run


def _similar(threshold: float, cell: np.ndarray, block: np.ndarray, split: np.ndarray, ids: np.ndarray, codes: np.ndarray, bounds: np.ndarray):
    """(rows a, rows b, Jaccard) of the matching pairs within each cell; in a split cell only those across its two blocks."""
    n = np.diff(bounds)
    order = np.lexsort((n, cell))
    size = n[order]
    _, codes = np.unique(codes[np.repeat(bounds[:-1][order] - np.cumsum(size) + size, size) + np.arange(len(codes))], return_inverse=True)
    ends = np.cumsum(size)
    starts = ends - size
    cell, block, split, ids = cell[order], block[order], split[order], ids[order]
    # Partners of a row: the following ones of its cell whose length allows the threshold.
    wide = int(size.max()) + 1
    last = np.searchsorted(cell * wide + size, cell * wide + np.minimum(np.floor(size / threshold + 1e-9).astype(np.int64), wide - 1), "right")
    mark = np.zeros(int(codes.max()) + 1, np.int32)
    out_a, out_b, out_j = [], [], []
    for r in np.flatnonzero(last > np.arange(len(size)) + 1).tolist():
        own = codes[starts[r] : ends[r]]
        mark[own] = 1
        lo, hi = r + 1, int(last[r])
        shared = np.add.reduceat(mark[codes[starts[lo] : ends[hi - 1]]], starts[lo:hi] - starts[lo])
        mark[own] = 0
        jaccard = shared / (size[r] + size[lo:hi] - shared)
        ok = (shared >= threshold * (size[r] + size[lo:hi] - shared) - 1e-9) & (ids[lo:hi] != ids[r])
        if split[r]:
            ok &= block[lo:hi] != block[r]
        at = np.flatnonzero(ok)
        out_a.append(np.full(len(at), r))
        out_b.append(at + lo)
        out_j.append(jaccard[at])
    if not out_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return order[np.concatenate(out_a)], order[np.concatenate(out_b)], np.concatenate(out_j)


_CELL = ["root", "x", "y", "block", "id", "spots"]


def _within(threshold: float, gather: int, links: bool):
    """The matching pairs of each group (a, b, jaccard, root), or with ``links`` each class's number of them and its nearest (id, links, nearest, root).

    Rows (root, x, y, block, id, spots) come sorted by cell (root, x, y).
    """

    def pairs(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(rows).combine_chunks()
        root, x, y, block, ids = (as_array(whole.column(k)).to_numpy() for k in range(5))
        codes, bounds = _unpack(whole.column(5))
        new = (root[1:] != root[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        a, b, jaccard = _similar(threshold, np.concatenate(([0], np.cumsum(new))), block, x != y, ids, codes, bounds)
        if not links:
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[a], ids[b])), pa.array(np.maximum(ids[a], ids[b])), pa.array(np.round(jaccard, 6)), pa.array(root[a])], ["a", "b", "jaccard", "root"])
        count = np.bincount(a, minlength=len(ids)) + np.bincount(b, minlength=len(ids))
        nearest = np.zeros(len(ids))
        for end in (a, b):
            np.maximum.at(nearest, end, jaccard)
        some = np.flatnonzero(count)
        return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(count[some]), pa.array(np.round(nearest[some], 6)), pa.array(root[some])], ["id", "links", "nearest", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for columns, bound in streamed(batches, 3, None):
            for first, last in zip(bound[:-1].tolist(), bound[1:].tolist()):
                if count and count + last - first > gather:
                    yield pairs(held)
                    held, count = [], 0
                held.append(pa.RecordBatch.from_arrays([c.slice(first, last - first) for c in columns], _CELL))
                count += last - first
        if count:
            yield pairs(held)

    return run


class _Search:
    def __init__(self, spark: SparkSession, scratch: Scratch, threshold: float):
        self.spark, self.scratch, self.threshold = spark, scratch, threshold

    def matching(self, pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b) whose sets match; only sets that a pair names are shuffled."""
        pairs = self.scratch.save(pairs, f"{name}-pairs")
        _, some = split(sets, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
        left, right = some.select(F.col("id").alias("a"), F.col("spots").alias("sa")), some.select(F.col("id").alias("b"), F.col("spots").alias("sb"))
        found = map_arrow(pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb"), _verify(self.threshold), "a bigint, b bigint")
        found = self.scratch.save(found, name)
        self.scratch.drop(f"{name}-pairs")
        return found


def _check(threshold: float, min_spots: int) -> None:
    if not 0 < threshold <= 1 or min_spots < 1:
        raise ValueError("threshold must lie in (0, 1], min_spots be positive")


def _classes(docs: DataFrame, search: _Search, chain: int, min_spots: int, copies: bool) -> tuple[DataFrame, DataFrame]:
    """(members, sets): the class of each document (id, class, copies), and each class's set (id, spots), if it has one.

    What names a class is told in ``fold``.
    """
    scratch = search.scratch
    rows = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text")).where("id is not null and text is not null")
    signed = scratch.save(map_arrow(rows, _sign(chain, min_spots, copies), "id bigint, h1 bigint, h2 bigint, spots binary"), "signed")
    members, sets = fold(signed, "spots", scratch)
    sets = scratch.save(sets.where("length(spots) > 0"), "sets")
    scratch.drop("signed")
    return members, sets


def _groups(search: _Search, members: DataFrame, sets: DataFrame) -> DataFrame:
    """(class, root): the classes of every group of more than one; root is the least class."""
    spark, scratch, threshold = search.spark, search.scratch, search.threshold
    # First round: everyone with the least id under each pair of min-hash values.
    minima = map_arrow(sets, _minima, "key bigint, id bigint")
    least = minima.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("k")).where("k > 1").select(F.col("key").alias("shared"), "least")
    stars = minima.join(least, F.col("key") == F.col("shared")).where("id > least").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct()
    found = search.matching(stars, sets, "first")
    labels = scratch.save(components(found, scratch, "labels").select(F.col("id").alias("member"), F.col("root").alias("label")), "label-table")
    # Second round: all that may match across the groups so far.
    counts = np.zeros(CELLS, np.int64)
    got = map_arrow(sets.select("spots"), _tally, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts[got["cell"].to_numpy()] = got["n"].to_numpy()
    order = np.empty(CELLS, np.int32)
    order[np.argsort(counts, kind="stable")] = np.arange(CELLS)
    alone, joined = split(sets, labels.select("member"))
    labelled = joined.join(labels, F.col("id") == F.col("member"), "left").select("id", F.coalesce("label", "id").alias("label"), "spots")
    if alone is not None:
        labelled = labelled.union(alone.select("id", F.col("id").alias("label"), "spots"))
    listed = map_arrow(labelled, _lists(spark.sparkContext.broadcast(order.tobytes()), threshold), "key bigint, place bigint, id bigint, label bigint, bitmap bigint")
    met = scratch.save(map_arrow(listed.repartition("key").sortWithinPartitions("key", "place"), _meet(threshold, LIST), _MET), "met")
    pairs, long = met.where("kind = 0"), met.where("kind = 1")
    if not long.isEmpty():
        rows = long.select(*(F.col(c).alias(n) for c, n in zip(("a", "b", "shared", "rest_a", "rest_b"), ("key", "place", "id", "label", "bitmap"))))
        pairs = pairs.union(map_arrow(in_blocks(rows, "key", "id", LIST // 2, "place"), _meet(threshold, None), _MET))
    pairs = pairs.groupBy("a", "b").agg(*(f(c).alias(c) for f, c in ((F.sum, "shared"), (F.min, "rest_a"), (F.min, "rest_b"), (F.min, "least"), (F.min, "overlap"))))
    pairs = pairs.where((F.col("shared") >= F.col("least")) & (F.col("shared") + F.least("rest_a", "rest_b") >= F.col("overlap"))).select("a", "b")
    groups = grouped(found.union(search.matching(pairs, sets, "second")), members, scratch)
    scratch.drop("met", "first", "second", "label-table")
    return groups


def _compared(search: _Search, groups: DataFrame, sets: DataFrame, links: bool) -> DataFrame:
    """What ``_within`` finds in the groups."""
    _, some = split(sets, groups.select("class"))
    rows = some.join(groups, F.col("id") == F.col("class")).select("root", "id", "spots")
    schema = "id bigint, links bigint, nearest double, root bigint" if links else "a bigint, b bigint, jaccard double, root bigint"
    return map_arrow(in_blocks(rows, "root", "id", BLOCK), _within(search.threshold, GATHER, links), schema)


def similar_documents(docs: DataFrame, threshold: float = THRESHOLD, chain: int = CHAIN, min_spots: int = MIN_SPOTS) -> DataFrame:
    """(doc_id, duplicate_of) for each document with a matching one of smaller doc_id in its group.

    ``duplicate_of`` is the least doc_id of the group, a connected component of the matching pairs.

    Defined results: rows whose doc_id is null, whose text is null, or whose set has fewer than ``min_spots`` spots
    (as empty and very short texts) are left out. Rows that share a doc_id are one document; if their texts differ,
    it matches what any of them matches. Texts of any length are read whole. An empty table gives no rows. Other
    columns are ignored. doc_id must be a number.
    """
    _check(threshold, min_spots)
    search = _Search(docs.sparkSession, Scratch(docs.sparkSession), threshold)
    members, sets = _classes(docs, search, chain, min_spots, False)
    least = least_ids(members, _groups(search, members, sets))
    return members.join(least, F.col("class") == F.col("member"), "left").select(F.col("id").alias("doc_id"), F.coalesce("of", "root").alias("duplicate_of")).where("doc_id <> duplicate_of").distinct()


def similar_pairs(docs: DataFrame, threshold: float = THRESHOLD, chain: int = CHAIN, min_spots: int = MIN_SPOTS) -> DataFrame:
    """(class_a, class_b, jaccard): every matching pair of classes, class_a < class_b; ``similar_classes`` has their members."""
    _check(threshold, min_spots)
    search = _Search(docs.sparkSession, Scratch(docs.sparkSession), threshold)
    members, sets = _classes(docs, search, chain, min_spots, True)
    return _compared(search, _groups(search, members, sets), sets, False).select(F.col("a").alias("class_a"), F.col("b").alias("class_b"), "jaccard")


def similar_classes(docs: DataFrame, threshold: float = THRESHOLD, chain: int = CHAIN, min_spots: int = MIN_SPOTS) -> DataFrame:
    """(doc_id, class_id, copies, links, nearest, duplicate_of) for each document with a copy or a matching one.

    Documents of equal sets are one class, named by its least doc_id (by a negative number where that doc_id has several
    texts); ``copies`` is its number of documents, ``links`` the number of other classes that match it, all counted,
    ``nearest`` the largest Jaccard value among them (null without any), ``duplicate_of`` the least doc_id of the group,
    a connected component of matches.

    Defined results: rows whose doc_id or text is null, and texts without words, are left out. Documents with fewer than
    ``min_spots`` spots, too few to tell texts apart, are a class with those of the same sequence of words, and match no
    other. Rows that share a doc_id and a set are one document; if their texts differ there is a row for each class, and
    the classes are one group. Texts of any length are read whole. An empty table gives no rows. Other columns are
    ignored. doc_id must be a number.
    """
    _check(threshold, min_spots)
    search = _Search(docs.sparkSession, Scratch(docs.sparkSession), threshold)
    members, sets = _classes(docs, search, chain, min_spots, True)
    groups = _groups(search, members, sets)
    counted = _compared(search, groups, sets, True).groupBy("id").agg(F.sum("links").alias("links"), F.max("nearest").alias("nearest"))
    return linked(members, groups, counted, "doc_id")


def op7_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_classes(table(spark, sf_dir, "documents"))
