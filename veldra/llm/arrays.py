"""Vectorised text primitives shared by the corpus operators.

Everything here works on Arrow string arrays and NumPy buffers: one call handles a
whole batch of documents without a Python loop over words. Texts are never cut;
a batch is only split *between* documents so that scratch memory stays bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
#: Bytes that belong to a word: ASCII letters and digits, and every byte of a multi-byte character.
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_POWERS = np.ones(1, U64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of SplitMix64: spreads every input bit over the 64 output bits."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        steps = np.full(2 * n, _BASE & 0xFFFFFFFFFFFFFFFF, U64)
        steps[0] = 1
        _POWERS = np.multiply.accumulate(steps)
    return _POWERS


def as_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    return column


def slices(texts: pa.Array, target: int = 1 << 19, rows: int = 1 << 16) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``target`` bytes and at most ``rows`` rows each; a longer text is a range of its own."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size)
    first = 0
    while first < len(size):
        before = ends[first - 1] if first else 0
        last = max(int(np.searchsorted(ends, before + target, "right")), first + 1)
        last = min(last, first + rows)
        yield first, last
        first = last


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets) of an Arrow string array, offsets from 0; null counts as empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


@dataclass
class Words:
    """Words of a batch in text order. ``first[i]:first[i+1]`` are the words of document i."""

    hash: np.ndarray
    length: np.ndarray
    start: np.ndarray
    first: np.ndarray
    doc: np.ndarray


def word_mask(data: np.ndarray) -> np.ndarray:
    mask = _WORD[data]
    if len(data) > 2:
        for lead, low, high, width in ((0xC2, 0xA0, 0xBF, 2), (0xE2, 0x80, 0x81, 3), (0xE3, 0x80, 0x80, 3)):
            at = np.flatnonzero(data == lead)
            at = at[at + width <= len(data)]
            at = at[(data[at + 1] >= low) & (data[at + 1] <= high)]
            for k in range(width):
                mask[at + k] = False
    return mask


def words(texts: pa.Array, lower: bool = True) -> Words:
    """Maximal runs of letters and digits of each text, hashed to 64 bits (lower-cased unless told otherwise)."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    data, offsets = buffers(pc.utf8_lower(texts) if lower else texts)
    n = len(data)
    mask = word_mask(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    if n:
        before[0] = False
        before[1:] = mask[:-1]
    start = np.flatnonzero(mask & (~before | edge[:n]))
    after = np.empty(n, bool)
    if n:
        after[-1] = False
        after[:-1] = mask[1:]
    end = np.flatnonzero(mask & (~after | edge[1:])) + 1
    length = end - start
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    if not len(start):
        return Words(np.zeros(0, U64), length, start, first, doc)
    at = np.cumsum(length) - length
    value = data[mask].astype(U64) + U64(1)
    place = np.arange(len(value), dtype=np.int64) - np.repeat(at, length)
    value *= _powers(int(length.max()) + 1)[place]
    return Words(mix(np.add.reduceat(value, at)), length, start, first, doc)


def distinct(doc: np.ndarray, code: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, code) pairs as (doc, code, first) for at most 2^16 documents.

    Codes lose their lowest 16 bits, always as many, so that a text's codes don't depend on its batch.
    """
    key = (doc.astype(U64) << U64(48)) | (code >> U64(16))
    key.sort()
    if len(key):
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    d = (key >> U64(48)).astype(np.int64)
    first = np.searchsorted(d, np.arange(n_docs + 1))
    return d, key << U64(16), first


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between the bounds in ``first``; empty ranges give 0."""
    shape = (len(first) - 1, *values.shape[1:])
    out = np.zeros(shape, np.int64 if values.dtype.kind in "iub" else values.dtype)
    full = np.flatnonzero(first[1:] > first[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, first[:-1][full], axis=0, dtype=out.dtype)
    return out


def token_counts(texts: pa.Array) -> np.ndarray:
    """Maximal runs of characters other than ASCII white space in each text."""
    out = []
    for a, b in slices(texts):
        data, offsets = buffers(texts.slice(a, b - a))
        solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
        start = solid.copy()
        start[1:] &= ~solid[:-1]
        edge = offsets[:-1][np.diff(offsets) > 0]
        start[edge] = solid[edge]
        out.append(np.diff(np.concatenate(([0], np.cumsum(start)))[offsets]))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)
