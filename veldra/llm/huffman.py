"""Token ids of documents in canonical, length-limited Huffman code.

Texts are tokenised once with a byte-level BPE vocabulary; ids are counted over the whole
corpus; code lengths of at most ``MAX_LENGTH`` bits come from the package-merge method and
are assigned canonically, so the codebook is one byte an id. Each document is a row with
its bits and the bit offset of every ``INTERVAL``-th id: intervals can be decoded on their
own, all at once, by one look-up in a table of 2^MAX_LENGTH entries a token.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .arrays import U64, as_array, buffers, row_sums, slices
from .scratch import Scratch, map_arrow, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-tokenisation of the byte-level BPE vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MAX_LENGTH = 18
INTERVAL = 1024
_ENCODE_BYTES = 8 << 20


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class Encoder:
    """Exact BPE over whole batches: each distinct space-led stretch of text is tokenised once a batch.

    The pattern always begins a token at a single space before a visible ASCII (or other plain) character, and
    nothing before that space changes what follows. So texts may be cut there, and the distinct pieces that begin
    so may be tokenised as one string, from which each piece's tokens are told by their bytes.
    """

    def __init__(self, vocabulary: bytes, pattern: str = PATTERN):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        self.size = max(ranks.values()) + 1
        self.width = np.zeros(self.size, np.int64)
        for token, rank in ranks.items():
            self.width[rank] = len(token)
        self._encode = tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _distinct(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of distinct pieces of text."""
        data, bound = buffers(pieces)
        led = data[bound[:-1]] == 32
        spaced = pieces.filter(pa.array(led))
        data, bound = buffers(spaced)
        ids = np.array(self._encode(data.tobytes().decode("utf-8")), np.int64)
        count = np.zeros(len(pieces), np.int64)
        count[led] = np.bincount(np.searchsorted(bound, np.cumsum(self.width[ids]) - self.width[ids], "right") - 1, minlength=len(spaced))
        rest = {int(k): self._encode(x) for k, x in zip(np.flatnonzero(~led), pieces.filter(pa.array(~led)).to_pylist())}
        if not rest:
            return ids, np.concatenate(([0], np.cumsum(count)))
        for k, own in rest.items():
            count[k] = len(own)
        bounds = np.concatenate(([0], np.cumsum(count)))
        flat = np.zeros(int(bounds[-1]), np.int64)
        flat[np.repeat(led, count)] = ids
        flat[np.repeat(~led, count)] = np.fromiter((x for own in rest.values() for x in own), np.int64)
        return flat, bounds

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, bounds): ``ids[bounds[i]:bounds[i + 1]]`` are those of text i."""
        data, offsets = buffers(texts)
        n = len(data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        plain = (data > 32) & (data < 127) | (data >= 0xC3) & (data < 0xE1) | (data > 0xE3)
        cut = np.zeros(n + 1, bool)
        cut[: n - 1] = (data[:-1] == 32) & plain[1:]
        cut[offsets] = True
        cut[n] = False
        start = np.flatnonzero(cut)
        bound = np.append(start, n).astype(np.int64)
        pieces = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(bound), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        flat, begin = self._distinct(pieces.dictionary)
        index = pieces.indices.to_numpy()
        each = np.diff(begin)[index]
        at = np.cumsum(each) - each
        ids = flat[np.repeat(begin[:-1][index] - at, each) + np.arange(int(each.sum()))]
        return ids, np.append(at, len(ids))[np.searchsorted(start, offsets)]


def code_lengths(counts: np.ndarray, limit: int = MAX_LENGTH) -> np.ndarray:
    """Lengths (uint8) of an optimal prefix code of at most ``limit`` bits, by package-merge; 0 where the count is 0."""
    used = np.flatnonzero(counts > 0)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids don't fit into codes of {limit} bits")
    order = used[np.lexsort((used, counts[used]))]
    leaves = counts[order].astype(np.int64)
    merged, kinds = leaves, [np.ones(len(leaves), bool)]
    for _ in range(limit - 1):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate((leaves, pairs))
        rank = np.argsort(both, kind="stable")
        merged = both[rank]
        kinds.append(rank < len(leaves))
    take = 2 * len(leaves) - 2
    for kind in reversed(kinds):
        own = int(kind[:take].sum())
        lengths[order[:own]] += 1
        take = 2 * (take - own)
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes (uint64, right-aligned) in order of (length, id); ids of length 0 have none."""
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    codes = np.zeros(len(lengths), np.uint64)
    code = last = 0
    starts = np.flatnonzero(np.diff(lengths[order], prepend=0)) if len(order) else []
    for k, first in enumerate(starts):
        end = starts[k + 1] if k + 1 < len(starts) else len(order)
        length = int(lengths[order[first]])
        code <<= length - last
        codes[order[first:end]] = code + np.arange(end - first, dtype=np.uint64)
        code, last = code + int(end - first), length
    return codes


def encode_bits(ids: np.ndarray, bounds: np.ndarray, lengths: np.ndarray, codes: np.ndarray, interval: int = INTERVAL) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, byte bounds, checkpoints, checkpoint bounds) of the documents between ``bounds``; each starts a new byte.

    Bits are written most significant first. A checkpoint is a bit offset from the document's first byte.
    """
    size = lengths[ids].astype(np.int64)
    width = (row_sums(size, bounds) + 7) // 8
    byte = np.concatenate(([0], np.cumsum(width)))
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    ends = np.cumsum(size)
    before = np.concatenate(([0], ends))[bounds[:-1]]
    offset = ends - size - before[doc]
    place = offset + 8 * byte[:-1][doc]
    word, shift = place >> 6, 64 - (place & 63) - size
    out = np.zeros((int(byte[-1]) + 7) // 8 + 1, U64)
    if len(ids):
        value = codes[ids]
        high = np.where(shift >= 0, value << np.maximum(shift, 0).astype(U64), value >> np.maximum(-shift, 0).astype(U64))
        first = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[first]] = np.bitwise_or.reduceat(high, first)
        over = np.flatnonzero(shift < 0)  # at most one code crosses into each word
        out[word[over] + 1] |= value[over] << (64 + shift[over]).astype(U64)
    rank = np.arange(len(ids)) - bounds[:-1][doc]
    marked = np.flatnonzero(rank % interval == 0)
    points = np.concatenate(([0], np.cumsum(-(-np.diff(bounds) // interval))))
    return out.byteswap().view(np.uint8)[: int(byte[-1])], byte, offset[marked], points


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(id, length) by the next ``limit`` bits, and that limit."""
    limit = int(lengths.max(initial=1))
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    span = (1 << (limit - lengths[order].astype(np.int64))).astype(np.int64)
    pad = (1 << limit) - int(span.sum())
    return np.append(np.repeat(order, span), np.zeros(pad, np.int64)), np.append(np.repeat(lengths[order], span), np.zeros(pad, np.uint8)), limit


def decode(payload: bytes, n_ids: int, checkpoints: np.ndarray, decoder: tuple[np.ndarray, np.ndarray, int], interval: int = INTERVAL) -> np.ndarray:
    """Ids of one document; all intervals advance together, a look-up a step."""
    symbols, sizes, limit = decoder
    data = np.frombuffer(payload + bytes(8), np.uint8).astype(np.int64)
    out = np.zeros(n_ids, np.int64)
    at = np.asarray(checkpoints, np.int64).copy()
    first = np.arange(len(at)) * interval
    left = np.minimum(n_ids - first, interval)
    for k in range(int(left.max(initial=0))):
        on = np.flatnonzero(left > k)
        byte = at[on] >> 3
        window = data[byte] << 24 | data[byte + 1] << 16 | data[byte + 2] << 8 | data[byte + 3]
        key = window >> (32 - limit - (at[on] & 7)) & ((1 << limit) - 1)
        out[first[on] + k] = symbols[key]
        at[on] += sizes[key]
    return out


def _gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Batches joined until they have ``size`` bytes: the more text at once, the more pieces repeat."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.nbytes for x in held) >= size:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def _tokenise(vocabulary, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary.value, pattern)
        width = 2 if encoder.size <= 1 << 16 else 4
        for rows in _gathered(batches, _ENCODE_BYTES):
            docs, texts = as_array(rows.column(0)), as_array(rows.column(1))
            for a, b in slices(texts, _ENCODE_BYTES):
                ids, bounds = encoder.encode(texts.slice(a, b - a))
                yield pa.RecordBatch.from_arrays([docs.slice(a, b - a), _binary(ids.astype(f"<u{width}").view(np.uint8), bounds * width)], ["doc_id", "ids"])

    return run


def _binary(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _split(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    data, bounds = buffers(column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column)
    return np.ascontiguousarray(data).view(f"<u{width}"), bounds // width


def _tally(size: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            counts += np.bincount(_split(as_array(batch.column(0)), width)[0], minlength=size)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used])], ["id", "n"])

    return run


def _code(book, width: int, interval: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = np.frombuffer(book.value, np.uint8)
        codes = canonical(lengths)
        for batch in batches:
            column = as_array(batch.column(1))
            for a, b in slices(column, 1 << 19):
                ids, bounds = _split(column.slice(a, b - a), width)
                data, byte, points, each = encode_bits(ids, bounds, lengths, codes, interval)
                marks = pa.ListArray.from_arrays(pa.array(each.astype(np.int32)), pa.array(points.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(bounds)), marks, _binary(data, byte)], ["doc_id", "n_ids", "checkpoints", "payload"])

    return run


def encode_corpus(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN, max_length: int = MAX_LENGTH, interval: int = INTERVAL) -> DataFrame:
    """(kind, doc_id, n_ids, checkpoints, payload): a row of kind 'document' for each row of ``docs``, and one of kind 'codebook'.

    The codebook's payload has one byte an id of the vocabulary, its code length (0: it doesn't occur); ``n_ids``
    is the size of the vocabulary. ``decode`` restores a document's ids.

    Defined results: null and empty texts have no ids and an empty payload. A corpus of one distinct id uses one bit
    an id. Repeated rows are encoded each, a null doc_id stays null. Whole texts are encoded. Other columns are
    ignored. An empty table gives the codebook only, all zeros. doc_id must be a number. More than 2^max_length
    different ids in use can't be told apart by codes of that length and raise ValueError.
    """
    spark = docs.sparkSession
    words = read_vocabulary(vocabulary)
    size = 1 + max(int(line.split()[1]) for line in words.splitlines() if line)
    width = 2 if size <= 1 << 16 else 4
    scratch = Scratch(spark)
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    ids = scratch.save(map_arrow(rows, _tokenise(spark.sparkContext.broadcast(words), pattern), "doc_id bigint, ids binary"), "ids")
    # At most one row an id of the vocabulary.
    counts = np.zeros(size, np.int64)
    for r in map_arrow(ids.select("ids"), _tally(size, width), "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r.id] = r.n
    book = code_lengths(counts, max_length).tobytes()
    coded = map_arrow(ids, _code(spark.sparkContext.broadcast(book), width, interval), "doc_id bigint, n_ids bigint, checkpoints array<bigint>, payload binary")
    head = spark.createDataFrame([("codebook", None, size, [], bytearray(book))], "kind string, doc_id bigint, n_ids bigint, checkpoints array<bigint>, payload binary")
    return coded.select(F.lit("document").alias("kind"), "*").unionByName(head)


def decode_corpus(coded: DataFrame, interval: int = INTERVAL) -> DataFrame:
    """(doc_id, ids): the token ids of the documents of ``encode_corpus``'s result, which must hold its codebook.

    Defined results: rows without ids give an empty list; repeated rows are decoded each; a null doc_id stays null.
    A table without a codebook, or with several different ones, raises ValueError.
    """
    books = coded.where("kind = 'codebook'").select("payload").distinct().limit(2).collect()
    if len(books) != 1:
        raise ValueError("one codebook is needed")
    book = coded.sparkSession.sparkContext.broadcast(bytes(books[0].payload))  # one byte an id of the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = decoding_table(np.frombuffer(book.value, np.uint8))
        for batch in batches:
            found = [decode(payload, n, points, decoder, interval) for n, points, payload in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)))]
            bounds = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate([*found, np.zeros(0, np.int64)])))], ["doc_id", "ids"])

    return map_arrow(coded.where("kind = 'document'").select("doc_id", "n_ids", "checkpoints", "payload"), run, "doc_id bigint, ids array<bigint>")


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"))
