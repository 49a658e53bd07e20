"""Packing documents into training sequences along a space-filling curve.

A document's distinct words are hashed to a sparse vector that a random +-1 matrix
projects to ``DIMS`` dimensions; both steps are one sign a word and dimension. The point
is mapped to a grid of 2^BITS cells a side and numbered along the Hilbert curve. Documents
are range-sorted by that number, so neighbours use similar words, laid end to end, and cut
into sequences of ``CAPACITY`` tokens; a document across a cut goes on in the next sequence.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from .arrays import U64, as_array, distinct, mix, row_sums, slices, token_counts, words
from .scratch import Scratch, map_arrow, table

CAPACITY = 2048
DIMS = 4
BITS = 15


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position along the Hilbert curve of grid cells (n, dims), by Skilling's transpose method."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) > 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, t)
            x[i] ^= t
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where(x[-1] & q, q - 1, 0)
        q >>= 1
    x ^= t
    out = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            out = out << 1 | x[i] >> bit & 1
    return out


def curve_keys(texts: pa.Array, dims: int = DIMS, bits: int = BITS) -> np.ndarray:
    """Hilbert positions of texts; texts without words lie in the middle of the grid."""
    out = []
    for a, b in slices(texts):
        n = b - a
        w = words(texts.slice(a, n))
        _, code, first = distinct(w.doc, w.hash, n)
        code = mix(code)
        count = np.maximum(np.diff(first), 1)
        point = np.stack([row_sums((code >> U64(k) & U64(1)).astype(np.int8) * np.int8(2) - np.int8(1), first) for k in range(dims)], 1) / np.sqrt(count)[:, None]
        # A logistic curve close to the normal distribution's spreads the points evenly over the grid.
        out.append(hilbert(np.minimum((1 << bits) / (1 + np.exp(-1.702 * point)), (1 << bits) - 1).astype(np.int64), bits))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _key(dims: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_array(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(curve_keys(texts, dims, bits)), pa.array(token_counts(texts))], ["doc_id", "key", "tokens"])

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, dims: int = DIMS, bits: int = BITS) -> DataFrame:
    """(sequence, position, doc_id, first_token, n_tokens, key): the pieces of documents in each sequence.

    Sequence k holds the tokens k * capacity to (k + 1) * capacity of all documents laid end to end by (key,
    doc_id, tokens); every sequence but the last is full. ``position`` is the piece's place in its sequence,
    ``first_token`` its first token within the document.

    Defined results: documents without tokens (null, empty or blank text) are in no sequence. Rows with equal key
    follow one another by doc_id, nulls first; repeated rows are packed each. Documents longer than the capacity
    fill several sequences. An empty table gives no rows. Other columns are ignored.
    """
    if capacity < 1 or dims * bits > 62:
        raise ValueError("capacity must be positive, and dims * bits at most 62")
    scratch = Scratch(docs.sparkSession)
    keyed = map_arrow(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")), _key(dims, bits), "doc_id bigint, key bigint, tokens bigint").where("tokens > 0")
    keyed = scratch.save(keyed, "keyed")
    ranged = scratch.save(keyed.repartitionByRange("key", "doc_id", "tokens").withColumn("part", F.spark_partition_id()), "ranged")
    # One number a partition: where its first token lies in the whole.
    sums = sorted((r.part, r.n) for r in ranged.groupBy("part").agg(F.sum("tokens").alias("n")).collect())
    begin = dict(zip((p for p, _ in sums), accumulate((n for _, n in sums), initial=0)))
    scratch.drop("keyed")
    starts = docs.sparkSession.createDataFrame(list(begin.items()), "part int, begin bigint")
    order = Window.partitionBy("part").orderBy("key", F.col("doc_id").asc_nulls_first(), "tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = ranged.join(F.broadcast(starts), "part").withColumn("at", F.sum("tokens").over(order) + F.col("begin") - F.col("tokens"))
    pieces = laid.select("doc_id", "key", "tokens", "at", F.explode(F.expr(f"sequence(at div {capacity}, (at + tokens - 1) div {capacity})")).alias("sequence"))
    begun = F.greatest(F.col("at"), F.col("sequence") * capacity)
    ended = F.least(F.col("at") + F.col("tokens"), (F.col("sequence") + 1) * capacity)
    pieces = pieces.select("sequence", "doc_id", (begun - F.col("at")).alias("first_token"), (ended - begun).alias("n_tokens"), "key", begun.alias("begun"))
    place = F.row_number().over(Window.partitionBy("sequence").orderBy("begun")) - 1
    return pieces.select("sequence", place.alias("position"), "doc_id", "first_token", "n_tokens", "key")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
