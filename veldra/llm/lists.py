"""Lists of rows that share a key, as a sorted shuffle brings them: whole lists, and long ones split into blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def streamed(batches: Iterator[pa.RecordBatch], keys: int, limit: int | None) -> Iterator[tuple[list[pa.Array], np.ndarray | None]]:
    """(columns, bounds) of whole lists, from rows sorted by the first ``keys`` columns (numbers).

    Lists of more than ``limit`` rows come in parts, with None for bounds; no more than ``limit`` rows and a batch are held.
    """
    now, held, rows, long = None, [], 0, False

    def joined() -> list[pa.Array]:
        return [pa.concat_arrays(x) for x in zip(*held)]

    def finish() -> Iterator[tuple[list[pa.Array], np.ndarray | None]]:
        if held:
            yield joined(), None if long else np.array([0, rows])

    for batch in batches:
        if not batch.num_rows:
            continue
        parts = [batch.column(k).to_numpy() for k in range(keys)]
        new = np.zeros(batch.num_rows + 1, bool)
        new[[0, -1]] = True
        for c in parts:
            new[1:-1] |= c[1:] != c[:-1]
        bound = np.flatnonzero(new)
        if now is not None:
            head = int(bound[1]) if [c[0] for c in parts] == now else 0
            if head:
                held.append(batch.slice(0, head).columns)
                rows += head
                long = limit is not None and rows > limit
                bound = bound[1:]
            if head < batch.num_rows or long:
                yield from finish()
                held = []
            if head == batch.num_rows:
                continue
        size = np.diff(bound)
        # The last list may go on in the next batch.
        at = 0
        for k in [*(np.flatnonzero(size[:-1] > limit).tolist() if limit is not None else []), len(size) - 1]:
            if k > at:
                yield batch.slice(bound[at], bound[k] - bound[at]).columns, bound[at : k + 1] - bound[at]
            if k < len(size) - 1:
                yield batch.slice(bound[k], size[k]).columns, None
            at = k + 1
        now, held, rows = [c[-1] for c in parts], [batch.slice(bound[-2]).columns], int(size[-1])
        long = limit is not None and rows > limit
    yield from finish()


def in_blocks(rows: DataFrame, key: str, by: str, size: int, *order: str) -> DataFrame:
    """Rows of long lists as (key, x, y, block, ...): each two blocks of about ``size`` rows of a list meet in a list of their own.

    The block comes from the hash of the column ``by``. The result is partitioned and sorted by (key, x, y, *order). Both
    blocks of (x, x) are the same. A row comes once a block of its list, so keep this for lists that can't be held whole.
    """
    counted = rows.groupBy(key).agg(F.ceil(F.count("*") / size).cast("bigint").alias("blocks_")).withColumnRenamed(key, "list_")
    split = rows.join(counted, F.col(key) == F.col("list_")).withColumn("block", F.pmod(F.xxhash64(by), F.col("blocks_"))).withColumn("other_", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks_") - 1)))
    rest = [c for c in rows.columns if c != key]
    cells = split.select(key, F.least("block", "other_").alias("x"), F.greatest("block", "other_").alias("y"), "block", *rest)
    return cells.repartition(key, "x", "y").sortWithinPartitions(key, "x", "y", *order)
