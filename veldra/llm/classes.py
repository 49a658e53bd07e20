"""Classes of equal items, named by their least id, and the groups that links between classes make."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .arrays import U64, mix
from .components import components
from .scratch import Scratch, filter_rows, map_arrow

#: Most bits of the filter that keeps rows that nothing names out of a join (16 MB); beyond it the join does without.
FILTER = 1 << 27


def _slot(ids: np.ndarray, bits: int) -> np.ndarray:
    return (mix(ids.view(U64)) % U64(bits)).astype(np.int64)


def _bits(bits: int):
    """The filter of a batch's ids, as the words of 64 bits that aren't zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = np.unique(_slot(batch.column(0).to_numpy(), bits))
            word = slot >> 6
            first = np.flatnonzero(np.diff(word, prepend=-1))
            merged = np.bitwise_or.reduceat(U64(1) << (slot & 63).astype(U64), first) if len(slot) else np.zeros(0, U64)
            yield pa.RecordBatch.from_arrays([pa.array(word[first]), pa.array(merged.view(np.int64))], ["word", "bits"])

    return run


def id_filter(ids: DataFrame) -> Callable[[pa.Array], np.ndarray] | None:
    """Tells which numbers may be among ``ids`` (false: surely not), off a filter of 16 to 32 bits an id; None if it would have more than FILTER bits."""
    bits = 1 << max(10, (16 * ids.count()).bit_length())
    if bits > FILTER:
        return None
    merged = np.zeros(bits // 64, U64)
    got = map_arrow(ids, _bits(bits), "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    merged[got["word"].to_numpy()] = got["bits"].to_numpy().view(U64)
    words_ = ids.sparkSession.sparkContext.broadcast(merged.tobytes())

    def may_be(column: pa.Array) -> np.ndarray:
        words = np.frombuffer(words_.value, U64)
        slot = _slot(pc.fill_null(column.cast(pa.int64()), 0).to_numpy(), bits)
        return (words[slot >> 6] >> (slot & 63).astype(U64) & U64(1)) == 1

    return may_be


def split(rows: DataFrame, ids: DataFrame, column: str | None = None) -> tuple[DataFrame | None, DataFrame]:
    """(the rows that surely don't have one of the ids in the column, the first by default, those that may).

    Where the ids are too many for a filter all rows may.
    """
    may_be = id_filter(ids)
    if may_be is None:
        return None, rows
    column = column or rows.columns[0]
    return filter_rows(rows, [column], lambda c: ~may_be(c)), filter_rows(rows, [column], may_be)


def fold(signed: DataFrame, payload: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(members, classes) of a table (id, h1, h2, payload) in which two hashes tell items apart.

    members: (id, class, root, copies, h1, h2), a row for each id and class; ``root`` is the least id of the class,
    ``copies`` its number of ids. classes: (id, payload), a row a class. A class is named by its root, or where that id
    has several items, by a negative hash.
    """
    again = scratch.save(signed.groupBy("id").agg(F.count("*").alias("k"), (F.min("h1") != F.max("h1")).alias("several")).where("k > 1").select(F.col("id").alias("again"), "several"), "again")
    repeated = not again.isEmpty()
    members = signed.select("id", "h1", "h2")
    if repeated:
        members = members.distinct()
    classes = members.groupBy("h1", "h2").agg(F.min("id").alias("root"), F.count("*").alias("copies")).withColumnsRenamed({"h1": "g1", "h2": "g2"})
    name = F.col("root")
    if repeated:
        classes = classes.join(again, F.col("root") == F.col("again"), "left")
        name = F.when(F.coalesce("several", F.lit(False)), -1 - F.shiftrightunsigned("g1", 1)).otherwise(F.col("root"))
    classes = classes.select("g1", "g2", "root", "copies", name.alias("class"))
    members = scratch.save(members.join(classes, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))).select("id", "class", "root", "copies", "h1", "h2"), "members")
    # The row of its root stands for each class; most rows surely do, and need no join.
    doubtful = members.where("id <> class").select("id")
    if repeated:
        doubtful = doubtful.union(again.select("again"))
    lone, other = split(signed, doubtful.distinct())
    first = members.where("id = root").select(F.col("id").alias("root"), F.col("h1").alias("g1"), F.col("h2").alias("g2"), "class")
    items = other.join(first, (F.col("id") == F.col("root")) & (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))).select(F.col("class").alias("id"), payload)
    if repeated:
        items = items.dropDuplicates(["id"])
    return members, items if lone is None else items.union(lone.select("id", payload))


def grouped(edges: DataFrame, members: DataFrame, scratch: Scratch) -> DataFrame:
    """(class, root): the classes of every group of more than one; root is the least class. The items of one id belong together."""
    several = members.groupBy("id").agg(F.min("class").alias("a"), F.max("class").alias("z")).where("a <> z").select(F.col("id").alias("several"), "a")
    edges = edges.union(members.join(several, F.col("id") == F.col("several")).select("a", F.col("class").alias("b")))
    groups = components(edges, scratch, "groups")
    return scratch.save(groups.select(F.col("id").alias("class"), "root").union(groups.select(F.col("root").alias("class"), "root").distinct()), "grouped")


def least_ids(members: DataFrame, groups: DataFrame) -> DataFrame:
    """(member, of): the least id of the group of each class in ``groups``."""
    roots = members.where("id = root").join(groups.withColumnRenamed("root", "group").withColumnRenamed("class", "member"), F.col("class") == F.col("member")).select("member", "group", "root")
    least = roots.groupBy("group").agg(F.min("root").alias("of")).withColumnRenamed("group", "own")
    return roots.join(least, F.col("group") == F.col("own")).select("member", "of")


def linked(members: DataFrame, groups: DataFrame, counted: DataFrame, name: str) -> DataFrame:
    """(name, class_id, copies, links, nearest, duplicate_of) of each member with a copy or a link, from the links (id, links, nearest) of classes."""
    counted = counted.withColumnRenamed("id", "linked")
    known = least_ids(members, groups).join(counted, F.col("member") == F.col("linked"), "left").select("member", "of", "links", "nearest")
    found = members.join(known, F.col("class") == F.col("member"), "left").where("copies > 1 or member is not null")
    return found.select(F.col("id").alias(name), F.col("class").alias("class_id"), "copies", F.coalesce("links", F.lit(0)).cast("bigint").alias("links"), "nearest", F.coalesce("of", "root").alias("duplicate_of"))
