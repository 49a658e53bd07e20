"""Near-duplicate embeddings by lattice hashing.

Vectors of length 1 are projected at random to 8 dimensions, ``blocks`` times over, scaled
and shifted, and each block is decoded to the nearest point of the E8 lattice, the densest
packing in 8 dimensions; the points together name a cell. Near vectors fall into the same or
a neighbouring cell. There are ``tables`` such hashes. In each, a vector is filed under its own
cell, and looks into that cell and the ``probes`` - 1 neighbouring cells nearest to it.

Equal vectors are one class, and only classes are searched, in two rounds: first every class
is compared with the one of least id that shares its own cells of two tables, which joins most
of what belongs together; then all that meet in any cell, unless they are in one group already
or their signs under ``SIGNS`` random projections differ too much. Pairs are verified by cosine
on the full vectors. Last, the vectors of each group are brought together and all of its pairs
are compared, which gives each class its number of links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .arrays import U64, as_array, mix
from .classes import fold, grouped, linked, split
from .components import components
from .lists import in_blocks, streamed
from .scratch import Scratch, map_arrow, table

THRESHOLD = 0.95
SEED = 20
SIGNS = 64
#: Standard deviations by which more signs than expected at the threshold may differ.
SLACK = 4.5
#: Rows of a cell that are met in one task; longer lists are split into blocks of half as many.
LIST = 4000
#: Vectors of a group that are compared at once; larger groups are split.
BLOCK = 2000


@dataclass(frozen=True)
class Plan:
    """``scale`` is the lattice's edge in units of the projections, whose every coordinate has variance 1 for a vector of length 1."""

    blocks: int
    tables: int
    probes: int
    scale: float


#: The more vectors there are, the finer the cells have to be, so that few strangers meet; more tables keep the recall.
PLANS = ((1 << 20, Plan(2, 8, 2, 2.0)), (1 << 27, Plan(3, 12, 3, 2.2)), (1 << 62, Plan(4, 16, 3, 2.6)))


def plan_for(n: int) -> Plan:
    return next(p for most, p in PLANS if n <= most)


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8, which lead from a cell to its neighbours."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((-1, 1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) / 2 for s in product((-1, 1), repeat=8) if np.prod(s) > 0]
    return np.array(out)


ROOTS = _roots()


def nearest(y: np.ndarray) -> np.ndarray:
    """Nearest E8 points of the rows of ``y`` (n, 8): the better of D8 and D8 shifted by one half."""

    def d8(x: np.ndarray) -> np.ndarray:
        near = np.round(x)
        odd = np.flatnonzero(near.sum(1).astype(np.int64) & 1)
        off = x[odd] - near[odd]
        worst = np.abs(off).argmax(1)
        near[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
        return near

    whole, half = d8(y), d8(y - 0.5) + 0.5
    return np.where((((y - whole) ** 2).sum(1) <= ((y - half) ** 2).sum(1))[:, None], whole, half)


def cells(vectors: np.ndarray, plan: Plan = PLANS[0][1], seed: int = SEED) -> np.ndarray:
    """Cell numbers (n, tables, probes) as int64; the first probe is the vector's own cell."""
    rng = np.random.default_rng(seed)
    n, dim = vectors.shape
    out = np.empty((n, plan.tables, plan.probes), np.int64)
    every = np.arange(n)

    def numbered(points: np.ndarray, salt: np.ndarray) -> np.ndarray:
        code = salt
        for k in range(8):
            code = mix(code ^ (2 * points[:, k]).astype(np.int64).view(U64))
        return code

    for t in range(plan.tables):
        home = np.empty((n, plan.blocks, 8))
        gain = np.empty((n, plan.blocks * len(ROOTS)))
        codes = np.empty((n, plan.blocks), U64)
        for b in range(plan.blocks):
            y = vectors @ rng.standard_normal((dim, 8)) / plan.scale + rng.random(8)
            home[:, b] = nearest(y)
            gain[:, b * len(ROOTS) : (b + 1) * len(ROOTS)] = (y - home[:, b]) @ ROOTS.T
            codes[:, b] = numbered(home[:, b], np.full(n, t * 64 + b + 1, U64))
        own = codes.sum(1)
        out[:, t, 0] = mix(own).view(np.int64)
        for k in range(1, plan.probes):
            move = gain.argmax(1)
            gain[every, move] = -np.inf
            b = move // len(ROOTS)
            moved = numbered(home[every, b] + ROOTS[move % len(ROOTS)], (t * 64 + b + 1).astype(U64))
            out[:, t, k] = mix(own - codes[every, b] + moved).view(np.int64)
    return out


def signs(vectors: np.ndarray, seed: int = SEED) -> np.ndarray:
    """SIGNS sign bits of random projections, as int64."""
    planes = np.random.default_rng(seed + 1).standard_normal((vectors.shape[1], SIGNS))
    return np.packbits(vectors @ planes > 0, axis=1).view(np.int64)[:, 0]


def most_signs(threshold: float) -> int:
    """How many signs may differ between vectors of a cosine of at least ``threshold``; all but a few in a million stay below."""
    p = math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    return min(SIGNS, math.ceil(SIGNS * p + SLACK * math.sqrt(SIGNS * p * (1 - p))))


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, vectors of length 1) for each length of vector; all are finite and none is zero."""
    column = as_array(column)
    sizes = column.value_lengths().to_numpy()
    for dim in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == dim)
        x = column.take(pa.array(at)).flatten().to_numpy().astype(np.float64).reshape(len(at), dim)
        x /= np.abs(x).max(1)[:, None]
        yield at, x / np.linalg.norm(x, axis=1)[:, None]


def _star(plan: Plan, seed: int):
    """(key, id): own cells, two tables at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Plan(plan.blocks, plan.tables, 1, plan.scale)
        for batch in batches:
            for at, x in _matrices(batch.column(1)):
                c = cells(x, own, seed)[:, :, 0].view(U64)
                key = mix(mix(c[:, ::2]) + c[:, 1::2] + U64(x.shape[1])).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), batch.column(0).take(pa.array(np.repeat(at, key.shape[1])))], ["key", "id"])

    return run


def _file(plan: Plan, seed: int):
    """(cell, id, label, signs, own): a row for each cell that a vector looks into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                rows = batch.slice(a, 2048)
                for at, x in _matrices(rows.column(2)):
                    c = mix(cells(x, plan, seed).view(U64) + U64(x.shape[1])).view(np.int64).reshape(len(x), -1)
                    take = pa.array(np.repeat(at, c.shape[1]))
                    own = np.tile(np.arange(c.shape[1]) % plan.probes == 0, len(x))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c.ravel()), rows.column(0).take(take), rows.column(1).take(take), pa.array(np.repeat(signs(x, seed), c.shape[1])), pa.array(own.astype(np.int8))], ["cell", "id", "label", "signs", "own"]
                    )

    return run


_MET = "a bigint, b bigint, label bigint, signs bigint, own tinyint, long boolean"


def _meet(most: int, limit: int | None):
    """Pairs (a, b) that meet in the cells and may be near (long is false); rows of lists of more than ``limit`` as they are."""
    names = [x.split()[0] for x in _MET.split(", ")]

    def met(ids, label, bits, own, block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if (label == label[0]).all():
            return
        at = np.flatnonzero(own)
        step = max(1, (1 << 18) // len(ids))
        for first in range(0, len(at), step):
            rows = at[first : first + step]
            ok = (np.bitwise_count((bits[rows][:, None] ^ bits).view(U64)) <= most) & (label[rows][:, None] != label)
            if block is not None:
                ok &= block[rows][:, None] != block
            a, b = np.nonzero(ok)
            yield ids[rows[a]], ids[b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, bound in streamed(batches, 1 if limit is not None else 3, limit):
            if bound is None:
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.ones(len(columns[0]), bool))], names)
                continue
            rest = [c.to_numpy() for c in columns[1:]]
            (x, y, block), (ids, label, bits, own) = (rest[:3], rest[3:]) if limit is None else ((None, None, None), rest)
            found = [(np.zeros(0, np.int64),) * 2]
            size = np.diff(bound)
            for first, last in zip(bound[:-1][size > 1].tolist(), bound[1:][size > 1].tolist()):
                part = slice(first, last)
                found += met(ids[part], label[part], bits[part], own[part], block[part] if block is not None and x[first] != y[first] else None)
            a, b = (np.concatenate(z) for z in zip(*found))
            pair = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
            zero = pa.array(np.zeros(len(pair), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1]), zero, zero, pa.array(np.zeros(len(pair), np.int8)), pa.array(np.zeros(len(pair), bool))], names)

    return run


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 4096):
                batch = whole.slice(first, 4096)
                right = dict(zip((n for n in np.unique(as_array(batch.column(3)).value_lengths().to_numpy()).tolist()), _matrices(batch.column(3))))
                for at, x in _matrices(batch.column(2)):
                    if x.shape[1] not in right:
                        continue
                    other, y = right[x.shape[1]]
                    both, i, j = np.intersect1d(at, other, assume_unique=True, return_indices=True)
                    take = pa.array(both[(x[i] * y[j]).sum(1) >= threshold])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take)], ["a", "b"])

    return run


def _within(threshold: float, links: bool):
    """The near pairs of each group (a, b, cosine), or with ``links`` each class's number of them and its nearest (id, links, nearest).

    Rows (root, x, y, block, id, v) come as ``in_blocks`` gives them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, bound in streamed(batches, 3, None):
            x, y, block, ids = (c.to_numpy() for c in columns[1:5])
            for first, last in zip(bound[:-1].tolist(), bound[1:].tolist()):
                own, cross = slice(first, last), x[first] != y[first]
                for at, v in _matrices(columns[5].slice(first, last - first)):
                    cosine = v @ v.T
                    ok = cosine >= threshold
                    np.fill_diagonal(ok, False)
                    if cross:
                        ok &= block[own][at][:, None] != block[own][at]
                    cosine = np.minimum(cosine, 1.0)
                    if links:
                        count = ok.sum(1)
                        some = np.flatnonzero(count)
                        nearest_ = np.where(ok, cosine, -1.0).max(1)[some] if len(some) else np.zeros(0)
                        yield pa.RecordBatch.from_arrays([pa.array(ids[own][at][some]), pa.array(count[some]), pa.array(np.round(nearest_, 6))], ["id", "links", "nearest"])
                    else:
                        a, b = np.nonzero(np.triu(ok, 1))
                        near, far = ids[own][at][a], ids[own][at][b]
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(near, far)), pa.array(np.maximum(near, far)), pa.array(np.round(cosine[a, b], 6))], ["a", "b", "cosine"])

    return run


def _searched(vectors: DataFrame, threshold: float, plan: Plan | None, seed: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, classes, groups); ``fold`` and ``grouped`` tell what they are."""
    kind = vectors.schema["embedding"].dataType
    float_ = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    kind = "array<float>" if float_ else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("id"), F.col("embedding").cast(kind).alias("v")).where("id is not null and size(v) > 0")
    fine = F.forall("v", lambda e: e.isNotNull() & (F.abs(e) < float("inf"))) & F.exists("v", lambda e: e != 0)
    signed = scratch.save(rows.where(fine).select("id", F.xxhash64(F.size("v"), "v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"), "v"), "signed")
    members, classes = fold(signed, "v", scratch)
    classes = scratch.save(classes, "classes")
    scratch.drop("signed")
    plan = plan or plan_for(classes.count())

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """Those that are near; only vectors that a pair names are shuffled."""
        pairs = scratch.save(pairs, f"{name}-pairs")
        _, some = split(classes, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
        left, right = some.select(F.col("id").alias("a"), F.col("v").alias("va")), some.select(F.col("id").alias("b"), F.col("v").alias("vb"))
        found = scratch.save(map_arrow(pairs.join(left, "a").join(right, "b").select("a", "b", "va", "vb"), _verify(threshold), "a bigint, b bigint"), name)
        scratch.drop(f"{name}-pairs")
        return found

    keys = map_arrow(classes, _star(plan, seed), "key bigint, id bigint")
    least = keys.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("k")).where("k > 1").select(F.col("key").alias("shared"), "least")
    stars = keys.join(least, F.col("key") == F.col("shared")).where("id > least").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct()
    first = verified(stars, "first")
    labels = scratch.save(components(first, scratch, "labels").select(F.col("id").alias("member"), F.col("root").alias("label")), "label-table")
    alone, joined = split(classes, labels.select("member"))
    labelled = joined.join(labels, F.col("id") == F.col("member"), "left").select("id", F.coalesce("label", "id").alias("label"), "v")
    if alone is not None:
        labelled = labelled.union(alone.select("id", F.col("id").alias("label"), "v"))
    filed = map_arrow(labelled, _file(plan, seed), "cell bigint, id bigint, label bigint, signs bigint, own tinyint")
    most = most_signs(threshold)
    met = scratch.save(map_arrow(filed.repartition("cell").sortWithinPartitions("cell"), _meet(most, LIST), _MET), "met")
    pairs, long = met.where("not long").select("a", "b"), met.where("long")
    if not long.isEmpty():
        again = in_blocks(long.select(F.col("a").alias("cell"), F.col("b").alias("id"), "label", "signs", "own"), "cell", "id", LIST // 2)
        pairs = pairs.union(map_arrow(again, _meet(most, None), _MET).select("a", "b"))
    groups = grouped(first.union(verified(pairs.distinct(), "second")), members, scratch)
    scratch.drop("met", "first", "second", "label-table")
    return members, classes, groups


def _compared(groups: DataFrame, classes: DataFrame, threshold: float, links: bool) -> DataFrame:
    _, some = split(classes, groups.select("class"))
    rows = some.join(groups, F.col("id") == F.col("class")).select("root", "id", "v")
    return map_arrow(in_blocks(rows, "root", "id", BLOCK), _within(threshold, links), "id bigint, links bigint, nearest double" if links else "a bigint, b bigint, cosine double")


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, plan: Plan | None = None, seed: int = SEED) -> DataFrame:
    """(class_a, class_b, cosine), class_a < class_b: the pairs of different vectors with a cosine of at least ``threshold``; ``near_classes`` has their members."""
    scratch = Scratch(vectors.sparkSession)
    _, classes, groups = _searched(vectors, threshold, plan, seed, scratch)
    return _compared(groups, classes, threshold, False).select(F.col("a").alias("class_a"), F.col("b").alias("class_b"), "cosine")


def near_classes(vectors: DataFrame, threshold: float = THRESHOLD, plan: Plan | None = None, seed: int = SEED) -> DataFrame:
    """(vec_id, class_id, copies, links, nearest, duplicate_of) for each vector with an equal or a near one.

    Equal vectors are one class, named by its least vec_id (by a negative number where that vec_id has several vectors);
    ``copies`` is its number of vec_ids, ``links`` the number of other classes of a cosine of at least ``threshold``,
    ``nearest`` the largest cosine among them (null without any), ``duplicate_of`` the least vec_id of the group, a
    connected component of links. The search for groups is approximate: a pair at the threshold is found with a
    probability above 0.95, nearer ones almost surely; within a group all links are counted.

    Defined results: rows whose vec_id or embedding is null, or whose embedding is empty, all zero, or
    has a null, NaN or infinite number, are left out. Only vectors of one length are compared. Rows that share a vec_id
    and a vector are one; a vec_id of several vectors has a row for each class, and they are one group. An empty table
    gives no rows. Other columns are ignored. vec_id must be a number.
    """
    scratch = Scratch(vectors.sparkSession)
    members, classes, groups = _searched(vectors, threshold, plan, seed, scratch)
    counted = _compared(groups, classes, threshold, True).groupBy("id").agg(F.sum("links").alias("links"), F.max("nearest").alias("nearest"))
    return linked(members, groups, counted, "vec_id")


def op8_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "embeddings"))
