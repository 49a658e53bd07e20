"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .scratch import Scratch

#: Up to so many edges (2 MB) the driver finds the components itself, with the same result and without the jobs.
LOCAL = 1 << 17


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u, v), u > v. Large: each node links its larger neighbours to its least one; small: its smaller ones.

    A hub's edges are grouped where they lie first, and a join that finds them in one partition may be split.
    """
    both = edges.select(F.col("u").alias("n"), F.col("v").alias("m"))
    if large:
        both = both.union(edges.select("v", "u"))
    least = both.groupBy("n").agg(F.least("n", F.min("m")).alias("least")).withColumnRenamed("n", "node")
    linked = both.join(least, F.col("n") == F.col("node")).select("n", "m", "least")
    if large:
        out = linked.where("m > n").select(F.col("m").alias("u"), F.col("least").alias("v"))
    else:
        out = linked.select(F.explode(F.array("n", "m")).alias("u"), F.col("least").alias("v"))
    return out.where("u > v").distinct()


def roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, least node of the component of each), by hooking roots to smaller ones and halving paths."""
    nodes, ends = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        differ = x != y
        if not differ.any():
            return nodes, nodes[root]
        np.minimum.at(root, np.maximum(x, y)[differ], np.minimum(x, y)[differ])
        while (up := root[root]).tobytes() != root.tobytes():
            root = up


def components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(id, root) for every id in the edges (a, b) but the roots; root is the least id of the component.

    Null ends and loops are dropped, repeated edges count once; an empty edge table gives an empty result.
    """
    state = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and u > v").distinct()
    state = scratch.save(state, f"{name}-0")
    tally = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    if tally[0] <= LOCAL:
        got = state.toArrow()
        scratch.drop(f"{name}-0")
        nodes, least = roots(got["u"].to_numpy(), got["v"].to_numpy())
        other = nodes != least
        return state.sparkSession.createDataFrame(pa.table({"id": pa.array(nodes[other], pa.int64()), "root": pa.array(least[other], pa.int64())}))
    step = 0
    while True:
        step += 1
        state = scratch.save(_star(_star(state, True), False), f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
        seen, tally = tally, state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == tally:
            return state.select(F.col("u").alias("id"), F.col("v").alias("root"))
