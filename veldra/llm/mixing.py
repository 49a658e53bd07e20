"""Mixing sources to target weights by entropy balancing.

Every document gets a rate r, the expected number of its copies. With q the documents'
shares of all tokens, the token shares p = q * r are chosen as near to q as possible in
Kullback-Leibler divergence, subject to

* the token share of every source and of every language equals its target, and
* the token-weighted mean of log(1 + tokens) stays what it is, so that no source is made
  up from its shortest or its longest documents.

The solution is an exponential tilt, r = exp(a[source] + b[language] + c * z), whose
parameters minimise a convex dual. The best a[source] for given b and c is known in closed
form, which leaves a dual in the languages and c alone. Newton's method needs its gradient
and Hessian; Spark sums both from cells of equal (source, language, tokens), source by
source, so that the driver sees the languages' matrix and never a list of the sources.
Rates are rounded to copies at random, with the document's hash as the die, so that the
expected number of copies is the rate.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .arrays import as_array, row_sums, token_counts
from .scratch import Scratch, add_column, fresh, map_arrow, table

#: Default targets: token shares raised to these powers, then normalised. Below 1, small groups gain.
SOURCE_POWER = 0.7
LANG_POWER = 0.8
TOLERANCE = 1e-9
#: Largest miss of a target share that counts as met.
MISS = 1e-6
STEPS = 60
#: Tilts beyond this mean that no finite one meets the targets.
STEEPEST = 30.0
#: The driver solves a linear system in as many unknowns as there are languages.
MAX_LANGS = 1000
#: The sources' tilts are broadcast if there are at most so many, with names of at most so many characters in all.
BROADCAST_SOURCES, BROADCAST_NAMES = 50_000, 4 << 20
NONE = "\x00none"


@dataclass
class Tilt:
    #: (s, a): a row for each source whose target isn't 0.
    sources: DataFrame
    broadcast: bool
    langs: dict[str, float]
    slope: float
    mean: float
    scale: float
    #: Largest difference of a language's share from its target.
    error: float
    #: How much of the way from what the source targets alone lead to the language targets were moved: 1 if all is met.
    reached: float


def _named(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


def _targets(share: dict[str, float], wanted: dict[str, float] | None, power: float) -> dict[str, float]:
    raw = {k: (max(0.0, wanted.get(k, 0.0)) if wanted is not None else v**power) for k, v in share.items()}
    total = sum(raw.values())
    if total <= 0:
        raise ValueError("no group of the input has a positive target")
    return {k: v / total for k, v in raw.items() if v > 0}


def _source_targets(cells: DataFrame, wanted: dict[str, float] | None, power: float, total: float) -> DataFrame:
    """(s, w): the target share of every source that shall have any."""
    if wanted is None:
        raw = cells.groupBy("s").agg(F.pow(F.sum(F.col("n") * F.col("t")) / total, power).alias("raw"))
    else:
        named = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in wanted.items() if v > 0], "s string, raw double")
        raw = named.join(cells.select("s").distinct(), "s", "left_semi")
    whole = raw.agg(F.sum("raw")).first()[0]
    if not whole:
        raise ValueError("no group of the input has a positive target")
    return raw.select("s", (F.col("raw") / whole).alias("w"))


def _terms(size: int, b: np.ndarray):
    """Rows (i, j, v) that add up to the dual's value (-1, -1), gradient (i, -1) and Hessian (i, j), from rows (w, cells) of a source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, gradient, hessian = 0.0, np.zeros(size), np.zeros((size, size))
        n_langs, c = len(b), size - 1
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                w, lists = batch.column(0).to_numpy(), as_array(batch.column(1))
                flat = lists.flatten()
                li = flat.field(0).to_numpy()
                first = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
                with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
                    m0, m1, m2 = (np.exp(b[li]) * flat.field(k).to_numpy() for k in (1, 2, 3))
                    s0, s1, s2 = (row_sums(m, first) for m in (m0, m1, m2))
                    row = np.repeat(np.arange(len(w)), np.diff(first))
                    share = np.zeros((len(w), n_langs))
                    share[row, li] = m0 / s0[row]
                    slope = s1 / s0
                    value += float(w @ np.log(s0))
                    gradient[:n_langs] += w @ share
                    gradient[c] += w @ slope
                    hessian[:n_langs, :n_langs] -= share.T @ (w[:, None] * share)
                    mixed = np.bincount(li, w[row] * m1 / s0[row], n_langs) - share.T @ (w * slope)
                    hessian[:n_langs, c] += mixed
                    hessian[c, :n_langs] += mixed
                    hessian[c, c] += w @ (s2 / s0 - slope * slope)
        hessian[np.arange(n_langs), np.arange(n_langs)] += gradient[:n_langs]
        i, j = np.nonzero(hessian)
        k = np.flatnonzero(gradient)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(([-1], k, i)), pa.int32()), pa.array(np.concatenate(([-1], np.full(len(k), -1), j)), pa.int32()), pa.array(np.concatenate(([value], gradient[k], hessian[i, j])), pa.float64())], ["i", "j", "v"]
        )

    return run


class _Dual:
    """The dual in (b of all languages but the last, c) for cells (s, w, l, t, n)."""

    def __init__(self, cells: DataFrame, langs: list[str], mean: float, scale: float, total: float):
        self.cells, self.n_langs, self.mean, self.scale, self.total = cells, len(langs), mean, scale, total
        self.size = self.n_langs + 1

    def moments(self, slope: float) -> DataFrame:
        """(s, w, l, m0, m1, m2) without the languages' tilts."""
        z = (F.log1p("t") - self.mean) / self.scale if self.scale > 0 else F.lit(0.0)
        mass = F.col("n") * F.col("t") / self.total * F.exp(slope * z)
        return self.cells.groupBy("s", "w", "l").agg(F.sum(mass).alias("m0"), F.sum(mass * z).alias("m1"), F.sum(mass * z * z).alias("m2"))

    def evaluate(self, theta: np.ndarray, target: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        b, c = np.append(theta[:-1], 0.0), float(theta[-1])
        by_source = self.moments(c).groupBy("s").agg(F.first("w").alias("w"), F.collect_list(F.struct("l", "m0", "m1", "m2")).alias("m")).select("w", "m")
        got = map_arrow(by_source, _terms(self.size, b), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
        i, j, v = got["i"].to_numpy(), got["j"].to_numpy(), got["v"].to_numpy()
        gradient, hessian = np.zeros(self.size), np.zeros((self.size, self.size))
        gradient[i[(j < 0) & (i >= 0)]] = v[(j < 0) & (i >= 0)]
        hessian[i[j >= 0], j[j >= 0]] = v[j >= 0]
        free = [*range(self.n_langs - 1), self.n_langs]
        return float(v[i < 0].sum() - theta @ target), gradient[free] - target, hessian[np.ix_(free, free)]

    def solve(self, target: np.ndarray) -> tuple[np.ndarray, float]:
        """(parameters, largest miss of a target) by damped Newton steps; gives up where the tilts run away."""
        theta = np.zeros(self.size - 1)
        value, gradient, hessian = self.evaluate(theta, target)
        for _ in range(STEPS):
            if np.abs(gradient).max() < TOLERANCE or np.abs(theta).max() > STEEPEST:
                break
            step = np.linalg.solve(hessian + 1e-13 * max(1e-3, np.trace(hessian)) * np.eye(len(theta)), -gradient)
            step *= min(1.0, 5.0 / max(1e-300, np.abs(step).max()))
            length, slope = 1.0, float(step @ gradient)
            while True:
                tried = self.evaluate(theta + length * step, target)
                if np.isfinite(tried[0]) and tried[0] <= value + 1e-4 * length * slope + 1e-15 * max(1.0, abs(value)) or length < 1e-6:
                    break
                length /= 2
            theta = theta + length * step
            value, gradient, hessian = tried
            if length < 1e-6:
                break
        return theta, float(np.abs(gradient).max())


def solve(stats: DataFrame, scratch: Scratch, source_weights: dict[str, float] | None = None, lang_weights: dict[str, float] | None = None, source_power: float = SOURCE_POWER, lang_power: float = LANG_POWER) -> Tilt | None:
    """The tilt for a table (s, l, t) of sources, languages and tokens; None where it holds no token.

    Source targets are always met. Where the language targets and the mean length can't be met with them, they are
    moved towards what the source targets alone lead to, by halves, until they can; a warning says so. Language
    weights that the caller has set are not moved: if they contradict the source targets, ValueError is raised.
    """
    spark = stats.sparkSession
    cells = scratch.save(stats.where("t > 0").groupBy("s", "l", "t").agg(F.count("*").alias("n")), "cells")
    weight, x = F.col("n") * F.col("t"), F.log1p("t")
    by_lang = cells.groupBy("l").agg(F.sum(weight).alias("w"), F.sum(weight * x).alias("x"), F.sum(weight * x * x).alias("xx")).orderBy("l").limit(MAX_LANGS + 1).collect()
    total = float(sum(r.w for r in by_lang))
    if not total:
        scratch.drop("cells")
        return None
    if len(by_lang) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages; fold the small ones first")
    mean = sum(r.x for r in by_lang) / total
    variance = sum(r.xx for r in by_lang) / total - mean * mean
    scale = float(np.sqrt(variance)) if variance > 1e-12 else 0.0
    langs = _targets({r.l: r.w / total for r in by_lang}, lang_weights, lang_power)
    names = list(langs)
    # Groups that shall have nothing are left out of the dual and get rate 0.
    kept = F.broadcast(spark.createDataFrame([(name, k) for k, name in enumerate(names)], "l string, li int"))
    inside = cells.join(kept, "l")
    wanted = _source_targets(inside, source_weights, source_power, total)
    lengths = wanted.agg(F.count("*").alias("n"), F.sum(F.length("s")).alias("c")).first()
    small = lengths.n <= BROADCAST_SOURCES and lengths.c <= BROADCAST_NAMES
    inside = scratch.save(inside.join(F.broadcast(wanted) if small else wanted, "s").select("s", "w", F.col("li").alias("l"), "t", "n"), "weighted")
    dual = _Dual(inside, names, mean, scale, total)
    target = np.array([*list(langs.values())[:-1], 0.0])
    theta, error = dual.solve(target)
    reached = 1.0
    if error > MISS:
        alone = dual.evaluate(np.zeros(len(target)), np.zeros(len(target)))[1]
        free = np.ones(len(target), bool)
        if lang_weights is not None:
            free[:-1] = False
        while error > MISS and reached > 0.01:
            reached /= 2
            theta, error = dual.solve(np.where(free, alone + reached * (target - alone), target))
        if error > MISS:
            if lang_weights is not None:
                raise ValueError(f"the targets of sources and languages contradict one another; a language's share misses its target by {error:.3g}")
            theta, reached = np.zeros(len(target)), 0.0
        warnings.warn(f"targets of languages and of the mean length can't be met with those of the sources; they were moved to {reached:.3g} of their way", stacklevel=2)
        error = float(np.abs(dual.evaluate(theta, target)[1]).max())
    tilts = spark.createDataFrame([(k, float(v)) for k, v in enumerate(np.append(theta[:-1], 0.0))], "l int, b double")
    mass = dual.moments(float(theta[-1])).join(F.broadcast(tilts), "l").groupBy("s").agg(F.log(F.first("w") / F.sum(F.col("m0") * F.exp("b"))).alias("a"))
    sources = scratch.save(mass, "sources")
    scratch.drop("cells", "weighted")
    return Tilt(sources, small, dict(zip(names, map(float, np.append(theta[:-1], 0.0)))), float(theta[-1]), mean, scale, error, reached)


@dataclass
class _Names:
    key: str
    source: str
    lang: str
    tokens: str
    rate: str
    copies: str


def _grouped(docs: DataFrame) -> tuple[DataFrame, _Names]:
    """``docs`` with its groups and token counts (maximal runs of characters other than ASCII white space), under new names."""
    names = _Names(*fresh(docs, "key_", "group_", "lang_", "tokens_", "rate_", "copies_"))
    counted = add_column(docs, "text", names.tokens, T.LongType(), lambda texts: token_counts(as_array(texts)))
    none = F.lit(NONE)
    return counted.withColumns({names.source: F.coalesce(F.col("source").cast("string"), none), names.lang: F.coalesce(F.col("lang").cast("string"), none), names.key: F.col("doc_id")}), names


def _rates(rows: DataFrame, names: _Names, tilt: Tilt | None) -> DataFrame:
    """Adds the rate and the copies."""
    if tilt is None:
        return rows.withColumns({names.rate: F.lit(1.0), names.copies: F.lit(1)})
    spark = rows.sparkSession
    s, a, l, b = fresh(rows, "tilted_source_", "source_tilt_", "tilted_lang_", "lang_tilt_")
    sources = tilt.sources.select(F.col("s").alias(s), F.col("a").alias(a))
    langs = spark.createDataFrame(list(tilt.langs.items()), f"{l} string, {b} double")  # at most MAX_LANGS rows
    joined = rows.join(F.broadcast(sources) if tilt.broadcast else sources, F.col(names.source) == F.col(s), "left").join(F.broadcast(langs), F.col(names.lang) == F.col(l), "left")
    z = (F.log1p(names.tokens) - tilt.mean) / tilt.scale if tilt.scale > 0 else F.lit(0.0)
    rate = F.when(F.col(names.tokens) == 0, F.lit(1.0)).otherwise(F.coalesce(F.exp(F.col(a) + F.col(b) + tilt.slope * z), F.lit(0.0)))
    die = F.pmod(F.xxhash64(names.key, F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    rated = joined.withColumn(names.rate, rate)
    whole = F.floor(names.rate)
    return rated.withColumn(names.copies, (whole + F.when(die < F.col(names.rate) - whole, 1).otherwise(0)).cast("int"))


def _counted(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, _Names]:
    """One row a document: key, source, language and tokens, kept for the two passes that need them."""
    rows, names = _grouped(docs.select("doc_id", "text", "source", "lang"))
    return scratch.save(rows.select(names.key, names.source, names.lang, names.tokens), "stats"), names


def mix_rates(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, source, lang, tokens, rate, copies), a row for each row of ``docs``.

    Options: ``source_weights`` and ``lang_weights`` (target token shares by name; groups that are not named get
    nothing), or the powers that make targets from the present shares.

    Defined results: a null source or language is a group of its own. Documents without tokens (null, empty or
    blank text) take no part and keep rate 1. Repeated rows count each, and get equal copies. An empty table
    gives no rows. Other columns are ignored. doc_id must be a number, as everywhere in this package. Targets that
    contradict one another are treated as ``solve`` says; more than MAX_LANGS languages raise ValueError.
    """
    scratch = Scratch(docs.sparkSession)
    stats, names = _counted(docs, scratch)
    tilt = solve(stats.select(F.col(names.source).alias("s"), F.col(names.lang).alias("l"), F.col(names.tokens).alias("t")), scratch, **options)
    rated = _rates(stats, names, tilt)
    back = lambda c: F.when(F.col(c) != NONE, F.col(c))
    return rated.select(F.col(names.key).cast("bigint").alias("doc_id"), back(names.source).alias("source"), back(names.lang).alias("lang"), F.col(names.tokens).alias("tokens"), F.col(names.rate).alias("rate"), F.col(names.copies).alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as many times as ``mix_rates`` gives it copies, columns unchanged whatever their names."""
    scratch = Scratch(docs.sparkSession)
    stats, names = _counted(docs, scratch)
    tilt = solve(stats.select(F.col(names.source).alias("s"), F.col(names.lang).alias("l"), F.col(names.tokens).alias("t")), scratch, **options)
    scratch.drop("stats")
    rows, names = _grouped(docs)
    rated = _rates(rows, names, tilt)
    (copy,) = fresh(rated, "copy_")
    return rated.where(F.col(names.copies) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(names.copies)))).select(*(_named(c) for c in docs.columns))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_rates(table(spark, sf_dir, "documents"))
