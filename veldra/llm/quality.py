"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled quality = 1; everything else is unlabelled web
text. A small network scores style features of the whole text. It is trained to minimise
the non-negative unbiased risk

    pi * E_P[l(g)] + max(0, E_U[l(-g)] - pi * E_P[l(-g)])

whose prior ``pi``, the share of good documents among the unlabelled, is estimated first:
a classifier of positive against unlabelled is fitted on one half of the documents; then pi is
the least ratio, over score thresholds, of the share of the unlabelled to that of held-out
positives above the threshold, with a bound for chance (best-bin estimation). The shares are
counted over the whole other half.

Nothing is sampled: each step of a fit follows the gradient over all its documents, whose
features are saved once and summed where they lie. Documents go to halves and to the part held
out for the threshold by a hash of their id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from .arrays import as_array, buffers, distinct, row_sums, slices, words
from .scratch import Scratch, filter_rows, map_arrow, table

#: Steps of a fit, each over all its documents, and the length of the first ones.
STEPS = 120
RATE = 0.02
#: Documents are told apart by a hash of their id in so many folds: odd ones are held out of the prior's classifier, 0 and 1 for the threshold.
FOLDS = 8
#: Thresholds tried for the prior are multiples of this, up to LEVELS of them either side of 0.
LEVEL = 1 / 64
LEVELS = 4096
#: Share of held-out trusted positives that the threshold may cost at most.
LOSS = 0.002
HIDDEN = 24

_CLASS = np.full(256, 5, np.int64)
_CLASS[97:123] = 0
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[32] = 3
_CLASS[10] = 4
_CLASS[128:] = 6
_MARKS = [c for c in range(33, 127) if not chr(c).isalnum()]
for _k, _c in enumerate(_MARKS):
    _CLASS[_c] = 7 + _k
CLASSES = 7 + len(_MARKS)
FEATURES = CLASSES + 9


def features(texts: pa.Array) -> np.ndarray:
    """Style features (n, FEATURES) of whole texts: byte classes, words and repetition."""
    out = []
    for a, b in slices(texts):
        n = b - a
        own = pc.fill_null(texts.slice(a, n), "")
        data, offsets = buffers(own)
        size = np.diff(offsets)
        doc = np.repeat(np.arange(n) * CLASSES, size)
        share = np.bincount(doc + _CLASS[data], minlength=n * CLASSES).reshape(n, CLASSES) / np.maximum(size, 1)[:, None]
        w = words(own)
        count = np.diff(w.first)
        some = np.maximum(count, 1)
        kinds = np.diff(distinct(w.doc, w.hash, n)[2]) if len(w.hash) else np.zeros(n)
        again = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
        again = np.bincount(w.doc[1:][again], minlength=n)
        mean = row_sums(w.length, w.first) / some
        spread = np.sqrt(np.maximum(row_sums(w.length * w.length, w.first) / some - mean * mean, 0))
        lines = np.bincount(doc[data == 10] // CLASSES, minlength=n) + 1
        short = row_sums((w.length <= 3).astype(np.int64), w.first) / some
        long = row_sums((w.length >= 12).astype(np.int64), w.first) / some
        rest = np.stack([np.log1p(count), kinds / some, again / some, mean, spread, np.log1p(count / lines), short, long, kinds / np.sqrt(some)], 1)
        out.append(np.concatenate((np.log1p(100 * share), rest), 1))
    return np.concatenate(out).astype(np.float32) if out else np.zeros((0, FEATURES), np.float32)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float = 1.0
    threshold: float = 0.0

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.standard(x)
        return np.maximum(z @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def loss_sums(m: Model, z: np.ndarray, trusted: np.ndarray) -> np.ndarray:
    """Rows of (number, sum of the losses, sums of its derivatives by w1, b1, w2 and b2) over standardised rows.

    The first is l(g) of the trusted, the second l(-g) of the trusted, the third l(-g) of the others.
    """
    out = []
    for rows, sign in ((trusted, -1), (trusted, 1), (~trusted, 1)):
        own = z[rows]
        h = np.maximum(own @ m.w1 + m.b1, 0)
        g = h @ m.w2 + m.b2
        d = sign * _sigmoid(sign * g)
        back = np.outer(d, m.w2) * (h > 0)
        out.append(np.concatenate(([len(own), np.logaddexp(0, sign * g).sum()], (own.T @ back).ravel(), back.sum(0), h.T @ d, [d.sum()])))
    return np.stack(out)


def risk(sums: np.ndarray, prior: float | None) -> np.ndarray:
    """(what is minimised, its derivatives) from ``loss_sums``.

    With ``prior`` that is the non-negative risk, or where the estimate of the negative risk is below zero its
    negative, which climbs back out of there; without, the logistic loss of positives against unlabelled rows.
    """
    low, high, rest = sums[:, 1:] / sums[:, :1]
    if prior is None:
        return low + rest
    negative = rest - prior * high
    return prior * low + negative if negative[0] >= 0 else -negative


def _parts(m: Model, flat: np.ndarray) -> list[np.ndarray]:
    """Derivatives by w1, b1, w2 and b2 in the shapes of those."""
    n, hidden = m.w1.size, m.b1.size
    return [flat[:n].reshape(m.w1.shape), flat[n : n + hidden], flat[n + hidden : n + 2 * hidden], flat[n + 2 * hidden :]]


def gradients(m: Model, x: np.ndarray, k: int, prior: float | None) -> tuple[float, list[np.ndarray]]:
    """(what is minimised, its derivatives by w1, b1, w2 and b2) on standardised rows, the first k of them positives."""
    found = risk(loss_sums(m, x, np.arange(len(x)) < k), prior)
    return float(found[0]), _parts(m, found[1:])


def descend(mean: np.ndarray, scale: np.ndarray, sums: Callable[[Model], np.ndarray], prior: float | None, seed: int = 7, steps: int | None = None, rate: float = RATE) -> Model:
    """Minimise the non-negative risk (``prior`` given) or plain logistic loss with Adam; ``sums`` are the ``loss_sums`` of a model over all rows."""
    steps = steps or STEPS
    rng = np.random.default_rng(seed)
    m = Model(mean, np.where(scale > 1e-6, scale, 1.0), rng.normal(0, 1 / np.sqrt(len(mean)), (len(mean), HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), 0.0)
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (m.w1, m.b1, m.w2, np.zeros(1))]
    for t in range(1, steps + 1):
        grads = _parts(m, risk(sums(m), prior)[1:])
        grads[0] += 1e-4 * m.w1
        grads[2] += 1e-4 * m.w2
        now = rate * (0.5 * (1 + np.cos(np.pi * t / steps)))
        for (first, second), grad, value in zip(state, grads, (m.w1, m.b1, m.w2, None)):
            first += 0.1 * (grad - first)
            second += 0.001 * (grad * grad - second)
            move = now * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
            if value is None:
                m.b2 -= float(move[0])
            else:
                value -= move
    return m


def fit(p: np.ndarray, u: np.ndarray, prior: float | None, **options) -> Model:
    """``descend`` on rows at hand, p against u."""
    both, trusted = np.concatenate((p, u)).astype(np.float64), np.arange(len(p) + len(u)) < len(p)
    mean, scale = both.mean(0), both.std(0)
    return descend(mean, scale, lambda m: loss_sums(m, m.standard(both), trusted), prior, **options)


def best_bin(positive: np.ndarray, above: np.ndarray, total: int) -> float:
    """Share of positives among ``total`` unlabelled rows, ``above[i]`` of which reach ``positive[i]``, the sorted scores of held-out positives."""
    above_p, above_u = 1 - np.arange(len(positive)) / len(positive), above / total
    chance = np.sqrt(np.log(40) / (2 * len(positive))) + np.sqrt(np.log(40) / (2 * total))
    best = int(np.argmin((above_u + chance) / above_p))
    return float(np.clip(above_u[best] / above_p[best], 0.01, 0.99))


def halves(rows: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the rows to fit on and of those held out; a single row is both."""
    order = np.random.default_rng(seed).permutation(len(rows))
    half = max(1, len(rows) // 2)
    return order[:half], order[half:] if len(rows) > 1 else order


def estimate_prior(p: np.ndarray, u: np.ndarray) -> float:
    """Share of positives among the unlabelled rows, by the best bin of held-out scores."""
    (p_fit, p_held), (u_fit, u_held) = halves(p, 11), halves(u, 13)
    m = fit(p[p_fit], u[u_fit], None)
    sp, su = np.sort(m.score(p[p_held])), np.sort(m.score(u[u_held]))
    return best_bin(sp, len(su) - np.searchsorted(su, sp), len(su))


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = features(as_array(batch.column(2)))
        rows = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1) * 4 * FEATURES).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), rows], ["id", "fold", "x"])


def _unpack(column: pa.Array) -> np.ndarray:
    return buffers(column)[0].view(np.float32).reshape(-1, FEATURES).astype(np.float64)


def total(rows: DataFrame, values: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum, as a flat array, of what ``values`` makes of (trusted, features) in each batch of ``rows``; added up in the order of the partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [0.0]
        for batch in batches:
            if batch.num_rows:
                own[0] = own[0] + values(batch.column(0).to_numpy(zero_copy_only=False), _unpack(as_array(batch.column(1))))
        if isinstance(own[0], np.ndarray):
            yield pa.RecordBatch.from_arrays([pa.array([own[0].tobytes()], pa.binary())], ["part"])

    return sum(np.frombuffer(r.part) for r in map_arrow(rows.select("trusted", "x"), run, "part binary").collect())


def _fit_all(rows: DataFrame, n: int, prior: float | None) -> Model:
    """``fit`` on all of the n ``rows``, wherever they lie."""
    mean = total(rows, lambda _, x: x.sum(0)) / n
    scale = np.sqrt(total(rows, lambda _, x: ((x - mean) ** 2).sum(0)) / n)
    return descend(mean, scale, lambda m: total(rows, lambda y, x: loss_sums(m, m.standard(x), y)).reshape(3, -1), prior)


def _scores(rows: DataFrame, model: Model, values: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``values`` of the scores of ``rows``, as a column ``score``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(values(model.score(_unpack(as_array(batch.column(0))))), pa.float64())], ["score"])

    return map_arrow(rows.select("x"), run, "score double")


def _counted_prior(docs: DataFrame, trusted: DataFrame, model: Model, held: np.ndarray, fitted: np.ndarray) -> float:
    """``best_bin`` over all documents with a text that are neither trusted nor in ``fitted``. Only a number a document is shuffled."""
    level, upto = np.unique(held, return_counts=True)
    upto = np.concatenate(([0], upto.cumsum()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reached = upto[np.searchsorted(level, model.score(features(as_array(batch.column(1)))), "right")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(reached, pa.int64())], ["id", "reached"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text")).where("text is not null")
    reached = map_arrow(rows, run, "id bigint, reached bigint")
    taken = trusted.select(F.col("tid").cast("bigint").alias("tid")).union(docs.sparkSession.createDataFrame(pa.table({"tid": pa.array(fitted, pa.int64())})))
    counts = np.zeros(len(held) + 1, np.int64)
    for r in reached.join(taken, F.col("id") == F.col("tid"), "left_anti").groupBy("reached").agg(F.count("*").alias("n")).collect():
        counts[r.reached] = r.n  # at most one row a level of the held-out positives
    above = counts[::-1].cumsum()[::-1]
    return best_bin(held, above[1:], int(above[0])) if above[0] else 0.5


def _fold() -> F.Column:
    """Which of FOLDS a row with columns doc_id and text is in."""
    key = F.col("doc_id").cast("bigint")
    return F.pmod(F.when(key.isNull(), F.xxhash64(F.col("text").cast("string"))).otherwise(F.xxhash64(key)), F.lit(FOLDS)).cast("int")


def _two(folds: set[int], first: Callable[[int], bool]) -> tuple[set[int], set[int]]:
    """The folds that are ``first``, and the others; if either are none, all of them twice."""
    one = {f for f in folds if first(f)}
    return (one, folds - one) if one and folds - one else (folds, folds)


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fit on all documents with a text: those trusted, but the ones held out for the threshold, and all others.

    A document is trusted if any of its labels is 1. None if no document is trusted, or all are.
    """
    scratch = Scratch(docs.sparkSession)
    trusted = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("bigint").alias("tid")).distinct()
    texts = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint").alias("id"), _fold().alias("fold"), F.col("text").cast("string").alias("text"))
    made = map_arrow(texts, _featurise, "id bigint, fold int, x binary")
    rows = scratch.save(made.join(trusted, F.col("id") == F.col("tid"), "left").select(F.col("tid").isNotNull().alias("trusted"), "fold", "x"), "rows")
    count = {(r.trusted, r.fold): r.n for r in rows.groupBy("trusted", "fold").agg(F.count("*").alias("n")).collect()}
    positive, rest = ({fold for y, fold in count if y == kind} for kind in (True, False))
    if not positive or not rest:
        scratch.drop("rows")
        return None
    hold, own = _two(positive, lambda f: f < 2)
    (p_fit, p_held), (u_fit, u_held) = _two(own, lambda f: f % 2 == 0), _two(rest, lambda f: f % 2 == 0)

    def of(p: set[int], u: set[int]) -> tuple[DataFrame, int]:
        """The trusted rows of the folds p and the others of the folds u, and their number."""
        found = rows.where(F.when(F.col("trusted"), F.col("fold").isin(p)).otherwise(F.col("fold").isin(u)))
        return found, sum(n for (y, fold), n in count.items() if fold in (p if y else u))

    against = _fit_all(*of(p_fit, u_fit), None)
    levels = _scores(of(p_held, set())[0], against, lambda s: np.floor(np.clip(s / LEVEL, -LEVELS, LEVELS))).groupBy("score").agg(F.count("*").alias("n")).orderBy("score").collect()
    held = np.repeat([r.score * LEVEL for r in levels], [r.n for r in levels])
    prior = _counted_prior(docs.where(_fold().isin(u_held)), trusted, against, held, np.zeros(0, np.int64))
    model = _fit_all(*of(own, rest), prior)
    model.prior = prior
    # The score of this rank among the positives held out, if it is below 0.
    kept, n = of(hold, set())
    rank = int(LOSS * (n - 1)) + 1
    low = _scores(kept, model, _rounded).where("score < 0").orderBy("score").limit(rank).agg(F.count("*").alias("n"), F.max("score").alias("top")).first()
    model.threshold = low.top if low.n == rank else 0.0
    scratch.drop("rows")
    return model


def _rounded(score: np.ndarray) -> np.ndarray:
    return np.round(score, 6)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score, accepted), a row for each row of ``docs``.

    ``score`` is the network's; a document is accepted if it reaches the threshold, which is 0 or as much lower as
    it takes to keep all but a share LOSS of the held-out trusted positives. Scores are rounded to 6 digits: the sums behind
    them are of doubles, whose last bits follow the order of rows and partitions.

    Defined results: null texts have a null score and are accepted; empty texts are scored as texts of no words.
    With no trusted positive or no unlabelled document there is no model: scores are null, all is accepted.
    Labels without a document, null labels and repeated labels change nothing. Repeated rows get equal scores.
    Whole texts are read. Other columns are ignored. doc_id must be a number.
    """
    model = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, unknown, accepted = _judge(model, as_array(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, mask=unknown), pa.array(accepted)], ["doc_id", "score", "accepted"])

    return map_arrow(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")), run, "doc_id bigint, score double, accepted boolean")


def _judge(model: Model | None, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score, whether there is none, accepted)."""
    if model is None:
        return np.zeros(len(texts)), np.ones(len(texts), bool), np.ones(len(texts), bool)
    unknown = pc.is_null(texts).to_numpy(zero_copy_only=False)
    score = _rounded(model.score(features(texts)))
    return score, unknown, unknown | (score >= model.threshold)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``classify`` accepts, columns unchanged."""
    model = train(docs, labels)
    return filter_rows(docs, ["text"], lambda text: _judge(model, as_array(text))[2])


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
