"""Language identification by rank-order n-gram profiles (out-of-place distance).

Letter n-grams of 1 to ``MAX_N`` letters are taken from each word, padded with a mark at
either end. A language profile is the list of its ``PROFILE`` most frequent n-grams. A
document's own most frequent n-grams are ranked alike, and its distance to a language is
the mean, over its n-grams, of how far each is out of place there (at most PROFILE),
divided by PROFILE: 0 is a perfect match, 1 shares nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from .arrays import U64, as_array, buffers, mix, slices
from .scratch import filter_rows, map_arrow, table

MAX_N = 3
PROFILE = 400
#: Documents a language whose n-grams make its profile: those of the least hashed doc_id.
SAMPLE = 2000
#: Declared languages that there may be; what is broadcast and collected is a few hundred rows for each.
MAX_LANGS = 1000
#: A document is rejected only if it has as many distinct n-grams; shorter ones say too little.
MIN_GRAMS = 60
MAX_DISTANCE = 0.80
#: By how much another language must be nearer than the declared one for the document to be rejected.
MARGIN = 0.20

_DOC, _COUNT, _ENTRY = 10, 28, 26
_GRAM = 64 - _DOC


def _letters(code: np.ndarray) -> np.ndarray:
    """Which code points are letters: ASCII a-z, and all beyond ASCII but for punctuation, symbols and spaces."""
    return ((code >= 97) & (code <= 122)) | ((code >= 0xC0) & (code != 0xD7) & (code != 0xF7) & ~((code >= 0x2000) & (code <= 0x2BFF)) & ~((code >= 0x3000) & (code <= 0x303F)) & ~((code >= 0xE000) & (code <= 0xF8FF)) & (code < 0x1F000)) | (code == 0xAA) | (code == 0xB5) | (code == 0xBA)


def grams(texts: pa.Array, max_n: int = MAX_N) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, n-gram hash of 54 bits, count) of at most 1024 texts, sorted by document and hash."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    padded = pc.binary_join_element_wise(pa.scalar("", texts.type), pc.utf8_lower(texts), pa.scalar("", texts.type), pa.scalar(" ", texts.type))
    data, offsets = buffers(padded)
    place = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
    code = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters(code)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[place[:-1]] = True
    doc = np.repeat(np.arange(len(texts), dtype=np.uint64), np.diff(place))[keep]
    code = np.where(letter, code, 0)[keep].astype(U64)
    found = [(doc << U64(_GRAM) | mix(code) >> U64(_DOC))[code > 0]]
    joined = code
    for n in range(2, max_n + 1):
        joined = mix(joined[:-1] * U64(0x100000001B3) + code[n - 1 :]) if n > 2 else code[:-1] + U64(1) << U64(24) | code[1:]
        if n == 2:
            inside = doc[:-1] == doc[1:]
            # A mark may stand at either end of an n-gram, never within it.
            whole = np.ones(len(joined), bool)
        else:
            whole = whole[:-1] & (code[n - 2 : len(code) - 1] > 0)
            inside = doc[: len(joined)] == doc[n - 1 :]
        ok = inside & whole
        found.append(doc[: len(joined)][ok] << U64(_GRAM) | mix(joined[ok] + U64(n)) >> U64(_DOC))
    key = np.concatenate(found)
    key.sort()
    bound = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True]))) if len(key) else np.zeros(1, np.int64)
    key = key[bound[:-1]]
    return (key >> U64(_GRAM)).astype(np.int64), (key & U64((1 << _GRAM) - 1)).astype(np.int64), np.diff(bound)


def ranked(doc: np.ndarray, gram: np.ndarray, count: np.ndarray, n: int, size: int = PROFILE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, n-gram, rank from 0) of each document's ``size`` most frequent n-grams; ties go by hash."""
    key = doc.astype(U64) << U64(_COUNT + _ENTRY) | (U64((1 << _COUNT) - 1) - count.astype(U64)) << U64(_ENTRY) | np.arange(len(doc), dtype=U64)
    key.sort()
    entry = (key & U64((1 << _ENTRY) - 1)).astype(np.int64)
    first = np.searchsorted(doc, np.arange(n + 1))
    rank = np.arange(len(entry)) - first[doc[entry]]
    entry, rank = entry[rank < size], rank[rank < size]
    return doc[entry], gram[entry], rank


def distances(texts: pa.Array, profile_grams: np.ndarray, profile_ranks: np.ndarray, max_n: int = MAX_N, size: int = PROFILE) -> tuple[np.ndarray, np.ndarray]:
    """(distance to each language (n, languages), n-grams ranked (n)); documents without n-grams are at distance 1."""
    n, langs = len(texts), profile_ranks.shape[1]
    doc, gram, rank = ranked(*grams(texts, max_n), n, size)
    count = np.bincount(doc, minlength=n)
    far = np.ones((n, langs))
    if not langs or not len(doc):
        return far, count
    at = np.minimum(np.searchsorted(profile_grams, gram), len(profile_grams) - 1)
    known = profile_grams[at] == gram
    for k in range(langs):
        theirs = profile_ranks[at, k]
        off = np.where(known & (theirs >= 0), np.abs(theirs - rank), size)
        far[:, k] = np.where(count > 0, np.bincount(doc, off, n) / np.maximum(count, 1) / size, 1.0)
    return far, count


def _count_grams(max_n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs = as_array(batch.column(1)), batch.column(0)
            for a, b in slices(texts, 1 << 19, 1 << _DOC):
                doc, gram, count = grams(texts.slice(a, b - a), max_n)
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(doc + a)), pa.array(gram), pa.array(count.astype(np.int64))], ["lang", "gram", "n"])

    return run


def _sampled(docs: DataFrame, sample: int) -> DataFrame:
    """(lang, text) of the ``sample`` documents of least hashed doc_id of each language.

    No language is gathered in one place: a share of its hashes that surely holds the sample is sorted, which gives the
    hash up to which its documents belong to it.
    """
    span = 1 << 40
    die = F.pmod(F.xxhash64("doc_id"), F.lit(span))
    rows = docs.select(die.alias("die"), F.col("doc_id").alias("id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("id is not null and lang is not null")
    # Counts of a language's documents, a row a language.
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("die", 0.02).alias("n")).limit(MAX_LANGS + 1).collect()
    if len(counts) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} declared languages; fold the small ones first")
    if not counts:
        return rows.select("lang", "text").where("false")
    spark = docs.sparkSession
    margin = 1.2 * sample + 10 * sample**0.5 + 20
    bounds = F.broadcast(spark.createDataFrame([(r.lang, int(min(1.0, margin / max(1, r.n)) * span)) for r in counts], "of string, below bigint"))
    least = rows.select("lang", "die").join(bounds, F.col("lang") == F.col("of")).where("die < below").select("lang", "die").distinct()
    last = least.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("die"))).where(F.col("k") <= sample).groupBy("lang").agg(F.max("die").alias("last"))
    ends = F.broadcast(spark.createDataFrame([(r.lang, r["last"]) for r in last.collect()], "of string, last bigint"))
    return rows.join(ends, F.col("lang") == F.col("of")).where("die <= last").select("lang", "text")


def profiles(docs: DataFrame, sample: int = SAMPLE, max_n: int = MAX_N, size: int = PROFILE) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, n-gram hashes sorted, ranks (n-grams, languages) or -1), from the documents' declared languages.

    The result has ``size`` rows a language, and there may be at most MAX_LANGS. ``sample`` bounds the training
    documents a language.
    """
    total = map_arrow(_sampled(docs, sample), _count_grams(max_n), "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = total.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")) - 1).where(F.col("rank") < size).select("lang", "gram", "rank").toPandas()
    names = sorted(top["lang"].unique())
    known = np.unique(top["gram"].to_numpy(np.int64))
    ranks = np.full((len(known), len(names)), -1, np.int32)
    ranks[np.searchsorted(known, top["gram"].to_numpy(np.int64)), np.searchsorted(names, top["lang"])] = top["rank"].to_numpy()
    return names, known, ranks


def identify(docs: DataFrame, sample: int = SAMPLE, max_n: int = MAX_N, size: int = PROFILE, min_grams: int = MIN_GRAMS, max_distance: float = MAX_DISTANCE, margin: float = MARGIN) -> DataFrame:
    """(doc_id, declared, predicted, distance, declared_distance, grams, accepted), a row for each row of ``docs``.

    ``accepted`` is false where the text has at least ``min_grams`` distinct n-grams and either no language is
    within ``max_distance``, or a language is nearer than the declared one by more than ``margin``.

    Defined results: null, empty and letterless texts have no prediction, distance 1 and are accepted, as nothing
    speaks against them. A null declared language is never contradicted. Equal distances go to the language first
    in the alphabet. Repeated rows give repeated results. Without any declared language nothing is predicted or
    rejected. Whole texts are read. Other columns are ignored. doc_id must be a number; more than MAX_LANGS declared
    languages raise ValueError.
    """
    judge = _judge(*profiles(docs, sample, max_n, size), max_n, size, min_grams, max_distance, margin)
    schema = "doc_id bigint, declared string, predicted string, distance double, declared_distance double, grams int, accepted boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            predicted, least, declared, count, accepted = judge(batch.column(1), as_array(batch.column(2)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), predicted, pa.array(least), pa.array(declared, mask=np.isnan(declared)), pa.array(count.astype(np.int32)), pa.array(accepted)],
                schema.replace(",", "").split()[::2],
            )

    return map_arrow(docs.select(F.col("doc_id").cast("bigint"), F.col("lang").cast("string"), F.col("text").cast("string")), run, schema)


def _judge(names: list[str], known: np.ndarray, ranks: np.ndarray, max_n: int, size: int, min_grams: int, max_distance: float, margin: float):
    """A function of (declared languages, texts) to (predicted, distance, declared distance, n-grams, accepted)."""

    def judge(langs: pa.Array, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        n = len(texts)
        far, count = np.ones((n, len(names))), np.zeros(n, np.int64)
        for a, b in slices(texts, 1 << 19, 1 << _DOC):
            far[a:b], count[a:b] = distances(texts.slice(a, b - a), known, ranks, max_n, size)
        declared = np.full(n, np.nan)
        best, least = np.zeros(n, np.int64), np.ones(n)
        if names and n:
            place = {name: k for k, name in enumerate(names)}
            own = np.array([place.get(x, -1) for x in langs.to_pylist()], np.int64)
            best, least = far.argmin(1), far.min(1)
            declared = np.where(own >= 0, far[np.arange(n), own], np.nan)
        told = (count > 0) & bool(names)
        bad = told & (count >= min_grams) & ((least > max_distance) | (np.nan_to_num(declared, nan=-1.0) > least + margin))
        predicted = pa.array([names[k] if t else None for k, t in zip(best.tolist(), told.tolist())], pa.string())
        return predicted, least, declared, count, ~bad

    return judge


def keep_identified(docs: DataFrame, sample: int = SAMPLE, max_n: int = MAX_N, size: int = PROFILE, min_grams: int = MIN_GRAMS, max_distance: float = MAX_DISTANCE, margin: float = MARGIN) -> DataFrame:
    """The rows of ``docs`` that ``identify`` accepts, columns unchanged."""
    judge = _judge(*profiles(docs, sample, max_n, size), max_n, size, min_grams, max_distance, margin)
    return filter_rows(docs, ["lang", "text"], lambda lang, text: judge(lang, as_array(text))[4])


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
