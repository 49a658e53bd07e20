"""URL filter: host names are split into words, and a naive Bayes model scores host and path words.

Concatenated names (``cheappillsonline``) are segmented by the Viterbi algorithm under a
unigram model: word shares counted over the visible text of all pages, mixed with a small
built-in list of web words. Only words that occur inside some host name are kept for that,
joined to the hosts they occur in, so no lexicon is held in one place. A multinomial naive
Bayes model then scores the words. It is trained on a table of labelled addresses, whose hosts
are segmented like the others, or where there is none on the labelled phrases below.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .scratch import Scratch, map_arrow, table

#: Labelled training phrases of the classifier.
BLOCK = [
    "casino win", "online casino", "casino bonus", "free casino spins", "slots jackpot", "poker bonus", "live poker", "free bets", "free bets bonus", "sports betting odds", "bet now win", "bets bookmaker", "lottery jackpot win", "roulette gambling",
    "cheap pills", "buy pills online", "viagra cialis", "cheap viagra", "discount pharmacy", "online pharmacy pills", "weight loss pills", "diet pills",
    "ads track", "ad tracker", "click track", "tracking pixel", "ads server", "ads click", "popup ads", "banner ads", "affiliate track", "spam mail", "spam farm", "link farm", "spam links", "click bait",
    "payday loans", "cheap loans fast cash", "fast cash now", "get rich quick", "replica watches", "cheap replica bags", "free download crack", "warez keygen crack", "torrent crack serial",
    "xxx porn", "porn sex videos", "adult sex cams", "adult content", "adult videos", "adult dating", "sexy cams xxx", "escort girls", "hot singles dating", "malware virus", "phishing login verify", "free gift card prize", "free iphone winner", "crypto doubler", "seo backlinks cheap",
]
ALLOW = [
    "news article", "world news", "daily news today", "local news report", "blog post", "tech blog", "food recipes", "cooking recipes", "city guide", "travel guide", "history archive", "public library", "library catalog", "open archive",
    "science journal", "research paper", "university department", "school district", "education course", "learn online course", "math lesson", "language lesson", "docs reference", "api docs", "developer docs", "help center", "support faq", "wiki page", "wiki index",
    "health clinic", "city hospital", "government office", "state law", "music review", "film review", "book review", "book store", "art museum", "sports team", "football club", "garden home", "family photo", "photo gallery", "weather forecast", "job search", "company about",
    "contact us", "privacy policy", "terms", "forum thread", "community forum", "question answer", "product page", "shop home", "online shop", "open source project", "software download", "data set", "maps street", "mail", "static page", "category tag", "free software",
]
#: Words taken as known whatever the corpus.
WEB_WORDS = sorted({w for phrase in BLOCK + ALLOW for w in phrase.split()} | set("the of and to in for on with at by from my your our best top new all world web site net info hub zone club store shop direct express group global media digital tv radio".split()))
WEB_SHARE = 0.2
#: Letters of the longest word that is looked up; no label of a host name may be longer than 63 (RFC 1035).
LONGEST = 63
#: Labelled addresses that the model is trained on at most, those of the least hash.
LABELLED = 20_000
PRIOR = 0.1
SMOOTHING = 0.5
THRESHOLD = 0.0
_HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)"
#: Labels that name a service or a registry rather than a site.
_COMMON = {"www", "m", "com", "org", "net", "edu", "gov", "info", "co", "uk"}


def labels(host: str) -> list[str]:
    """The letter runs of a host name, in order."""
    out, run = [], ""
    for c in host.lower() + ".":
        if c.isalpha():
            run += c
        elif run:
            out.append(run)
            run = ""
    return out


def segment(text: str, share: dict[str, float], longest: int = LONGEST) -> list[str]:
    """The most probable split of ``text`` into words; among equals, the one of fewest words, then of longest last word.

    A word of n letters that isn't in ``share`` has probability 1e-4 * 26^-n, however long it is; of the words in it those
    of at most ``longest`` letters are looked up.
    """
    unknown, letter = math.log(1e-4), math.log(26)
    score = {w: math.log(p) for w, p in share.items() if p > 0}
    longest = min(longest, max(map(len, score), default=0))
    best: list[tuple[float, int, int]] = [(0.0, 0, 0)]
    # Of all beginnings of an unknown word the best doesn't depend on where it ends.
    run = (0.0, 0, 0)
    for end in range(1, len(text) + 1):
        options = [(round(run[0] + unknown - end * letter, 9), run[1] - 1, run[2])]
        for begin in range(max(0, end - longest), end):
            p = score.get(text[begin:end])
            if p is not None:
                options.append((round(best[begin][0] + p, 9), best[begin][1] - 1, -begin))
        top = max(options)
        best.append((top[0], top[1], -top[2]))
        run = max(run, (round(top[0] + end * letter, 9), top[1], -end))
    out, end = [], len(text)
    while end:
        out.append(text[best[end][2] : end])
        end = best[end][2]
    return out[::-1]


def ratios(block: Counter, allow: Counter, smoothing: float = SMOOTHING) -> dict[str, float]:
    """Log-likelihood ratio of each known word under the multinomial model of block against allow."""
    known = sorted(block | allow)
    total = [sum(c.values()) + smoothing * len(known) for c in (block, allow)]
    return {w: math.log((block[w] + smoothing) / total[0]) - math.log((allow[w] + smoothing) / total[1]) for w in known}


def train(block: list[str] = BLOCK, allow: list[str] = ALLOW, smoothing: float = SMOOTHING, prior: float = PRIOR) -> tuple[dict[str, float], float]:
    """(log-likelihood ratio of each known word, log prior odds) of the multinomial model of block against allow."""
    counts = [Counter(w for phrase in phrases for w in phrase.split()) for phrases in (block, allow)]
    return ratios(*counts, smoothing), math.log(prior / (1 - prior))


def _substrings(longest: int):
    """(host_id, word): every stretch of at most ``longest`` letters of a host's labels; some thousand hosts at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, words = [], []
            for host_id, host in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for label in set(labels(host)):
                    for first in range(0, len(label), 4096):  # parts of a label beyond what a host name may have
                        own = list({label[i:j] for i in range(first, min(first + 4096, len(label))) for j in range(i + 1, min(len(label), i + longest) + 1)})
                        ids += [host_id] * len(own)
                        words += own
                        if len(ids) > 1 << 16:
                            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.string())], ["host_id", "word"])
                            ids, words = [], []
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.string())], ["host_id", "word"])

    return run


def _segment(total: int, longest: int):
    """(host, host_words) from (host, words and counts found in it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, out = batch.column(0).to_pylist(), []
            for host, found in zip(hosts, batch.column(1).to_pylist()):
                share = {x["word"]: (1 - WEB_SHARE) * x["n"] / total for x in found or []}
                for w in WEB_WORDS:
                    if w in host:
                        share[w] = share.get(w, 0.0) + WEB_SHARE / len(WEB_WORDS)
                out.append([w for label in labels(host) for w in ([label] if label in _COMMON else segment(label, share, longest)) if w not in _COMMON])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string()))], ["host", "host_words"])

    return run


def _addresses(urls: DataFrame) -> DataFrame:
    """``urls`` with the columns host (null where there is none) and path_words, from its column url."""
    host = F.nullif(F.lower(F.regexp_extract("url", _HOST, 1)), F.lit(""))
    path = F.split(F.lower(F.coalesce(F.regexp_extract("url", _PATH, 1), F.lit(""))), r"[^\p{L}]+")
    return urls.withColumns({"host": host, "path_words": F.filter(path, lambda w: w != "")})


def filter_urls(pages: DataFrame, threshold: float = THRESHOLD, longest: int = LONGEST, prior: float = PRIOR, labelled: DataFrame | None = None, sample: int = LABELLED) -> DataFrame:
    """(page_id, url, host, host_words, path_words, score, blocked), a row for each row of ``pages``.

    ``score`` is the log odds of the block class given the segmented host words and the path words (letter runs of
    the path); words the model wasn't trained on say nothing. ``blocked`` is score > threshold. The model is trained on
    ``labelled`` (url, blocked), of which at most ``sample`` rows are used, those of the least hash; without it on the
    phrases BLOCK and ALLOW.

    Defined results: a null url, or one without scheme and host, has a null host, no words, the prior's score, and is
    not blocked. Upper case makes no difference. Pages with null html lend no words to the lexicon; a lexicon without
    words leaves the built-in list. Hosts and labels of any length are split whole; words of more than ``longest``
    letters aren't known in them. Labelled rows with a null url or label are left out. Repeated rows get equal results.
    Other columns are ignored. page_id must be a number.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark)
    rows = _addresses(pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string")))
    # Counts of the words of all pages' visible text.
    text = F.regexp_replace(F.lower(F.col("html").cast("string")), r"(?s)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>|&#?[a-z0-9]+;", " ")
    counts = pages.select(F.explode(F.split(text, r"[^\p{L}]+")).alias("word")).where("word != ''").groupBy("word").agg(F.count("*").alias("n"))
    counts = scratch.save(counts, "counts")
    total = counts.agg(F.sum("n")).first()[0] or 1
    taught = None
    if labelled is not None:
        taught = labelled.select(F.col("url").cast("string"), F.col("blocked").cast("boolean")).where("url is not null and blocked is not null").orderBy(F.xxhash64("url"), "url", "blocked").limit(sample)
        taught = scratch.save(_addresses(taught), "taught")
    hosts = rows.select("host") if taught is None else rows.select("host").union(taught.select("host"))
    hosts = scratch.save(hosts.where("host is not null").distinct().select(F.xxhash64("host").alias("host_id"), "host"), "hosts")
    # Two hosts of one hash lend each other the words found in them; words that don't occur in a host are never used.
    inside = map_arrow(hosts, _substrings(longest), "host_id bigint, word string").join(counts.withColumnRenamed("word", "known"), F.col("word") == F.col("known"))
    lexicon = inside.groupBy("host_id").agg(F.collect_set(F.struct("word", "n")).alias("found")).withColumnRenamed("host_id", "known_id")
    found = hosts.join(lexicon, F.col("host_id") == F.col("known_id"), "left").select("host", "found")
    split = scratch.save(map_arrow(found, _segment(total, longest), "host string, host_words array<string>").withColumnRenamed("host", "split_host"), "split")
    none = F.array().cast("array<string>")
    if taught is None:
        ratio, odds = train(prior=prior)
    else:
        known = taught.join(split, F.col("host") == F.col("split_host"), "left").select("blocked", F.explode(F.concat(F.coalesce("host_words", none), "path_words")).alias("word"))
        by_class = [Counter(), Counter()]
        for r in known.groupBy("blocked", "word").agg(F.count("*").alias("n")).collect():
            by_class[not r.blocked][r.word] = r.n
        ratio, odds = ratios(*by_class), math.log(prior / (1 - prior))
    scratch.drop("counts", "hosts", "taught")
    joined = rows.join(split, F.col("host") == F.col("split_host"), "left").select("page_id", "url", "host", F.coalesce("host_words", none).alias("host_words"), "path_words")
    return joined.withColumn("score", F.round(_scored(ratio, odds), 9)).withColumn("blocked", F.col("host").isNotNull() & (F.col("score") > threshold))


def _scored(ratio: dict[str, float], odds: float):
    """The score of host_words and path_words. The model's words are those of a bounded number of addresses or phrases."""

    @F.pandas_udf("double")
    def scored(words: pd.Series) -> pd.Series:
        return pd.Series([odds + sum(ratio.get(w, 0.0) for w in own) for own in words], dtype="float64")

    return scored(F.concat("host_words", "path_words"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))
