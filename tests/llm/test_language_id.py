from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from veldra.llm import language
from veldra.llm.queries import QUERIES

SCHEMA = "doc_id bigint, lang string, text string"
EN = "the quick brown fox jumps over the lazy dog and then the dog sleeps in the warm sun while birds sing of the summer that has been and will be again in this old town"
DE = "der schnelle braune fuchs springt über den faulen hund und dann schläft der hund in der warmen sonne während die vögel vom sommer singen der gewesen ist und wieder kommt"


def plain_grams(text, max_n=language.MAX_N):
    out = Counter()
    word = ""
    for c in text.lower() + " ":
        if c.isalpha():
            word += c
            continue
        if word:
            padded = "_" + word + "_"
            out.update(word)
            for n in range(2, max_n + 1):
                out.update(padded[i : i + n] for i in range(len(padded) - n + 1))
        word = ""
    return out


def test_grams_match_plain_counts():
    texts = [EN, DE, "", "Ça va? Été 42 a", None, "a", "..", "x" * 5000, "été " * 3000]
    doc, gram, count = language.grams(pa.array(texts))
    for i, t in enumerate(texts):
        assert sorted(count[doc == i].tolist()) == sorted(plain_grams(t or "").values()), t


def test_same_gram_same_code_in_any_batch():
    a = language.grams(pa.array([EN, DE]))
    b = language.grams(pa.array([DE]))
    assert set(a[1][a[0] == 1]) == set(b[1])


def brute_distance(text, profile, size):
    """Out-of-place distance with n-grams ranked as the module ranks them."""
    _, gram, count = language.grams(pa.array([text]))
    own = [g for _, g in sorted(zip(-count, gram))][:size]
    return sum(abs(profile.get(g, None) - r) if g in profile else size for r, g in enumerate(own)) / len(own) / size


def test_distances_by_brute_force(spark):
    rows = [(k, "en", EN[k:]) for k in range(12)] + [(100 + k, "de", DE[k:]) for k in range(12)]
    docs = spark.createDataFrame(rows, SCHEMA)
    names, known, ranks = language.profiles(docs, size=80)
    assert names == ["de", "en"]
    for k, name in enumerate(names):
        total = Counter()
        for _, lang, text in rows:
            if lang == name:
                _, gram, count = language.grams(pa.array([text]))
                total.update(dict(zip(gram.tolist(), count.tolist())))
        profile = {g: r for r, (g, _) in enumerate(sorted(total.items(), key=lambda x: (-x[1], x[0]))[:80])}
        assert {int(g): int(r) for g, r in zip(known, ranks[:, k]) if r >= 0} == profile
        far, _ = language.distances(pa.array([EN, DE, "fox dog"]), known, ranks, size=80)
        for i, text in enumerate((EN, DE, "fox dog")):
            assert np.isclose(far[i, k], brute_distance(text, profile, 80))


def test_identify(spark):
    rows = [(k, "en", EN[k:]) for k in range(12)] + [(100 + k, "de", DE[k:]) for k in range(12)]
    rows += [(200, "de", EN * 2), (201, "en", None), (202, "en", ""), (203, None, DE), (204, "en", "123 !!"), (205, None, "Сегодня хорошая погода и мы гуляем по старому городу вместе с друзьями потом читаем книги"), (206, "en", "ok"), (None, "de", DE), (207, "en", EN * 2000)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", predicted string")
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    assert len(got) == len(rows)
    assert got[200].predicted == "en" and not got[200].accepted
    assert not got[205].accepted and got[205].distance > 0.8
    for k in (201, 202, 204):
        assert got[k].accepted and got[k].predicted is None and got[k].distance == 1.0
    assert got[203].accepted and got[203].predicted == "de" and got[203].declared_distance is None
    assert got[206].accepted and got[207].accepted
    kept = language.keep_identified(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(r[0] for r in rows if r[0] is not None and r[0] not in (200, 205))
    empty = spark.createDataFrame([], SCHEMA)
    assert language.identify(empty).count() == 0 and language.keep_identified(empty).count() == 0
    unlabelled = spark.createDataFrame([(1, None, EN)], SCHEMA)
    assert language.identify(unlabelled).first().accepted


def test_agrees_with_declared_language(spark, sf):
    got = QUERIES["op6_language_id"](spark, sf).toPandas()
    big = got[got.grams >= language.MIN_GRAMS]
    assert (big.declared == big.predicted).mean() > 0.98
    assert got.accepted.mean() > 0.98


def test_sample_is_that_of_the_least_hashes(spark, monkeypatch):
    rows = [(k, "en" if k % 3 else "de", str(k)) for k in range(3000)] + [(5, "en", "5"), (None, "en", "none"), (9000, None, "no language")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sorted((r.lang, r.text) for r in language._sampled(docs, 50).collect())
    die = {r.doc_id: r.die for r in docs.selectExpr("doc_id", "pmod(xxhash64(doc_id), 1099511627776) AS die").collect()}
    want = []
    for lang in ("de", "en"):
        ids = sorted({r[0] for r in rows if r[1] == lang and r[0] is not None}, key=die.get)[:50]
        want += [(lang, r[2]) for r in rows if r[1] == lang and r[0] in ids]
    assert got == sorted(want)
    monkeypatch.setattr(language, "MAX_LANGS", 1)
    with pytest.raises(ValueError):
        language.identify(docs)


def test_filter_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "en", EN, 1, 2, 3)], SCHEMA + ", `a.b` int, c0 int, `x y` int")
    kept = language.keep_identified(docs)
    assert kept.columns == docs.columns and kept.collect() == docs.collect()
