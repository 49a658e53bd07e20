import random

import numpy as np
import pytest

from veldra.llm import mixing

SCHEMA = "doc_id bigint, text string, source string, lang string"


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    return [(k, "w " * int(rng.lognormvariate(3, 1) + 1), rng.choice("aabc"), rng.choice(["en", "en", "fr", None])) for k in range(n)]


def brute_force(rows, source_share, lang_share):
    """Iterative scaling on whole documents, with the length constraint met by bisection."""
    t = np.array([len(r[1].split()) for r in rows], float)
    s = np.array([r[2] or mixing.NONE for r in rows])
    lang = np.array([r[3] or mixing.NONE for r in rows])
    q = t / t.sum()
    x = np.log1p(t)
    mean = (q * x).sum()

    def fit(c):
        p = q * np.exp(c * (x - mean))
        for _ in range(4000):
            for k, v in source_share.items():
                p[s == k] *= v / p[s == k].sum()
            for k, v in lang_share.items():
                p[lang == k] *= v / p[lang == k].sum()
        return p

    lo, hi = -2.0, 2.0
    for _ in range(50):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (fit(mid) * x).sum() < mean else (lo, mid)
    return fit((lo + hi) / 2) / q


def test_against_iterative_scaling(spark):
    rows = corpus()
    source, lang = {"a": 0.2, "b": 0.3, "c": 0.5}, {"en": 0.4, "fr": 0.3, mixing.NONE: 0.3}
    got = sorted(mixing.mix_rates(spark.createDataFrame(rows, SCHEMA), source_weights=source, lang_weights=lang).collect(), key=lambda r: r.doc_id)
    want = brute_force(rows, source, lang)
    assert np.allclose([r.rate for r in got], want, rtol=1e-4)
    assert all(int(r.rate) <= r.copies <= int(r.rate) + 1 for r in got)


def test_targets_are_met(spark, sf):
    got = mixing.op10_mixing(spark, sf).toPandas()
    got["mass"] = got.tokens * got.rate
    for column, power in (("source", mixing.SOURCE_POWER), ("lang", mixing.LANG_POWER)):
        share = got.groupby(column).tokens.sum() / got.tokens.sum()
        target = share**power / (share**power).sum()
        assert np.allclose(got.groupby(column).mass.sum() / got.tokens.sum(), target, atol=1e-6)
    x = np.log1p(got.tokens)
    assert np.isclose((got.mass * x).sum() / got.mass.sum(), (got.tokens * x).sum() / got.tokens.sum(), atol=1e-6)
    assert abs(got.copies.sum() - got.rate.sum()) < 4 * np.sqrt(len(got))


def test_mix_gives_the_copies(spark):
    rows = corpus(200, 2)
    docs = spark.createDataFrame([(*r, 9) for r in rows], SCHEMA + ", rate int")
    options = {"source_weights": {"a": 0.1, "b": 0.9}}
    copies = {r.doc_id: r.copies for r in mixing.mix_rates(docs, **options).collect()}
    mixed = mixing.mix(docs, **options)
    assert mixed.columns == docs.columns
    count = {}
    for r in mixed.collect():
        count[r.doc_id] = count.get(r.doc_id, 0) + 1
    assert count == {k: n for k, n in copies.items() if n}
    assert all(n == 0 for (k, _, s, _), n in zip(rows, (copies[r[0]] for r in rows)) if s == "c")


def test_edge_cases(spark):
    rows = [(1, None, "a", "en"), (2, "", "a", "en"), (3, " \n ", None, None), (4, "one", "a", "en"), (4, "one", "a", "en"), (None, "two words", "b", "fr"), (5, "w " * 200_000, "b", "en")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA + ", tokens int")
    got = mixing.mix_rates(docs).collect()
    assert len(got) == len(rows)
    assert all(r.rate == 1.0 and r.copies == 1 for r in got if r.tokens == 0)
    assert len({(r.rate, r.copies) for r in got if r.doc_id == 4}) == 1
    assert [r.tokens for r in got if r.doc_id == 5] == [200_000]
    assert mixing.mix_rates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    blank = spark.createDataFrame(rows[:3], SCHEMA)
    assert mixing.mix(blank).count() == 3
    with pytest.raises(ValueError):
        mixing.mix_rates(docs, source_weights={"other": 1.0})


def test_contradicting_targets(spark):
    """A source in one language only: its target is also that of the language."""
    rows = [(k, "w " * (5 + k % 7), *(("a", "en") if k % 3 else ("b", "fr"))) for k in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA)
    with pytest.raises(ValueError, match="contradict"):
        mixing.mix_rates(docs, source_weights={"a": 0.9, "b": 0.1}, lang_weights={"en": 0.1, "fr": 0.9})
    with pytest.warns(UserWarning, match="moved"):
        got = mixing.mix_rates(docs).toPandas()
    # The source targets hold all the same.
    got["mass"] = got.tokens * got.rate
    share = got.groupby("source").tokens.sum() / got.tokens.sum()
    target = share**mixing.SOURCE_POWER / (share**mixing.SOURCE_POWER).sum()
    assert np.allclose(got.groupby("source").mass.sum() / got.tokens.sum(), target, atol=1e-6)


@pytest.mark.parametrize("broadcast", [True, False])
def test_clashing_names(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    names = ["s", "a", "l", "t", "w", "n", "key_", "group_", "lang_", "tokens_", "rate_", "copies_", "copy_", "source_tilt_", "c0", "c1", "added", "a.b", "a`b", "__s", "__copies", "__t"]
    rows = corpus(100, 4)
    docs = spark.createDataFrame([(*r, *(f"{n}{r[0]}" for n in names)) for r in rows], SCHEMA + "".join(f", `{n.replace('`', '``')}` string" for n in names))
    copies = {r.doc_id: r.copies for r in mixing.mix_rates(docs).collect()}
    got = mixing.mix(docs)
    assert got.columns == docs.columns
    found = got.collect()
    assert len(found) == sum(copies.values())
    assert all(tuple(r)[4:] == tuple(f"{n}{r[0]}" for n in names) for r in found)
