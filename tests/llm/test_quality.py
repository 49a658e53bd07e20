import numpy as np
import pyarrow as pa

from veldra.llm import quality

DOCS, LABELS = "doc_id bigint, text string", "doc_id bigint, quality int, toxic int"


def test_features_are_the_same_in_any_batch():
    texts = ["A text.\nTwo lines!", "", "WORD!! WORD!!", "x " * 3000, "été"]
    whole = quality.features(pa.array([*texts, None]))
    assert np.allclose(whole[:5], np.concatenate([quality.features(pa.array([t])) for t in texts]))
    assert np.allclose(whole[5], whole[1]) and whole.shape == (6, quality.FEATURES) and np.isfinite(whole).all()


def plain_risk(g, k, prior):
    """The risk by its definition; the second value is the part that is kept from falling below zero."""
    loss = lambda z: np.log1p(np.exp(-z))
    negative = loss(-g[k:]).mean() - prior * loss(-g[:k]).mean()
    return prior * loss(g[:k]).mean() + max(0.0, negative), negative


def test_gradients_by_differences():
    """Both sides of the non-negative correction, and back through the network, against differences of the risk by definition."""
    rng = np.random.default_rng(2)
    signs = set()
    for prior in (0.2, 0.9, 0.95):
        for shift in (-1.0, 1.5):
            n, k = 30, 12
            x = rng.normal(0, 1, (n, 5))
            m = quality.Model(np.zeros(5), np.ones(5), rng.normal(0, 1, (5, 4)), rng.normal(0, 1, 4), rng.normal(0, 1, 4), shift)
            x[:k] += 0.8 * shift

            def value():
                g = np.maximum(x @ m.w1 + m.b1, 0) @ m.w2 + m.b2
                risk, negative = plain_risk(g, k, prior)
                return (risk if negative >= 0 else -negative), negative

            got, grads = quality.gradients(m, x, k, prior)
            want, negative = value()
            signs.add(negative >= 0)
            assert np.isclose(got, want)
            for array, grad in ((m.w1, grads[0]), (m.b1, grads[1]), (m.w2, grads[2])):
                for at in np.ndindex(array.shape):
                    kept = array[at]
                    array[at] = kept + 1e-6
                    up = value()[0]
                    array[at] = kept - 1e-6
                    down = value()[0]
                    array[at] = kept
                    assert np.isclose(grad[at], (up - down) / 2e-6, atol=1e-5)
            m.b2 += 1e-6
            up = value()[0]
            m.b2 -= 2e-6
            assert np.isclose(grads[3][0], (up - value()[0]) / 2e-6, atol=1e-5)
    assert signs == {True, False}


def test_prior_is_counted_over_all_documents(spark):
    """The distributed count against the same by hand."""
    rng = np.random.default_rng(3)
    texts = ["good words stand here, in a calm order " * int(rng.integers(1, 9)) if rng.random() < 0.6 else "BAD!! $$ " * int(rng.integers(1, 30)) for _ in range(400)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(None, "no id, but a text"), (900, None)], DOCS).repartition(5)
    trusted = spark.createDataFrame([(k,) for k in range(0, 400, 5)] + [(7777,)], "tid bigint")
    x = quality.features(pa.array(texts))
    model = quality.fit(x[::5], x, None, steps=50)
    held, fitted = np.sort(model.score(x[::5])), np.arange(1, 400, 7)
    left = [k for k in range(400) if k % 5 and k not in set(fitted)]
    su = np.sort(np.concatenate((model.score(x[left]), model.score(quality.features(pa.array(["no id, but a text"]))))))
    want = quality.best_bin(held, len(su) - np.searchsorted(su, held), len(su))
    assert np.isclose(quality._counted_prior(docs, trusted, model, held, fitted), want)


def test_all_documents_take_part(spark, monkeypatch):
    """The distributed training against the same in memory, on more rows than were once sampled."""
    monkeypatch.setattr(quality, "STEPS", 12)
    rng = np.random.default_rng(4)
    n, step = 15000, 3
    rows = [(k, ("good words, in a calm order. " if k % step == 0 or rng.random() < 0.5 else "BAD!! $$ ") * int(rng.integers(1, 6)) + str(k)) for k in range(n)]
    docs = spark.createDataFrame([*rows, (None, "no id, but a text"), (n, None), (0, "a row of an id there is")], DOCS).repartition(5)
    labels = spark.createDataFrame([(k, 1, 0) for k in range(0, n, step)] + [(None, 1, 0), (n + 9, 1, 0), (1, 0, 0)], LABELS)
    model = quality.train(docs, labels)
    got = docs.where("text is not null").select("doc_id", "text", quality._fold().alias("fold")).toPandas()
    x, fold = quality.features(pa.array(got.text)).astype(float), got.fold.to_numpy()
    y = (got.doc_id % step == 0).to_numpy()
    assert y.sum() > 4000 and (~y).sum() > 8000
    hold, half = fold < 2, fold % 2 == 0
    assert len(set(fold[y])) == len(set(fold[~y])) == quality.FOLDS
    against = quality.fit(x[y & ~hold & half], x[~y & half], None)
    held = np.sort(np.floor(against.score(x[y & ~hold & ~half]) / quality.LEVEL) * quality.LEVEL)
    su = np.sort(against.score(x[~y & ~half]))
    prior = quality.best_bin(held, len(su) - np.searchsorted(su, held), len(su))
    assert np.isclose(model.prior, prior)
    want = quality.fit(x[y & ~hold], x[~y], prior)
    assert np.allclose(model.mean, x[~(y & hold)].mean(0)) and np.allclose(model.scale, want.scale)
    assert np.allclose(model.score(x), want.score(x), atol=1e-6)
    low = np.quantile(np.round(want.score(x[y & hold]), 6), quality.LOSS, method="lower")
    assert np.isclose(model.threshold, min(0.0, low), atol=1e-5)


def test_risk_and_prior_on_known_mixture():
    rng = np.random.default_rng(1)
    n = 3000
    p = rng.normal(1.5, 1, (n, 6))
    good = rng.random(n) < 0.7
    u = np.where(good[:, None], rng.normal(1.5, 1, (n, 6)), rng.normal(-1.5, 1, (n, 6)))
    prior = quality.estimate_prior(p, u)
    assert 0.6 < prior < 0.8
    model = quality.fit(p, u, prior)
    assert ((model.score(u) > 0) == good).mean() > 0.95


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    # Every third label is held out of training altogether.
    train = labels.where("doc_id % 3 != 0")
    got = quality.classify(docs, train).join(labels.where("doc_id % 3 = 0"), "doc_id").toPandas()
    good, bad = got[got.quality == 1], got[got.quality == 0]
    assert len(good) > 80 and len(bad) > 5
    assert good.accepted.mean() >= 0.98
    assert (~bad.accepted).mean() >= 0.7


def test_edge_cases(spark):
    rows = [(k, f"A plain text number {k} with words, and a full stop. It goes on a little.") for k in range(40)] + [(100 + k, "BUY!! " * (k + 3)) for k in range(20)]
    odd = [(200, None), (201, ""), (None, "a null id"), (5, "A plain text number 5, again."), (202, "long words " * 50_000)]
    docs = spark.createDataFrame([(*r, 0.5, "x") for r in rows + odd], DOCS + ", score double, x string")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(0, 40, 2)] * 2 + [(None, 1, 0), (999, 1, 0), (100, 0, 0), (101, None, None)], LABELS)
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r for r in got}
    assert by[200].score is None and by[200].accepted
    assert by[201].score is not None
    assert quality.keep_good(docs, labels).columns == docs.columns
    none = labels.where("quality = 7")
    assert all(r.accepted and r.score is None for r in quality.classify(docs, none).collect())
    assert quality.keep_good(docs, none).count() == len(got)
    empty = spark.createDataFrame([], DOCS)
    assert quality.classify(empty, labels).count() == 0
