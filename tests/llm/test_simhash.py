import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veldra.llm import golay, simhash
from veldra.llm.components import components
from veldra.llm.scratch import Scratch

SCHEMA = "doc_id bigint, text string"


def words(rng, n, size=4000):
    return ["w" + "".join(rng.choice("abcdefghijklmnop") for _ in range(3 + k % 6)) for k in (rng.randrange(size) for _ in range(n))]


def edited(rng, text, share):
    return [rng.choice(words(rng, 3)) if rng.random() < share else w for w in text]


def groups(rows):
    out = {}
    for r in rows:
        out.setdefault(r.duplicate_of, {r.duplicate_of}).add(r.doc_id)
    return sorted(map(sorted, out.values()))


def test_golay_keys_meet_within_two_bits():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 23, 20000)
    b = a.copy()
    for _ in range(2):
        b ^= 1 << rng.integers(0, 23, len(a))
    ka, kb = golay.keys(a), golay.keys(b)
    shared = ((ka[:, :, None] == kb[:, None, :]) & (ka[:, :, None] >= 0)).any((1, 2))
    assert shared.all()
    count = (ka >= 0).sum(1)
    assert set(count) == {1, 6}
    assert all(len(set(r[r >= 0])) == c for r, c in zip(ka[:500], count))


def test_golay_code_is_perfect():
    every = golay.keys(np.arange(1 << 23))
    # Each codeword is a key of itself only, and spheres of radius 3 cover every word once.
    assert ((every >= 0).sum(1) == 1).sum() == 4096 * (1 + 23 + 253)


def test_fingerprint_does_not_depend_on_the_batch():
    rng = random.Random(2)
    texts = [" ".join(words(rng, rng.randrange(0, 400))) for _ in range(60)]
    whole = simhash.fingerprints(pa.array(texts))
    alone = [simhash.fingerprints(pa.array([t])) for t in texts]
    for k in range(4):
        assert np.array_equal(whole[k], np.concatenate([a[k] for a in alone]))


def brute_force(texts, segments=simhash.SEGMENTS):
    seg, pair, whole, count = simhash.fingerprints(pa.array(texts), segments)
    sketch = np.concatenate((seg.astype(np.uint32).view(np.uint8).reshape(len(seg), -1), pair.view(np.uint8).reshape(len(seg), -1)), 1).view(np.uint32)
    edges = set()
    for i in range(len(texts)):
        for j in range(i + 1, len(texts)):
            if count[i] and count[j] and ((whole[i] == whole[j]).all() or not simhash._far(sketch[i], sketch[j], segments, simhash.MAX_WORD, simhash.MAX_PAIR)):
                edges.add((i, j))
    return edges


def test_against_brute_force(spark):
    rng = random.Random(3)
    texts = [words(rng, rng.randrange(40, 500)) for _ in range(120)]
    for base in list(texts[:40]):
        for _ in range(rng.randrange(1, 4)):
            texts.append(edited(rng, base, rng.choice([0, 0.01, 0.03, 0.05])))
    texts = [" ".join(t) for t in texts]
    found = simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()
    root = {r.doc_id: r.duplicate_of for r in found}
    edges = brute_force(texts)
    met = sum(root.get(i, i) == root.get(j, j) for i, j in edges)
    assert met >= 0.95 * len(edges)
    # Nothing is grouped that brute force doesn't connect.
    parent = list(range(len(texts)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in edges:
        parent[max(top(i), top(j))] = min(top(i), top(j))
    assert all(top(a) == top(b) for a, b in root.items())
    assert all(b < a for a, b in root.items())


def test_big_run_is_linked_whole(spark):
    rng = random.Random(4)
    base = words(rng, 300)
    texts = [" ".join(edited(rng, base, 0.01)) for _ in range(200)] + [" ".join(words(rng, 300)) for _ in range(50)]
    found = simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()
    assert groups(found) == [list(range(200))]


@pytest.mark.parametrize("name, value", [("_SMALL", 2), ("_SMALL", 1 << 30), ("BUCKET", 20), ("SHAPES", ((1 << 62, 7, 3),))])
def test_same_groups_whatever_the_sizes(spark, monkeypatch, name, value):
    """Runs searched either way, buckets in blocks, and keys of three codewords."""
    rng = random.Random(8)
    base = [words(rng, 200) for _ in range(60)]
    texts = [" ".join(edited(rng, t, 0.01)) for t in base for _ in range(rng.choice([1, 2, 30]))]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    want = groups(simhash.near_duplicates(docs).collect())
    monkeypatch.setattr(simhash, name, value)
    assert len(want) > 20 and groups(simhash.near_duplicates(docs).collect()) == want


def distant(rng):
    """(texts, pairs that meet under two codewords of six segments, those that do so under three of seven)."""
    base = [words(rng, 120) for _ in range(150)]
    texts = [" ".join(t) for b in base for t in (b, edited(rng, b, 0.08))]
    seg, pair, _, _ = simhash.fingerprints(pa.array(texts), 7)
    codes = golay.keys(seg.ravel()).reshape(len(texts), 7, -1)
    meets = []
    for segments, agree in ((6, 2), (7, 3)):
        sketch = np.concatenate((seg[:, :segments].astype(np.uint32), pair.view(np.uint32)), 1)
        near = ~simhash._far(sketch[::2], sketch[1::2], segments, simhash.MAX_WORD, simhash.MAX_PAIR)
        shared = ((codes[::2, :segments, :, None] == codes[1::2, :segments, None, :]) & (codes[::2, :segments, :, None] >= 0)).any((2, 3)).sum(1)
        meets.append([[2 * k, 2 * k + 1] for k in np.flatnonzero(near & (shared >= agree)).tolist()])
    return texts, *meets


def test_same_groups_however_many_texts(spark, monkeypatch):
    """Counts as of a table of 2^40 texts change nothing: pairs that only the short keys bring together are still found."""
    texts, want, fewer = distant(random.Random(9))
    assert any(pair not in fewer for pair in want)
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    monkeypatch.setattr(type(docs), "count", lambda self: 1 << 40)
    assert groups(simhash.near_duplicates(docs).collect()) == want


def test_edge_cases(spark):
    text = "the same words stand here in this very order more than once"
    long = " ".join(words(random.Random(6), 60_000))
    rows = [
        (1, text), (2, text.upper() + "!"), (3, None), (None, text), (4, ""), (5, ""), (6, " ... "), (7, "single"), (8, "single"),
        (1, text), (9, long), (10, long + " tail"),
    ]
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA + ", id string, bucket int, sketch string")
    docs = docs.withColumns({n: F.col("doc_id") for n in ("`a.b`", "__gone", "gone_", "class", "root", "h1", "c0")}).withColumnRenamed("`a.b`", "a.b")
    assert groups(simhash.near_duplicates(docs).collect()) == [[1, 2], [7, 8], [9, 10]]
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 1, 3, 4, 5, 6, 7, 9]
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        simhash.near_duplicates(docs, segments=3, agree=4)


@pytest.mark.parametrize("local", [1 << 17, -1])
def test_components(spark, monkeypatch, local):
    from veldra.llm import components as module

    monkeypatch.setattr(module, "LOCAL", local)
    rng = random.Random(5)
    edges = [(k, k + 1) for k in range(0, 200)] + [(1000 + k, 1000) for k in range(1, 50)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(300)] + [(7, 7), (None, 3)]
    parent = {}

    def top(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = top(a), top(b)
            parent[max(a, b)] = min(a, b)
    found = {r.id: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), Scratch(spark)).collect()}
    assert found == {x: top(x) for x in parent if top(x) != x}
    assert components(spark.createDataFrame([], "a bigint, b bigint"), Scratch(spark)).count() == 0


def test_sweep_drops_what_was_written_since(spark):
    from pathlib import Path

    kept = Scratch(spark)
    kept.save(spark.range(3), "rows")
    since = len(Scratch.roots)
    gone = Scratch(spark)
    gone.save(spark.range(3), "rows")
    Scratch.sweep(since)
    exists = lambda s: Path(s.root.removeprefix("file://")).exists()
    assert exists(kept) and not exists(gone) and len(Scratch.roots) == since
