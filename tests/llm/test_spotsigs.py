import random

import numpy as np
import pyarrow as pa
import pytest

from veldra.llm import spotsigs

SCHEMA = "doc_id bigint, text string"


def prose(rng, n, vocabulary=3000):
    return [rng.choice("the a is was of and in".split()) if rng.random() < 0.45 else f"word{rng.randrange(vocabulary)}" for _ in range(n)]


def plain_spots(text, chain=spotsigs.CHAIN):
    anchors = {w for x in spotsigs.ANCHORS.values() for w in x.split()}
    common = anchors | {w for x in spotsigs.STOP.values() for w in x.split()}
    words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    out = set()
    for i, w in enumerate(words):
        if w in anchors:
            after = [x for x in words[i + 1 :] if x not in common][:chain]
            if len(after) == chain:
                out.add((w, *after))
    return out


def components(n, edges):
    root = list(range(n))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {k: top(k) for k in range(n) if top(k) != k}


def test_spots_match_plain_python():
    rng = random.Random(1)
    texts = [" ".join(prose(rng, rng.randrange(0, 200))) for _ in range(60)] + ["", "The. A, WORD1 word2!", "the the the x y", "Été de la maison bleue und der alte Mann"]
    flat, bounds = spotsigs.spots(pa.array(texts))
    assert np.diff(bounds).tolist() == [len(plain_spots(t)) for t in texts]
    again = [spotsigs.spots(pa.array([t]))[0] for t in texts]
    assert np.array_equal(flat, np.concatenate(again))


@pytest.mark.parametrize("threshold", [0.4, 0.6, 0.9])
def test_groups_by_brute_force(spark, threshold):
    rng = random.Random(2)
    shared = prose(rng, 60)
    base = [prose(rng, rng.choice([20, 60, 200, 900])) + (shared if rng.random() < 0.3 else []) for _ in range(70)]
    texts = [list(t) for t in base]
    for t in base[:45]:
        for _ in range(rng.randrange(1, 5)):
            share = rng.choice([0, 0.02, 0.05, 0.1])
            texts.append([f"word{rng.randrange(3000)}" if rng.random() < share else w for w in t])
    # A long chain of small changes, and a big group.
    t = prose(rng, 150)
    for k in range(15):
        texts.append(list(t))
        t = [f"new{k}x{i}" if rng.random() < 0.04 else w for i, w in enumerate(t)]
    big = prose(rng, 120)
    texts += [[f"word{rng.randrange(3000)}" if rng.random() < 0.03 else w for w in big] for _ in range(80)]
    rng.shuffle(texts)
    texts = [" ".join(t) for t in texts]
    sets = [plain_spots(t) for t in texts]
    edges = [
        (i, j)
        for i in range(len(sets))
        for j in range(i + 1, len(sets))
        if min(len(sets[i]), len(sets[j])) >= spotsigs.MIN_SPOTS and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9
    ]
    assert len(edges) > 100
    got = spotsigs.similar_documents(spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(6), threshold).collect()
    assert {r.doc_id: r.duplicate_of for r in got} == components(len(texts), edges)


def test_second_round_is_exact_alone(spark, monkeypatch):
    """Without the first round's help the lists alone must find everything."""
    rng = random.Random(3)
    base = [prose(rng, rng.choice([40, 300])) for _ in range(30)]
    texts = [" ".join(f"word{rng.randrange(3000)}" if rng.random() < 0.04 else w for w in t) for t in base for _ in range(3)]
    monkeypatch.setattr(spotsigs._Search, "matching", _no_first(spotsigs._Search.matching))
    sets = [plain_spots(t) for t in texts]
    edges = [(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if len(sets[i] & sets[j]) >= 0.6 * len(sets[i] | sets[j]) - 1e-9]
    got = spotsigs.similar_documents(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()
    assert {r.doc_id: r.duplicate_of for r in got} == components(len(texts), edges)


def _no_first(matching):
    def run(self, pairs, signed, name):
        return matching(self, pairs.where("false") if name == "first" else pairs, signed, name)

    return run


def test_edge_cases(spark):
    text = "the river was a slow road and the town is a quiet place that was the home of a poet"
    long = " ".join(prose(random.Random(4), 100_000))
    rows = [(1, text), (2, text.upper()), (3, None), (None, text), (4, ""), (5, ""), (6, "the end"), (7, "the end"), (1, text), (8, long), (9, long + " tail"), (2, "unrelated words")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", n int, spots string")
    got = {r.doc_id: r.duplicate_of for r in spotsigs.similar_documents(docs).collect()}
    assert got == {2: 1, 9: 8}
    assert spotsigs.similar_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        spotsigs.similar_documents(docs, 0)


def test_bitmaps_never_exclude_a_match():
    rng = np.random.default_rng(5)
    for _ in range(400):
        n = int(rng.integers(4, 200))
        pool = rng.integers(0, 1 << 48, 2 * n).astype(np.uint64)
        sets = [np.unique(rng.choice(pool[: n + int(rng.integers(0, n))], n)) for _ in range(2)]
        bitmap = np.zeros((2, spotsigs.BITMAP), bool)
        for k, s in enumerate(sets):
            bitmap[k, (spotsigs.mix(s) % np.uint64(spotsigs.BITMAP)).astype(int)] = True
        both = len(np.intersect1d(*sets))
        jaccard = both / (len(sets[0]) + len(sets[1]) - both)
        size = np.array([len(s) for s in sets])
        packed = np.packbits(bitmap, axis=1).view(np.int64)[:, 0]
        assert spotsigs._possible(size, packed, np.array([0]), np.array([1]), jaccard)[0]


def mixed_corpus(rng):
    texts = [t for base in (prose(rng, rng.choice([30, 200])) for _ in range(25)) for t in [base] * rng.randrange(1, 4)]
    t = prose(rng, 150)
    for k in range(30):
        texts.append(list(t))
        t = [f"new{k}x{i}" if rng.random() < 0.05 else w for i, w in enumerate(t)]
    big = prose(rng, 120)
    texts += [[f"word{rng.randrange(3000)}" if rng.random() < 0.05 else w for w in big] for _ in range(40)]
    passage = prose(rng, 100)
    texts += [prose(rng, rng.choice([30, 60, 90])) + passage for _ in range(60)]
    rng.shuffle(texts)
    return [" ".join(t) for t in texts]


@pytest.mark.parametrize("block, limit", [(2000, 4000), (7, 6)])
def test_classes_and_pairs_by_brute_force(spark, monkeypatch, block, limit):
    """Every link between different texts, in small groups, chains, groups and lists that are split, and with a shared passage."""
    monkeypatch.setattr(spotsigs, "BLOCK", block)
    monkeypatch.setattr(spotsigs, "LIST", limit)
    monkeypatch.setattr(spotsigs, "GATHER", 25)
    texts = mixed_corpus(random.Random(6))
    sets = [plain_spots(t) for t in texts]
    few = [len(s) < spotsigs.MIN_SPOTS for s in sets]
    key = [tuple(t.lower().split()) if f else frozenset(s) for t, s, f in zip(texts, sets, few)]
    own = {}
    for i, k in enumerate(key):
        own.setdefault(k, i)
    reps = [i for i in own.values() if not few[i]]
    want = {}
    for x, i in enumerate(reps):
        for j in reps[x + 1 :]:
            shared, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if shared >= 0.6 * either - 1e-9:
                want[i, j] = round(shared / either, 6)
    roots = components(len(texts), want)
    chained = {(i, j) for i in reps for j in reps if i < j and roots.get(i, i) == roots.get(j, j)}
    assert len(chained) > len(want) > 100  # some documents of a group don't match one another
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(6)
    got = spotsigs.similar_pairs(docs).collect()
    assert len(got) == len(want) and {(r.class_a, r.class_b): r.jaccard for r in got} == want
    links = {i: [j for p, j in want.items() if i in p] for i in reps}
    expected = {}
    for i, k in enumerate(key):
        rep, copies = own[k], key.count(k)
        near = links.get(rep, [])
        if copies > 1 or near:
            expected[i] = (rep, copies, len(near), max(near) if near else None, roots.get(rep, rep))
    rows = spotsigs.similar_classes(docs).collect()
    assert len(rows) == len(expected) and {r.doc_id: tuple(r)[1:] for r in rows} == expected


def test_query(spark, tmp_path):
    text = "the river was a slow road and the town is a quiet place that was the home of a poet"
    rows = [(1, text), (2, text), (3, text + " the end of story"), (1, "other words"), (4, "unlike all others"), (2, text)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.class_id): (r.copies, r.links, r.duplicate_of) for r in spotsigs.op7_spotsigs(spark, str(tmp_path)).collect()}
    by = {d: {k: v for k, v in got.items() if k[0] == d} for d in (1, 2, 3, 4)}
    assert len(by[1]) == 2 and all(k[1] < 0 for k in by[1])  # two texts under one doc_id
    assert sorted(by[1].values()) == [(1, 0, 1), (2, 1, 1)]
    assert list(by[2].values()) == [(2, 1, 1)] and list(by[3].values()) == [(1, 1, 1)] and not by[4]


def test_length_partitions_miss_no_pair():
    for threshold in (0.3, 0.6, 0.8, 1.0):
        n, m = (x.ravel() for x in np.meshgrid(np.arange(1, 400), np.arange(1, 400)))
        ok = (n <= m) & (n >= np.ceil(threshold * m - 1e-9))
        n, m = n[ok], m[ok]
        (p, guest), (q, _) = spotsigs.length_part(n, threshold), spotsigs.length_part(m, threshold)
        assert ((p == q) | (q == p + 1) & guest).all()


def test_copies_with_few_spots(spark):
    """Short and anchorless texts match their exact copies, by their words in order, and nothing else."""
    rng = random.Random(7)
    menu = " ".join(f"item{rng.randrange(500)}" for _ in range(300))
    texts = ["the end", "The END!", "end the", "the end end", menu, menu.upper(), menu + " item1", " ".join(reversed(menu.split())), "", "", "...", "...", "the big red house", "the big red house", "the big red barn", "one", "one"]
    texts += ["the big red " + menu, menu + " the big red"]  # one spot, the same one
    assert all(len(plain_spots(t)) < spotsigs.MIN_SPOTS for t in texts)
    got = spotsigs.similar_classes(spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(3)).collect()
    assert sorted((r.class_id, r.doc_id, r.copies, r.links) for r in got) == [(a, b, 2, 0) for a in (0, 4, 12, 15) for b in (a, a + 1)]


def test_every_exact_copy_is_paired(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(100)
    again = docs.union(docs.selectExpr("doc_id + 1000000000", "text"))
    words = {r.doc_id for r in docs.collect() if any(c.isalnum() for c in r.text or "")}
    own = {r.doc_id: r.class_id for r in spotsigs.similar_classes(again).collect()}
    assert all(own[a] == own[a + 1000000000] for a in words)
