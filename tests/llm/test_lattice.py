import numpy as np
import pytest

from veldra.llm import lattice

SCHEMA = "vec_id bigint, embedding array<float>"


def near(rng, base, cosine):
    noisy = rng.normal(size=base.shape)
    noisy -= (noisy * base).sum(-1, keepdims=True) * base
    noisy /= np.linalg.norm(noisy, axis=-1, keepdims=True)
    return cosine * base + np.sqrt(1 - cosine**2) * noisy


def unit(rng, n, dim=64):
    x = rng.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_decoder_finds_the_nearest_point():
    rng = np.random.default_rng(1)
    y = rng.normal(0, 2, (5000, 8))
    p = lattice.nearest(y)
    twice = 2 * p
    assert (twice == np.round(twice)).all() and ((np.abs(twice) % 2).min(1) == (np.abs(twice) % 2).max(1)).all()
    assert (p.sum(1) % 2 == 0).all()
    own = ((y - p) ** 2).sum(1)
    assert own.max() <= 1 + 1e-9  # the covering radius of E8 is 1
    # A point that no shortest vector improves is the nearest: those vectors cut out the Voronoi cell.
    assert (((y[:, None] - p[:, None] - lattice.ROOTS) ** 2).sum(2).min(1) >= own - 1e-9).all()
    assert len(lattice.ROOTS) == 240 and np.allclose((lattice.ROOTS**2).sum(1), 2)


@pytest.mark.parametrize("plan", [p for _, p in lattice.PLANS])
def test_recall_at_the_threshold(plan):
    rng = np.random.default_rng(2)
    a = unit(rng, 3000)
    for cosine, least in ((0.95, 0.95), (0.97, 0.99)):
        b = near(rng, a, cosine)
        x, y = lattice.cells(a, plan), lattice.cells(b, plan)
        met = ((x[:, :, :1] == y) | (y[:, :, :1] == x)).any((1, 2))
        assert met.mean() > least


def test_signs_keep_near_pairs():
    rng = np.random.default_rng(7)
    a = unit(rng, 40_000)
    differ = np.bitwise_count((lattice.signs(a) ^ lattice.signs(near(rng, a, 0.95))).view(np.uint64))
    assert (differ <= lattice.most_signs(0.95)).mean() > 0.9999
    assert lattice.most_signs(1.0) == 0 and lattice.most_signs(-1.0) == lattice.SIGNS


def exact(x):
    """(class of each row, pairs of classes with their cosine), by brute force over float32 rows."""
    own = {}
    first = [own.setdefault(v.tobytes(), i) for i, v in enumerate(x)]
    y = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    full = y @ y.T
    reps = sorted(set(first))
    return first, {(i, j): full[i, j] for k, i in enumerate(reps) for j in reps[k + 1 :] if full[i, j] >= lattice.THRESHOLD}


@pytest.mark.parametrize("block, limit", [(2000, 4000), (7, 6)])
def test_against_brute_force(spark, monkeypatch, tmp_path, block, limit):
    """Pairs, and links of each vector, with equal vectors, a dense group, and groups and cells that are split."""
    monkeypatch.setattr(lattice, "BLOCK", block)
    monkeypatch.setattr(lattice, "LIST", limit)
    rng = np.random.default_rng(3)
    base = unit(rng, 300)
    dense = near(rng, np.repeat(base[-1:], 40, 0), 0.985)
    x = np.concatenate([base, near(rng, base[:120], 0.97), near(rng, base[:80], 0.99), near(rng, base[:60], 0.955), dense, base[:30], base[:30], base[100:110]]).astype(np.float32)
    x = x[rng.permutation(len(x))]
    rows = [(int(k), v.tolist()) for k, v in enumerate(x)] + [(5000, [0.0] * 64), (5001, [0.0] * 64)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    first, want = exact(x)
    pairs = {(r.class_a, r.class_b): r.cosine for r in lattice.near_vectors(spark.read.parquet(f"{tmp_path}/embeddings.parquet")).collect()}
    assert set(pairs) <= set(want) and len(pairs) >= 0.95 * len(want) > 500
    assert all(abs(c - want[p]) < 1e-5 for p, c in pairs.items())
    got = lattice.op8_lattice_dedup(spark, str(tmp_path)).collect()
    links, nearest_ = {}, {}
    for (i, j), c in pairs.items():
        for k in (i, j):
            links[k] = links.get(k, 0) + 1
            nearest_[k] = max(nearest_.get(k, 0), c)
    expected = {i: (c, first.count(c), links.get(c, 0), nearest_.get(c)) for i, c in enumerate(first) if first.count(c) > 1 or c in links}
    assert len(got) == len(expected) and {r.vec_id: tuple(r)[1:5] for r in got} == expected
    groups = {r.class_id: r.duplicate_of for r in got}
    assert all(groups[i] == groups[j] for i, j in pairs) and all(v <= k for k, v in groups.items())


def test_edge_cases(spark):
    rng = np.random.default_rng(4)
    v = unit(rng, 1)[0].tolist()
    rows = [(1, v), (2, v), (3, v), (1, v), (None, v), (4, None), (5, []), (6, [0.0] * 64), (7, [1.0, 2.0]), (8, [float("nan")] * 64), (9, [None] * 64), (10, [2 * a for a in v]), (11, [float("nan")] * 64), (12, [float("inf")] * 64), (13, [*v[:63], None])]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", cell int, id int")
    got = sorted(tuple(r) for r in lattice.near_classes(docs).collect())
    assert got == [(1, 1, 3, 1, 1.0, 1), (2, 1, 3, 1, 1.0, 1), (3, 1, 3, 1, 1.0, 1), (10, 10, 1, 1, 1.0, 1)]
    assert lattice.near_classes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shared_ids_and_several_lengths(spark):
    """A vec_id is in the group of each of its vectors, and vectors of every length are searched."""
    rng = np.random.default_rng(6)
    a, b, c = unit(rng, 3).tolist()
    short = unit(rng, 2, 48).tolist()
    rows = [(1, a), (1, b), (1, c), (2, a), (3, b), (4, near(rng, np.array([c]), 0.995)[0].tolist()), (5, short[0]), (6, short[0]), (7, short[1]), (8, [*short[0], None]), (9, unit(rng, 1)[0].tolist())]
    got = lattice.near_classes(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted((r.vec_id, r.duplicate_of) for r in got) == [(1, 1), (1, 1), (1, 1), (2, 1), (3, 1), (4, 1), (5, 5), (6, 5)]
    assert sorted(r.links for r in got if r.vec_id in (1, 4)) == [0, 0, 1, 1]
