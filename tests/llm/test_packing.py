import random

import numpy as np
import pyarrow as pa
import pytest

from veldra.llm import packing

SCHEMA = "doc_id bigint, text string"


def test_hilbert_visits_every_cell_by_single_steps():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        order = packing.hilbert(cells, bits)
        assert sorted(order) == list(range(len(cells)))
        path = cells[np.argsort(order)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def brute_force(rows, capacity):
    """Documents laid end to end, one token at a time."""
    texts = [t for _, t in rows]
    keys, counts = packing.curve_keys(pa.array(texts, pa.string())), [len((t or "").split()) for t in texts]
    order = sorted((k, -1 if d is None else d, n) for (d, _), k, n in zip(rows, keys.tolist(), counts) if n)
    out, at = [], 0
    for key, doc, n in order:
        first = 0
        while first < n:
            take = min(n - first, capacity - at % capacity)
            out.append((at // capacity, doc, first, take, key))
            first, at = first + take, at + take
    return sorted(out)


@pytest.mark.parametrize("capacity", [1, 7, 64, 5000])
def test_against_brute_force(spark, capacity):
    rng = random.Random(capacity)
    rows = [(k, " ".join(rng.choice("abcdefghij") * rng.randrange(1, 4) for _ in range(rng.randrange(0, 90)))) for k in range(150)]
    rows += [(3, rows[3][1]), (3, rows[3][1]), (None, "one two"), (500, None), (501, " \n\t "), (502, "end\tof\nlines\r\n x")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", key int, tokens int").repartition(5)
    got = packing.pack(docs, capacity).collect()
    assert sorted((r.sequence, -1 if r.doc_id is None else r.doc_id, r.first_token, r.n_tokens, r.key) for r in got) == brute_force(rows, capacity)
    for seq in {r.sequence for r in got}:
        assert sorted(r.position for r in got if r.sequence == seq) == list(range(sum(r.sequence == seq for r in got)))
    full = {}
    for r in got:
        full[r.sequence] = full.get(r.sequence, 0) + r.n_tokens
    assert all(n == capacity for s, n in full.items() if s < max(full))


def test_empty_and_long(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0
    got = packing.pack(spark.createDataFrame([(1, "w " * 50_000)], SCHEMA), 1000).collect()
    assert len(got) == 50 and all(r.n_tokens == 1000 for r in got)
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([], SCHEMA), 0)


def test_neighbours_are_alike():
    rng = random.Random(1)
    topics = [[f"{t}word{k}" for k in range(60)] for t in "abcdef"]
    texts, topic = [], []
    for _ in range(300):
        t = rng.randrange(6)
        texts.append(" ".join(rng.sample(topics[t], 40)))
        topic.append(t)
    order = np.argsort(packing.curve_keys(pa.array(texts)))
    along = np.array(topic)[order]
    assert (along[1:] == along[:-1]).mean() > 1.5 * np.mean(np.array(topic)[:, None] == np.array(topic))
