import random

import numpy as np
import pyarrow as pa

from veldra.llm.arrays import distinct, row_sums, slices, words


def plain(text):
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def test_words_match_plain_python():
    rng = random.Random(1)
    alphabet = ["a", "b", "Z", "9", " ", " ", "\n", ".", "é", "ß", "中", "-", " ", "—", " ", "'"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 60))) for _ in range(500)] + ["", "abc", "cba", "x" * 1000]
    w = words(pa.array([*texts, None]))
    assert np.diff(w.first).tolist() == [len(plain(t)) for t in texts] + [0]
    by_hash, by_word = {}, {}
    for word, h in zip((x for t in texts for x in plain(t)), w.hash.tolist()):
        assert by_hash.setdefault(h, word) == word
        assert by_word.setdefault(word, h) == h


def test_anagrams_differ_and_slices_don_t_matter():
    texts = pa.array(["stop", "pots", "opts", "stop"])
    h = words(texts).hash
    assert len(set(h.tolist())) == 3 and h[0] == h[3]
    assert words(texts.slice(2, 2)).hash.tolist() == h[2:].tolist()
    assert words(texts.cast(pa.large_string())).hash.tolist() == h.tolist()


def test_slices_cover_all_rows():
    texts = pa.array(["x" * n for n in (5, 0, 700, 3, 3, 3, 900, 1)] + [None])
    for target in (1, 10, 100, 10_000):
        got = list(slices(texts, target))
        assert [k for a, b in got for k in range(a, b)] == list(range(len(texts)))
    assert list(slices(texts, 10_000, 2)) == [(0, 2), (2, 4), (4, 6), (6, 8), (8, 9)]
    assert list(slices(pa.array([], pa.string()))) == []


def test_distinct_and_sums():
    doc, code = np.array([0, 0, 2, 2, 2]), np.array([7, 7, 9, 8, 9], np.uint64) << np.uint64(20)
    d, c, first = distinct(doc, code, 4)
    assert d.tolist() == [0, 2, 2] and (c >> np.uint64(20)).tolist() == [7, 8, 9] and first.tolist() == [0, 1, 1, 3, 3]
    assert row_sums(np.array([1, 2, 3]), np.array([0, 2, 2, 3])).tolist() == [3, 0, 3]
