import base64
import heapq
import random

import numpy as np
import pyarrow as pa
import pytest

from veldra.llm import huffman

SCHEMA = "doc_id bigint, text string"


@pytest.fixture(scope="module")
def encoder():
    return huffman.Encoder(huffman.read_vocabulary(huffman.VOCABULARY))


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in huffman.read_vocabulary(huffman.VOCABULARY).splitlines())}
    return tiktoken.Encoding("reference", pat_str=huffman.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_are_the_tokenizer_s_own(encoder, reference):
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "\t", "a", "bc", "é", "日本", ".", "!?", "'s", "'ll", "12", "😀", "　", " ", "\x85", "\r\n", "\x1c", "the", "The", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 40))) for _ in range(3000)]
    ids, bounds = encoder.encode(pa.array([*texts, None, ""]))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [reference.encode_ordinary(t) for t in texts] + [[], []]


def huffman_cost(counts):
    heap = [c for c in counts if c]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        cost += a
        heapq.heappush(heap, a)
    return cost


def test_code_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(2)
    for n in (2, 3, 10, 257, 3000):
        counts = (rng.pareto(0.7, n) * 10).astype(np.int64)
        counts[:2] = 1
        free = huffman.code_lengths(counts, 40)
        assert int((free.astype(np.int64) * counts).sum()) == huffman_cost(counts.tolist())
        limit = max(1, int(np.ceil(np.log2((counts > 0).sum())))) + 1
        tight = huffman.code_lengths(counts, limit).astype(np.int64)
        assert tight.max() <= limit and np.isclose((0.5 ** tight[tight > 0]).sum(), 1)
        assert ((tight > 0) == (counts > 0)).all()
    fibonacci = [1, 1]
    while len(fibonacci) < 30:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    assert huffman.code_lengths(np.array(fibonacci), 8).max() == 8
    assert huffman.code_lengths(np.array([0, 5, 0])).tolist() == [0, 1, 0]
    assert huffman.code_lengths(np.zeros(4, np.int64)).tolist() == [0] * 4
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(9, np.int64), 3)


def test_codes_are_canonical_and_prefix_free():
    lengths = huffman.code_lengths(np.array([50, 1, 7, 0, 7, 20, 3]))
    codes = huffman.canonical(lengths)
    texts = {k: format(int(c), f"0{n}b") for k, (c, n) in enumerate(zip(codes, lengths)) if n}
    assert not any(a != b and y.startswith(x) for a, x in texts.items() for b, y in texts.items())
    order = sorted(texts, key=lambda k: (lengths[k], k))
    assert [texts[k] for k in order] == sorted(texts.values())


@pytest.mark.parametrize("interval", [1, 5, 1024])
def test_bits_round_trip(interval):
    rng = np.random.default_rng(3)
    counts = (rng.pareto(0.6, 4000) * 10).astype(np.int64)
    lengths = huffman.code_lengths(counts)
    used = np.flatnonzero(counts)
    sizes = np.array([0, 1, 7, 0, 3000, 64, 1])
    ids = rng.choice(used, sizes.sum())
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    data, byte, points, each = huffman.encode_bits(ids, bounds, lengths, huffman.canonical(lengths), interval)
    decoder = huffman.decoding_table(lengths)
    for k, n in enumerate(sizes):
        marks = points[each[k] : each[k + 1]]
        assert len(marks) == -(-n // interval)
        got = huffman.decode(data[byte[k] : byte[k + 1]].tobytes(), int(n), marks, decoder, interval)
        assert got.tolist() == ids[bounds[k] : bounds[k + 1]].tolist()


def test_corpus_round_trip(spark, sf, reference):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = huffman.encode_corpus(docs).collect()
    (book,) = [r for r in rows if r.kind == "codebook"]
    lengths = np.frombuffer(bytes(book.payload), np.uint8)
    decoder = huffman.decoding_table(lengths)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(texts) + 1
    bits = 0
    for r in rows:
        if r.kind == "document":
            ids = huffman.decode(bytes(r.payload), r.n_ids, np.array(r.checkpoints), decoder)
            assert ids.tolist() == reference.encode_ordinary(texts[r.doc_id])
            bits += 8 * len(r.payload)
    assert bits < 16 * sum(r.n_ids for r in rows if r.kind == "document")


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (None, "a text"), (3, "same"), (3, "same"), (4, "word " * 100_000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", n_ids int")
    got = huffman.encode_corpus(docs).where("kind = 'document'").collect()
    assert len(got) == len(rows)
    assert all(r.n_ids == 0 and not r.payload and not r.checkpoints for r in got if r.doc_id in (1, 2))
    assert len({bytes(r.payload) for r in got if r.doc_id == 3}) == 1
    empty = huffman.encode_corpus(spark.createDataFrame([], SCHEMA)).collect()
    assert [r.kind for r in empty] == ["codebook"] and not any(empty[0].payload)
    one = huffman.encode_corpus(spark.createDataFrame([(1, "aaa"[:1])], SCHEMA)).where("kind = 'document'").first()
    assert one.n_ids == 1 and len(one.payload) == 1


def test_decoded_table(spark, sf, reference):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(None, "no id"), (-1, None), (-2, ""), (-3, "twice"), (-3, "twice")], SCHEMA))
    coded = huffman.encode_corpus(docs)
    got = sorted(((r.doc_id or 0, list(r.ids)) for r in huffman.decode_corpus(coded).collect()))
    assert got == sorted((r.doc_id or 0, reference.encode_ordinary(r.text or "")) for r in docs.collect())
    with pytest.raises(ValueError):
        huffman.decode_corpus(coded.where("kind = 'document'"))
