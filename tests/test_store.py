"""The store on disk: versions, two writers, crashes between steps, changes against plain Python, and the text index."""

import json
import random

import pytest
from pyspark.sql import functions as F

from veldra.errors import WriteError
from veldra.sources import store as module
from veldra.sources.collection import Collection
from veldra.sources.store import Batch, DocStore, Version


def put(store, docs=(), gone=()):
    batch = Batch()
    for d in docs:
        store.add(d, batch)
    if gone:
        store.delete_all(list(gone), batch)
    store.commit(batch)


def held(store):
    return {r._id: (r.seq, json.loads(r.text)) for r in store.table().collect()}


def test_changes_against_plain_python(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(module, "COMPACT", 3)
    store = DocStore(spark, f"{tmp_path}/s", create=True)
    rng, want, seqs = random.Random(1), {}, {}
    for step in range(9):
        docs = [{"_id": str(rng.randrange(12)), "v": step, "k": rng.random()} for _ in range(4)]
        docs = list({d["_id"]: d for d in docs}.values())
        gone = [k for k in want if rng.random() < 0.2 and k not in {d["_id"] for d in docs}]
        put(store, docs, gone)
        for k in gone:
            del want[k], seqs[k]
        want |= {d["_id"]: d for d in docs}
        now = held(store)
        assert {k: d for k, (_, d) in now.items()} == want
        assert all(now[k][0] == s for k, s in seqs.items())  # a replaced document keeps its number
        seqs = {k: s for k, (s, _) in now.items()}
        assert len(set(seqs.values())) == len(seqs)
        assert len(store.version().deltas) <= 3
    before = held(store)
    store.compact()
    store.vacuum()
    assert held(store) == before and not store.version().deltas
    assert held(DocStore(spark, f"{tmp_path}/s")) == before


def test_second_of_two_writers_is_told(spark, tmp_path):
    store = DocStore(spark, f"{tmp_path}/s", create=True)
    put(store, [{"_id": "a", "v": 1}])
    late = store.version()
    put(store, [{"_id": "b", "v": 2}])
    # A writer that began with the former version.
    late.number += 1
    with pytest.raises(WriteError, match="another writer"):
        store._publish(late)
    assert set(held(store)) == {"a", "b"}


@pytest.mark.parametrize("step", ["_publish", "link"])
def test_crash_between_steps_changes_nothing(spark, tmp_path, monkeypatch, step):
    store = DocStore(spark, f"{tmp_path}/s", create=True)
    put(store, [{"_id": "a", "v": 1}])
    before = held(store)

    def crash(*_):
        raise RuntimeError("crash")

    with monkeypatch.context() as m:
        m.setattr(DocStore, "_publish", crash) if step == "_publish" else m.setattr(module.os, "link", crash)
        with pytest.raises(RuntimeError):
            store.apply(spark.createDataFrame([("b", '{"_id":"b"}'), ("a", '{"_id":"a","v":5}')], "_id string, text string"), spark.createDataFrame([], "_id string"))
    assert held(DocStore(spark, f"{tmp_path}/s")) == before
    put(store, [{"_id": "c", "v": 3}])
    store.vacuum()
    assert set(held(store)) == {"a", "c"}


def test_readers_keep_their_version(spark, tmp_path):
    store = DocStore(spark, f"{tmp_path}/s", create=True)
    put(store, [{"_id": "a", "v": 1}])
    old = store.collection().df
    put(store, [{"_id": "a", "v": 2}, {"_id": "b", "v": 2}])
    store.compact()
    assert old.count() == 1 and store.collection().df.count() == 2


def test_other_formats_are_refused(spark, tmp_path):
    store = DocStore(spark, f"{tmp_path}/s", create=True)
    store._publish(Version(number=store.version().number + 1, format=99))
    with pytest.raises(WriteError, match="format 99"):
        DocStore(spark, f"{tmp_path}/s")
    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "current").write_text("version-x 3\n")
    with pytest.raises(WriteError, match="format 1"):
        DocStore(spark, f"{tmp_path}/old")
    with pytest.raises(WriteError, match="no store"):
        DocStore(spark, f"{tmp_path}/none")


def test_memory_store_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(module, "MEMORY", 3)
    store = DocStore(spark)
    with pytest.raises(WriteError, match="at most 3"):
        put(store, [{"v": k} for k in range(4)])


QUERIES = [
    'find {t: ~= "fox"} return ._id', 'find {t: ~= "red fox"} return ._id', 'find {t: ~1= "fox run"} return ._id', 'find {t: ~2= "run the fox"} return ._id', 'find {u: ~= "dog", t: !~= "fox"} return ._id', 'find {_id: == "3" || t: ~= "red fox"} return ._id',
    'find {t: ~= "fox" || u: ~= "dog"} return ._id', 'find {t: ~= "nothing"} return ._id', 'find {a: [~= "fox"]} return ._id', 'find {t: ~= "run", a: [~= "dog"]} return ._id', 'find {o: {t: ~= "fox"}} return ._id',
    'find {t: ~= "fox" || t: ~= "dog"} order score() desc return [._id, score()]', 'find {t: ~= "red"^2, u: ~= "fox"} return [._id, score()]', 'find {t: ~= "red fox" || o: {t: ~= "dog"}} return [._id, score()]', 'find {a: [~= "fox"] || t: ~= "dog"} return [._id, score()]',
]


def test_index_changes_no_result(spark, tmp_path):
    """Every query with the index, and with changes made after it, as without."""
    rng = random.Random(2)
    words = "fox foxes dog dogs red Red runs running the and a".split()

    def text():
        return " ".join(rng.choice(words) for _ in range(rng.randrange(0, 9)))

    def document(k):
        return {"_id": str(k), "t": text() if rng.random() < 0.9 else 5, "u": text(), "a": [text() for _ in range(rng.randrange(3))], "o": {"t": text()}, "weird \"$.key": text()}

    store, plain = DocStore(spark, f"{tmp_path}/s", create=True), DocStore(spark, f"{tmp_path}/p", create=True)

    def same():
        for query in QUERIES:
            got, want = ([str(r[0].toPython() if hasattr(r[0], "toPython") else [x.toPython() for x in r]) for r in s.query(query).collect()] for s in (store, plain))
            assert got == want, query

    docs = [document(k) for k in range(60)]
    put(store, docs)
    put(plain, docs)
    store.index_text()
    assert store.collection().index is not None and plain.collection().index is None
    same()
    docs, gone = [document(k) for k in (3, 4, 5, 70, 71)], ["10", "11"]
    put(store, docs, gone)
    put(plain, docs, gone)
    same()
    store.compact()
    store.vacuum()
    assert store.version().index and store.collection().index.changed is None
    query = 'find {"weird \\"$.key": ~= "fox"} return ._id'
    assert [r[0].toPython() for r in store.query(query).collect()] == [r[0].toPython() for r in plain.query(query).collect()]


def test_index_is_what_a_word_query_reads(spark, tmp_path):
    store = DocStore(spark, f"{tmp_path}/s", create=True)
    put(store, [{"_id": str(k), "t": f"word{k} text"} for k in range(50)])
    store.index_text()
    plan = store.query('find {t: ~= "word7"}')._jdf.queryExecution().toString()
    assert "EqualTo(stem,word7)" in plan and "ArrowEvalPython" not in plan
    assert [r[0].toPython() for r in store.query('find {t: ~= "word7"}').collect()] == ["7"]


def test_json_lines_have_the_same_numbers_however_they_are_split(spark, tmp_path):
    for name, rows in (("b", range(100)), ("a", range(1000, 1400))):
        (tmp_path / f"{name}.json").write_text("".join(f'{{"v":{k}}}\n' + "\n" * (k % 7 == 0) for k in rows))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    found = []
    try:
        for split in ("128m", "1000b", "300b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            docs = Collection.read_json_lines(spark, str(tmp_path)).df
            found.append(sorted((r.seq, r.v) for r in docs.select("seq", F.expr("variant_get(doc, '$.v', 'bigint')").alias("v")).collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert found[0] == found[1] == found[2]
    assert [v for _, v in found[0]] == [*range(1000, 1400), *range(100)]
