"""Compiled expressions against the plain evaluator, plans, errors, and the driver's contract."""

import json
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from veldra.errors import ParseError
from veldra.functions.collation import collation_key, flatten, key, render
from veldra.functions.text import element_places_udf, finder, heads, may_have, places_udf, stem, stems, words
from veldra.operators.evaluate import Evaluator
from veldra.plans.engine import run
from veldra.plans.parser import parse
from veldra.sources.collection import Collection
from veldra.sources.store import DocStore
from veldra.streaming.upserts import apply_changes


def value(rng, depth=0):
    kind = rng.randrange(8 if depth < 2 else 5)
    if kind == 0:
        return rng.choice([None, True, False])
    if kind in (1, 2):
        return rng.choice([-1, 0, 1, 2, 2.5])
    if kind in (3, 4):
        return rng.choice(["x", "y", "red fox", "the foxes run", ""])
    if kind == 5:
        return {k: value(rng, depth + 1) for k in rng.sample("abc", rng.randrange(0, 3))}
    return [value(rng, depth + 1) for _ in range(rng.randrange(0, 4))]


def leaf(rng):
    return rng.choice(['~= "fox"', '~= "the fox"', '~1= "run fox"', '~1= "run the fox"', '!~= "red"', '== "x"', "== 1", "== true", "== null", "> 0", "<= 2", '!= "y"', "!= 2", '== ""'])


def clause(rng, depth=0, negated=False):
    """The text after a key."""
    kind = rng.randrange(5 if depth < 2 else 2)
    if kind < 2:
        text = leaf(rng)
        return text.replace("!~=", "~=").replace("!=", "==") if negated else text
    if kind == 2:
        return "{" + fields(rng, depth + 1, negated) + "}"
    body = rng.choice([lambda: clause(rng, depth + 1, negated), lambda: clause(rng, depth + 1, negated) + " || " + clause(rng, depth + 1, negated), lambda: "{" + fields(rng, depth + 1, negated) + "}"])()
    return ("![" if not negated and rng.random() < 0.3 and "!" not in body else "[") + body + "]"


def fields(rng, depth=0, negated=False):
    parts = [f"{rng.choice('abc')}: {clause(rng, depth, negated)}" for _ in range(rng.randrange(1, 3))]
    return rng.choice([", ", " || "]).join(parts)


def test_compiled_against_evaluator(spark):
    rng = random.Random(5)
    docs = [{"_id": str(k), **{f: value(rng) for f in rng.sample("abc", rng.randrange(1, 4))}} for k in range(150)]
    store = DocStore(spark)
    store.apply(spark.createDataFrame([(d["_id"], json.dumps(d)) for d in docs], "_id string, text string").coalesce(1), spark.createDataFrame([], "_id string"))
    collection = store.collection()
    tried = 0
    while tried < 45:
        text = f"find {{_id: > 0 || {fields(rng)}}}"
        try:
            query = parse(text)
        except ParseError:
            continue
        want = sorted(d["_id"] for d in docs if Evaluator(query.find)(d).matched)
        got = sorted(r[0].toPython() for r in run(collection, query).collect())
        assert got == want, text
        tried += 1


def test_pushdown_and_pruning(spark, sf):
    orders = Collection.typed(spark.read.parquet(f"{sf}/orders.parquet"), "o_orderkey")
    for where, pushed in (('o_orderstatus: == "F"', "EqualTo(o_orderstatus,F)"), ("o_totalprice: > 1000", "GreaterThan(o_totalprice,1000.0)"), ("o_custkey: <= 50", "LessThanOrEqual(o_custkey,50)")):
        plan = run(orders, f"find {{{where}}} return {{id: .o_orderkey}}")._jdf.queryExecution().toString()
        scan = plan[plan.rindex("PushedFilters") :]
        assert pushed in scan
        assert "o_orderdate" not in scan and "o_orderpriority" not in scan
    top = run(orders, "find {o_totalprice: > 0} order .o_totalprice desc return .o_orderkey limit 5")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in top and "Python" not in top
    parts = Collection.typed(spark.read.parquet(f"{sf}/part.parquet"), "p_partkey")
    text = run(parts, 'find {p_size: > 3, p_name: ~= "red"}')._jdf.queryExecution().executedPlan().toString()
    # Plans print upside down: the cheap tests are below the stemmer, nearer to the scan.
    assert text.index("ArrowEvalPython") < text.lower().rindex("contains(lower(p_name")


@pytest.mark.parametrize(
    "text, message",
    [
        ("fnd {}", "Missing 'find' keyword"),
        ("find {a: 5}", "Expected comparison operator"),
        ("find {a: == }", "Expected JSON primitive."),
        ("find {a: == 1", "Expected '}' at character 13 but query string ended."),
        ("find {a: == 1} limit 0", "limit must be an integer greater than 0"),
        ("find {a: == 1} limit x", "limit expects an integer greater than 0"),
        ("find {a: == 1} bogus", "At character 15 unexpected bogus."),
        ("find {5: == 1}", "Expected object key or '('"),
        ("find {a: ~x= \"b\"}", "Expected integer for proximity search"),
        ("find {a: ~9999999999= \"b c\"}", "Proximity search number too large."),
        ("find {a: !~3= \"b c\"}", "Expected comparison operator"),
        ("find {a: == \"\\q\"}", "Unknown character escape: q"),
        ("find {a: == \"\\u12g4\"}", "Invalid hexidecimal escape: g"),
        ("find {a: == -}", "Expected digits after sign (-)."),
        ("find {a: == 1.}", "Expected digits after decimal point."),
        ("find {a: == 1.5e}", "Expected exponent after e."),
        ("find {a: == 1}^x", "Expected number after ^ symbol."),
        ("find {a: > 1^2}", "Expected '}' at character 12, found ^."),
        ("find {a: ~= 1}", "Expected string literal."),
        ("find {a: == 1} return", "Expected key, object or array to return."),
        ("find {a: == 1} return {a: }", "Expected key to return."),
        ("find {a: == 1} return .a[x]", "Expected array index integer or *."),
        ("find {a: == 1} return .a.1", "Expected object key."),
        ("find {a: == 1} return .a default=", "Expected json value for default"),
        ("find {a: == 1} return .a default=[1,]", "Invalid json found"),
        ("find {a: == 1} return group(.a order=up)", "Expected asc or desc"),
        ("find {a: == 1} return sum(5)", "Expected keypath or bind variable"),
        ("find {a: == 1} return [sum(.a), .b]", "Return keypaths must either all have aggregate functions, or none can them."),
        ("find {a: == 1} order .a return sum(.a)", "Cannot have aggregates and ordering in the same query"),
        ("find !{a: == 1}", "query cannot be made up of only logical not. Must have at least one match clause not negated."),
        ("find {a: == 1} && !{b: != 1}", 'Logical not ("!") is nested inside of another logical not. This is not allowed.'),
    ],
)
def test_errors(text, message):
    with pytest.raises(ParseError) as e:
        parse(text)
    assert str(e.value) == f"Parse error: {message}"


def test_stemmer():
    for word, want in {"consistency": "consist", "knackeries": "knackeri", "hopping": "hop", "hoping": "hope", "relational": "relat", "generically": "generic", "ties": "tie", "cries": "cri", "by": "by", "happily": "happili", "skies": "sky", "dying": "die", "inning": "inning", "succeeding": "succeed", "agreed": "agre", "luxuriated": "luxuri"}.items():
        assert stem(word) == want, word
    assert stems("Let's see: x_y a.b 3rd — naïve ﬁsh™") == ["let", "see", "x_i", "a.b", "naïv", "fish", "tm"]
    assert stems("") == [""] and stems("12 %") == ["12 %"]


def test_prefilter_never_drops_a_match(spark):
    words = ["ｆｉｓｈ", "𝐟ish", "\u212aelvin", "kelvin", "ſhip", "ship", "ªgreed", "«ties»", "naïve fish", "dying", "skies", "hoping", "relational", "fish", "ﬁsh", "happily", "gently", "Quickly", "agreed", "ties", "ponies", "generously", "flies", "ad", "be"]
    rows = spark.createDataFrame([(w,) for w in words], "t string")
    for w in words:
        s = stems(w)[0]
        hit = {r.t for r in rows.where(may_have(F.col("t"), s)).collect()}
        assert {x for x in words if s in stems(x)} <= hit


def test_places_of_words_are_those_of_the_stems(spark):
    rng = random.Random(3)
    parts = ["the", "The", "of", "ſhip", "ships", "dying", "dies", "skies", "early", "o'clock", "O’Clock’s", "ﬁsh", "fishes", "12", "—", "naïve", "hoping", "x_y", "'tis", "İs", "!"]
    texts = ["", "12 %", "...", *(" ".join(rng.choice(parts) for _ in range(rng.randrange(1, 12))) for _ in range(200))]
    assert all(w.startswith(tuple(heads(stem(w)))) for t in [*texts, "gently only relational vietnamization sensibility yellow"] for w in words(t))
    wanted = list(dict.fromkeys(["12 %", *(s for t in texts[3:20] for s in stems(t)), "absent"]))
    want = [(len(found := stems(t)), *([i for i, s in enumerate(found) if s == w] for w in wanted)) for t in texts]
    assert [(n, *own) for n, own in map(finder(wanted), texts)] == want
    rows = spark.createDataFrame([(k, t, [t, None, t]) for k, t in enumerate(texts)] + [(-1, None, None), (-2, None, [])], "k int, t string, ts array<string>").coalesce(1)
    got = rows.select("k", places_udf(wanted)("t").alias("one"), element_places_udf(wanted)("ts").alias("each")).collect()
    for r in got:
        row = want[r.k] if r.k >= 0 else None
        assert (r.one and tuple(r.one)) == row
        assert (r.each if r.each is None else [e and tuple(e) for e in r.each]) == ([row, None, row] if r.k >= 0 else None if r.k == -1 else [])


def test_a_batch_of_texts_is_never_held_as_words():
    import tracemalloc

    import pyarrow as pa

    from veldra.functions.text import _places

    rng = random.Random(8)
    texts = pa.array([" ".join(f"w{rng.randrange(5000)}" for _ in range(2000)) for _ in range(100)])
    tracemalloc.start()
    _places(texts, ("of", "the"))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < texts.nbytes / 4


def test_texts_are_read_once(spark, sf):
    from veldra.queries import QUERIES

    for name in ("fts_phrase_documents", "fts_array_bind", "score_tfidf"):
        assert QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1, name


def test_collation_key_sorts_as_values_do():
    values = [None, False, True, -1e300, -1, -0.5, 0, 1e-9, 1, 2**60, "", "a", "a\x00", "a\x00b", "aa", "b", "é", [], [None], [1], [1, 1], [2], [[]], {}, {"a": 1}, {"a": 1, "b": 0}, {"a": 2}, {"b": 0}]
    assert sorted(values, key=key) == values
    assert key(-0.0) == key(0)
    assert flatten([1, [2, [3, []]], "x"]) == [1, 2, 3, "x"] and flatten(4) == [4]
    assert render({"a": [1.0, 1.5, 1e21, -0.25], "b": 'q"\\', "c": {}}) == '{"a":[1,1.5,1000000000000000000000,-0.25],"b":"q\\"\\\\","c":{}}'


def test_collation_key_in_spark_sorts_alike(spark):
    rng = random.Random(9)
    values = [None, False, True, -1e300, -1, -0.5, -0.0, 1e-9, 1, 2**60, 2**60 + 1, 10**25, "", "a", "a\x00b", "aa", 'q"uote', "back\\slash", "é", "\U0001f600", "\uffff", [], [None], [1, 1], ["b", {"a": 2}], {}, {"a": 1}, {"b": 0}]
    values += [value(rng) for _ in range(100)]
    rows = spark.createDataFrame([(k, json.dumps(v)) for k, v in enumerate(values)] + [(-1, None)], "k int, t string")
    got = [r.k for r in rows.orderBy(collation_key(F.col("t")), "k").collect()]
    assert got == sorted(range(-1, len(values)), key=lambda k: (key(values[k] if k >= 0 else None), k))


def test_streamed_changes(spark, tmp_path):
    store = DocStore(spark, str(tmp_path / "s"), create=True)
    apply_changes(store, spark.createDataFrame([("a", '{"_id":"a","v":1}', 1), ("b", '{"_id":"b","v":2}', 1), ("a", '{"_id":"a","v":3}', 2)], "_id string, text string, at int"))
    assert sorted(int(r[0].toPython()) for r in store.query("find {v: > 0} return .v").collect()) == [2, 3]
    apply_changes(store, spark.createDataFrame([("b", None, 3), ("c", '{"_id":"c","v":9}', 3)], "_id string, text string, at int"))
    assert sorted(int(r[0].toPython()) for r in store.query("find {v: > 0} return .v").collect()) == [3, 9]


def test_contract(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_queries_match_sql(spark, sf):
    """Every query with an SQL form, side by side on the smallest tables."""
    import glob
    import os

    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")

    def rows(frame):
        frame = frame[sorted(frame.columns)]
        return sorted(tuple(f"{float(x):.6g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in r) for r in frame.itertuples(index=False))

    queries = __spark_entry__.queries()
    for name, sql in __spark_entry__.oracle_sql().items():
        got, want = queries[name](spark, sf).toPandas(), con.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns), name
        assert rows(got) == rows(want), name
