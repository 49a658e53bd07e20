"""The language on JSON documents, through the shell: documents are added, then queried."""

import json

import pytest

from veldra.shell import Shell, commands


class Store:
    def __init__(self, spark, docs):
        self.shell = Shell(spark)
        self.shell.run("create t")
        for d in docs:
            assert self.shell.run("add " + (d if isinstance(d, str) else json.dumps(d))).startswith('"')

    def __call__(self, query, params=None):
        if params is not None:
            self.shell.run("params " + json.dumps(params))
        out = self.shell.run("find " + query)
        try:
            return json.loads(out)
        except ValueError:
            return out.strip()


@pytest.fixture(scope="module")
def store(spark):
    return lambda *docs: Store(spark, docs)


@pytest.fixture(scope="module")
def shop(spark):
    return Store(
        spark,
        [
            {"_id": "a", "kind": "tool", "name": "Claw hammer", "price": 12.5, "tags": ["steel", "hand"], "stock": [{"site": "north", "n": 4}, {"site": "south", "n": 0}], "on": True},
            {"_id": "b", "kind": "tool", "name": "hammering machine", "price": 250, "tags": ["steel"], "stock": [{"site": "north", "n": 0}], "on": False},
            {"_id": "c", "kind": "food", "name": "green apple", "price": 1, "tags": [], "on": None, "deep": {"er": {"est": [1, [2, 3]]}}},
            {"_id": "d", "kind": "food", "name": "", "price": "cheap", "tags": ["sweet", "hand"], "stock": [{"site": "south", "n": 9}, {"site": "south", "n": 2}]},
            {"_id": "e", "kind": "misc", "odd key": {"$x": 1}, "matrix": [["p", "q"], ["r"]], "mixed": ["s", 1, True, None, {}, []]},
        ],
    )


def test_equality(shop):
    assert shop('{kind: == "tool"}') == ["a", "b"]
    assert shop('{kind: == "Tool"}') == []
    assert shop('{name: == ""}') == ["d"]
    assert shop("{price: == 250}") == ["b"]
    assert shop('{price: == "250"}') == []
    assert shop("{on: == true}") == ["a"]
    assert shop("{on: == false}") == ["b"]
    assert shop("{on: == null}") == ["c"]
    assert shop('{"odd key": {"$x": == 1}}') == ["e"]
    assert shop('{kind: {name: == "x"}}') == []


def test_not_equal_holds_for_missing_and_other_types(shop):
    assert shop('{(kind: == "food" || kind: == "misc"), price: != 1}') == ["d", "e"]
    assert shop("{kind: == \"food\", on: != null}") == ["d"]


def test_ranges(shop):
    assert shop("{price: > 1}") == ["a", "b"]
    assert shop("{price: >= 1}") == ["a", "b", "c"]
    assert shop("{price: < 12.5}") == ["c"]
    assert shop("{price: <= 12.5}") == ["a", "c"]
    assert shop("{stock: [{n: >= 9}]}") == ["d"]


def test_arrays_refer_to_one_element(shop):
    assert shop('{tags: [== "hand"]}') == ["a", "d"]
    assert shop('{tags: == "hand"}') == []
    assert shop('{stock: [{site: == "north", n: == 0}]}') == ["b"]
    assert shop('{stock: [{site: == "north"}], stock: [{n: == 0}]}') == ["a", "b"]
    assert shop('{matrix: [[== "r"]]}') == ["e"]
    assert shop("{deep: {er: {est: [[== 3]]}}}") == ["c"]
    for value in ('"s"', "1", "true", "null"):
        assert shop(f"{{mixed: [== {value}]}}") == ["e"]


def test_negation_and_arrays(shop):
    assert shop('{(kind: == "tool" || kind: == "food"), tags: ![== "hand"]}') == ["b", "c"]
    assert shop('{(kind: == "tool" || kind: == "food"), tags: [!= "hand"]}') == ["a", "b", "c", "d"]
    assert shop('{tags: [== "sweet" || == "hand"] && tags: [!= "hand"]}') == ["a", "d"]
    assert shop('{kind: == "tool", !(price: > 100 || tags: [== "wood"])}') == ["a"]
    assert shop('{kind: == "food"} && !{tags: [== "hand"]}') == ["c"]


def test_operators_group_to_the_right(shop):
    assert shop('{kind: == "misc" && kind: == "tool" || kind: == "food"}') == []
    assert shop('{(kind: == "misc" && kind: == "tool") || kind: == "food"}') == ["c", "d"]
    assert shop('{kind: == "food" || kind: == "tool" && price: > 100}') == ["b", "c", "d"]


def test_text(shop):
    assert shop('{name: ~= "hammers"}') == ["a", "b"]
    assert shop('{name: ~= "HAMMERED"}') == ["a", "b"]
    assert shop('{name: ~= "claw hammer"}') == ["a"]
    assert shop('{name: ~= "hammer claw"}') == []
    assert shop('{kind: == "tool", name: !~= "machines"}') == ["a"]
    assert shop('{tags: [~= "hands"]}') == ["a", "d"]
    assert shop('{kind: == "food", tags: ![~= "hands"]}') == ["c"]
    assert shop('{tags: [~= "steel" && !~= "hand"]}') == ["a", "b"]


def test_proximity(store):
    s = store({"_id": "1", "t": "one two three four five six"}, {"_id": "2", "t": "six one"})
    assert s('{t: ~3= "one five"}') == ["1"]
    assert s('{t: ~2= "one five"}') == []
    assert s('{t: ~0= "one six"}') == []
    assert s('{t: ~1= "one six"}') == ["2"]
    assert s('{t: ~0= "six one"}') == ["2"]
    assert s('{t: ~1= "two four three"}') == ["1"]
    assert s('{t: ~9= "one six"}') == ["1", "2"]
    assert s('{t: ~9= "one seven"}') == []
    assert s('{t: ~4= "three"}') == ["1"]


def test_return(shop):
    assert shop('{_id: == "a"} return .') == [{"_id": "a", "kind": "tool", "name": "Claw hammer", "on": True, "price": 12.5, "stock": [{"n": 4, "site": "north"}, {"n": 0, "site": "south"}], "tags": ["steel", "hand"]}]
    assert shop('{_id: == "a"} return .stock[1].site') == ["south"]
    assert shop('{_id: == "a"} return .stock[].n') == [[4, 0]]
    assert shop('{_id: == "a"} return .stock[7]') == [None]
    assert shop('{_id: == "c"} return .stock[].n default="none"') == ["none"]
    assert shop('{_id: == "c"} return [.on default=5, .off default=5, .deep.er.est[1][0]]') == [[None, 5, 2]]
    assert shop('{_id: == "e"} return .["odd key"]') == [{"$x": 1}]
    assert shop('{_id: == "e"} return {m: .matrix[][], n: {k: "lit", v: [1, true, null]}}') == [{"m": [["p", "q"], ["r"]], "n": {"k": "lit", "v": [1, True, None]}}]
    assert shop('{_id: == "e"} return .mat') == [None]


def test_binds(shop):
    assert shop('{stock: x::[{site: == "south"}]} return x.n') == [[0], [9, 2]]
    assert shop('{stock: x::[{n: > 3}]} return [._id, x]') == [["a", [{"n": 4, "site": "north"}]], ["d", [{"n": 9, "site": "south"}]]]
    assert shop('{stock: x::[{n: > 3}] || stock: y::[{site: == "north"}]} return [._id, x.n default=-1, y.n default=-1]') == [["a", [4], [4]], ["b", [-1], [0]], ["d", [9], [-1]]]
    assert shop('{stock: x::[{n: > 3}] || stock: x::[{n: < 3}]} return x.n') == [[4, 0], [0], [9, 2]]
    assert shop('{tags: x::[~= "hand"]} return x') == [["hand"], ["hand"]]


def test_order_and_limit(shop):
    assert shop('{kind: == "tool" || kind: == "food"} order .price return .price') == [1, 12.5, 250, "cheap"]
    assert shop('{kind: == "tool" || kind: == "food"} order .price desc return ._id limit 2') == ["d", "b"]
    assert shop('{kind: == "tool" || kind: == "food"} order .kind asc, ._id desc') == ["d", "c", "b", "a"]
    assert shop('{kind: == "tool" || kind: == "food"} order .kind') == ["d", "c", "b", "a"]
    assert shop('{kind: == "tool" || kind: == "food"} order .stock[0].n default=5 asc') == ["b", "a", "c", "d"]
    assert shop('{kind: == "tool" || kind: == "food"} limit 3') == ["a", "b", "c"]


def test_order_across_types(store):
    values = [None, False, True, -2, 1, 1.5, "", "B", "a", "é", [], [None], [1], [1, 0], ["x"], {}, {"a": 1}, {"a": 2}, {"b": 0}]
    mixed = [values[(7 * k) % len(values)] for k in range(len(values))]
    s = store(*({"_id": f"{k:02}", "t": "x", "v": v} for k, v in enumerate(mixed)))
    assert s('{t: == "x"} order .v return .v') == values
    assert s('{t: == "x"} order .v desc return .v') == values[::-1]


def test_aggregates(shop):
    assert shop('{kind: == "tool" || kind: == "food"} return {k: group(.kind), n: count(), s: sum(.price), a: avg(.price)}') == [{"k": "food", "n": 2, "s": 1, "a": 1}, {"k": "tool", "n": 2, "s": 262.5, "a": 131.25}]
    assert shop('{kind: == "tool" || kind: == "food"} return [group(.kind order=desc), min(.price), max(.price)]') == [["tool", 12.5, 250], ["food", 1, "cheap"]]
    assert shop('{tags: [== "hand"] || kind: == "food"} return {t: array(.tags), f: array_flat(.tags), c: concat(.kind sep="/")}') == [{"t": [["sweet", "hand"], [], ["steel", "hand"]], "f": ["sweet", "hand", "steel", "hand"], "c": "food/food/tool"}]
    assert shop('{kind: == "food"} return [min_array(.tags), max_array(.tags), sum(.deep.er.est), avg(.deep.er.est), min(.missing), max(.missing) default=3]') == [["hand", "sweet", 6, 2, None, 3]]
    assert shop('{_id: == "c"} return [min_array(.tags), max_array(.tags), avg(.tags), sum(.tags)]') == [[[], [], None, 0]]
    assert shop('{kind: == "none"} return {n: count(), s: sum(.price)}') == []
    assert shop('{kind: == "food" || kind: == "tool"} return {s: sum(x.n), k: group(.kind)}') == [{"s": 0, "k": "food"}, {"s": 0, "k": "tool"}]
    assert shop('{stock: x::[{n: > 1}]} return {k: group(.kind), s: sum(x.n)}') == [{"k": "food", "s": 11}, {"k": "tool", "s": 4}]
    assert shop('{kind: == "misc" || kind: == "food"} return concat(.name)') == [",,green apple"]
    assert shop('{kind: == "misc" || kind: == "food"} return [group(.price) default="?", count()] limit 2') == [[1, 1], ["?", 1]]


def test_parameters(shop):
    assert shop("{kind: == @k, price: > @p}", {"k": "tool", "p": 100}) == ["b"]
    assert shop("{name: ~= @w}", {"w": "hammer"}) == ["a", "b"]
    assert shop("{on: == @v}", {"v": None}) == ["c"]
    assert shop("{kind: == @k}") == "Parse error: No matching parameter for @k."
    assert shop("{price: > @p}", {"p": "x"}) == "Parse error: Range operator on non-number JSON types is not yet implemented!"
    assert shop("{name: ~= @w}", {"w": 3}) == "Parse error: Parameter @w must be a string."
    assert shop("{kind: == @k}", {"k": [1]}).startswith("Parse error: Parameterized query values must be")


def test_scores(store):
    s = store({"_id": "1", "t": "fox"}, {"_id": "2", "t": "red fox"}, {"_id": "3", "t": "red sly fox"})
    three = [0.5773501992225647, 0.2468651682138443, 0.07121198624372482]
    assert s('{t: ~="fox" || t: ~="sly" || t: ~="red"} order score() desc return score()') == three
    assert s('{t: ~="fox"}^2 || {t: ~="sly" || t: ~="red"}^2 order score() desc return score()') == [2 * x for x in three]
    assert s('{t: ~="red sly fox"} return score()') == [0.05966803431510925]
    assert s('{t: ~2="red sly fox"} return score()') == [0.0916677787899971]
    assert s('{t: =="fox"^5} return score()') == [1]
    assert s("{} order score() return [._id, score()]") == [["3", 1], ["2", 1], ["1", 1]]
    assert s('{(t: =="fox")^3 || t: =="red"} return score()') == [0.75]
    a = store({"_id": "1", "t": ["fox"]}, {"_id": "2", "t": ["red fox"]}, {"_id": "3", "t": ["red sly fox"]})
    assert a('{t: [~="fox" || ~="sly" || ~="red"]} order score() desc return score()') == three
    assert a('{t: [~="fox"]^2 || t: [~="sly" || ~="red"]^2} order score() desc return score()') == [2 * x for x in three]


def test_geometry(store):
    s = store(
        {"_id": "p", "g": {"type": "Point", "coordinates": [10, 50]}},
        {"_id": "l", "g": {"coordinates": [[0, 0], [5, 5.5]], "type": "LineString"}},
        {"_id": "poly", "g": {"type": "Polygon", "coordinates": [[[100, 0], [101, 0], [101, 1], [100, 0]]]}},
        {"_id": "many", "g": {"type": "MultiPolygon", "coordinates": [[[[-50, -50], [-49, -50], [-49, -49]]], [[[-40, -40], [-39, -40], [-39, -39]]]]}},
        {"_id": "no", "g": {"type": "Circle", "coordinates": [10, 50]}},
        {"_id": "arr", "area": [{"type": "Point", "coordinates": [1, 2]}, {"type": "Point", "coordinates": [-3, -4]}]},
    )
    assert s("{g: && [9, 49, 11, 51]}") == ["p"]
    assert s("{g: && [5, 5, 10, 50]}") == ["p", "l"]
    assert s("{g: && [101, 1, 200, 2]}") == ["poly"]
    assert s("{g: && [-45, -45, -44, -44]}") == ["many"]
    assert s("{area: [&& [0, 0, 5, 5]]}") == ["arr"]
    assert s("{area: x::[&& [-10, -10, 5, 5]]} return x.coordinates") == [[[-3, -4], [1, 2]]]
    assert s("{g: && [9, 49, 11, 51]} return score()") == [1]
    assert s('{(g: && [9, 49, 11, 51])^2 || g: {type: == "Polygon"}} return [._id, score()]') == [["p", 0.5], ["poly", 0.25]]
    assert s("{g: && [1, 2, 3]}") == "Parse error: Bounding box needs to be `[west, south, east, north]`."


def test_store(store, spark, tmp_path):
    s = store({"_id": "x", "v": 1})
    run = s.shell.run
    run("commit")
    assert run("del nobody") == "not found\n"
    assert run("del x") == "ok\n"
    assert run('add {"_id":"x"}') == "Write error: Attempt to insert multiple docs with same _id\n"
    run("commit")
    assert s("{}") == []
    run('add {"_id":"x","v":2}')
    assert run("del x") == "Write error: Attempt to delete doc with same _id added earlier\n"
    assert run('add {"_id":5}') == "Shred error: Expected string for `_id` field, got another type\n"
    assert len(json.loads(run('add {"v":3}'))) == 32
    assert s("{v: >= 2} return .v") == [2, 3]
    run('add {"_id":"x","v":4}')
    assert s("{v: >= 2} return .v") == [4, 3]
    assert "x" in run("dumpkeys") and run("nonsense") == "Unrecognized command!\n"
    run("pretty on")
    assert run('find {_id: == "x"} return {a: .v, b: []}') == '[\n  {\n    "a": 4,\n    "b": []\n  }\n]\n'
    disk = Shell(spark, str(tmp_path))
    assert disk.run("find {}") == "Index isn't open\n"
    disk.run("create d")
    for k in range(3):
        disk.run(f'add {{"_id":"{k}","v":{k}}}')
    assert disk.run("find {v: > 0} return .v") == "[\n1,\n2\n]\n"
    disk.run('add {"_id":"1","v":7}')
    disk.run("del 2")
    assert disk.run("find {v: >= 0} return .v") == "[\n0,\n7\n]\n"
    other = Shell(spark, str(tmp_path))
    other.run("open d")
    assert other.run("find {v: > 1} return ._id") == '[\n"1"\n]\n'
    disk.store.vacuum()
    assert other.run("find {v: > 1} return ._id") == '[\n"1"\n]\n'
    other.run("drop d")
    assert "no store" in Shell(spark, str(tmp_path)).run("open d")


def test_all_documents_come_by_the_text_of_their_number(store):
    s = store(*({"_id": str(k)} for k in range(12)))
    assert s("{}") == ["0", "1", "10", "11", "2", "3", "4", "5", "6", "7", "8", "9"]


def test_commands_end_with_a_semicolon():
    import io

    assert list(commands(io.StringIO("# note\nfind {a: ==\n 1};\n\ncommit;\nfind {}"))) == ["find {a: ==\n 1}", "commit", "find {}"]
