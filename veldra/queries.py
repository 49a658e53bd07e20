"""Queries over the driver's tables, one or more for every operator of the language, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from .plans.engine import run
from .sources.collection import Collection
from .sources.store import merge_changes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Lines of an order in a fixed order; the key of a line is not unique in the data.
_LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _plain(name: str, key: str) -> Callable[[SparkSession, str], Collection]:
    return lambda spark, sf_dir: Collection.typed(_table(spark, sf_dir, name), key)


def _items(*wanted: str) -> Callable[[SparkSession, str], Collection]:
    """Orders with their lines as ``items``, of the given fields; one shuffle on the order key serves the grouping and the join.

    The fields that give lines their order are carried through the sort and then left out.
    """

    def build(spark: SparkSession, sf_dir: str) -> Collection:
        fields = [*_LINE_ORDER, *(c for c in wanted if c not in _LINE_ORDER)]
        items = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("items"))
        items = items.withColumn("items", F.transform("items", lambda e: F.struct(*(e[c].alias(c) for c in wanted))))
        orders = _table(spark, sf_dir, "orders")
        return Collection.typed(orders.join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey"), "o_orderkey")

    return build


def customer_docs(spark: SparkSession, sf_dir: str) -> Collection:
    """Customers with their orders, each with its lines."""
    orders = _items("l_quantity")(spark, sf_dir).df
    held = orders.groupBy("o_custkey").agg(F.collect_list(F.struct("o_orderkey", "o_orderstatus", "items")).alias("orders"))
    return Collection.typed(_table(spark, sf_dir, "customer").join(held, F.col("c_custkey") == F.col("o_custkey"), "left").drop("o_custkey"), "c_custkey")


def event_docs(spark: SparkSession, sf_dir: str) -> Collection:
    events = _table(spark, sf_dir, "events")
    return Collection.typed(events.withColumn("props", F.parse_json("props")), "event_id")


def mixed_docs(spark: SparkSession, sf_dir: str) -> Collection:
    """Events as JSON documents whose ``v`` has a type by event_id % 7 (0: there is none)."""
    k, n = F.col("event_id") % 7, F.col("event_id").cast("string")
    v = (
        F.when(k == 1, F.lit("null"))
        .when(k == 2, F.lit("false"))
        .when(k == 3, F.lit("true"))
        .when(k == 4, n)
        .when(k == 5, F.concat(F.lit('"s'), n, F.lit('"')))
        .when(k == 6, F.concat(F.lit("["), n, F.lit("]")))
    )
    text = F.concat(F.lit('{"_id":"'), n, F.lit('","n":'), n, F.coalesce(F.concat(F.lit(',"v":'), v), F.lit("")), F.lit("}"))
    return Collection.from_json_text(_table(spark, sf_dir, "events").select("event_id", text.alias("text")), "text", "event_id")


def point_docs(spark: SparkSession, sf_dir: str) -> Collection:
    vectors = _table(spark, sf_dir, "embeddings")
    point = F.struct(F.lit("Point").alias("type"), F.array(F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double")).alias("coordinates"))
    return Collection.typed(vectors.select("vec_id", "label", point.alias("geometry")), "vec_id")


def _add(name: str, source: Callable[[SparkSession, str], Collection], query: str, columns: dict[str, str], sql: str | None, params: dict | None = None) -> None:
    """``columns``: name -> SQL expression over the query's result."""

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(source(spark, sf_dir), query, params).selectExpr(*(f"{e} AS {c}" for c, e in columns.items()))

    QUERIES[name] = build
    if sql is not None:
        ORACLES[name] = sql


def _ranked(df: DataFrame) -> DataFrame:
    """An ordered DataFrame with each row's place, from 1, as ``rank``; no partition sees another's rows, and Python none.

    Counting and numbering read the partitions of one RDD, so its shuffle is made once and its bounds are the same for both.
    """
    spark = df.sparkSession
    rows = DataFrame(spark._jsparkSession.createDataFrame(df._jdf.toDF().javaRDD(), df._jdf.schema()), spark)
    counts = dict(rows.groupBy(F.spark_partition_id()).count().collect())
    before = list(accumulate((counts.get(k, 0) for k in range(max(counts, default=0) + 1)), initial=1))
    # The number of the partition, and below 33 bits that of the row in it.
    rows = rows.withColumn("__at", F.monotonically_increasing_id())
    first = F.get(F.lit(np.array(before, dtype="int64")), F.shiftright("__at", 33).cast("int"))
    return rows.select(*df.columns, (first + F.col("__at").bitwiseAND((1 << 33) - 1)).alias("rank"))


def _add_whole(name: str, source: Callable[[SparkSession, str], Collection], query: str, columns: dict[str, str], sql: str) -> None:
    """A query whose result is an order of its whole table, shown by ``rank``."""
    QUERIES[name] = lambda spark, sf_dir: _ranked(run(source(spark, sf_dir), query, ordered=True).selectExpr(*(f"{e} AS {c}" for c, e in columns.items())))
    ORACLES[name] = sql


_REGION, _NATION, _PART = _plain("region", "r_regionkey"), _plain("nation", "n_nationkey"), _plain("part", "p_partkey")
_ORDERS, _CUSTOMER, _LINES = _plain("orders", "o_orderkey"), _plain("customer", "c_custkey"), _plain("lineitem", "l_orderkey")
_ID = {"id": "CAST(_id AS BIGINT)"}
_O = "SELECT o_orderkey AS id FROM orders WHERE "
_L = "SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey"

# Predicates
_add("find_all", _REGION, "find {}", _ID, "SELECT CAST(r_regionkey AS BIGINT) AS id FROM region")
_add("eq_string", _ORDERS, 'find {o_orderstatus: == "F"}', _ID, _O + "o_orderstatus = 'F'")
_add("eq_number", _PART, "find {p_size: == 10}", _ID, "SELECT p_partkey AS id FROM part WHERE p_size = 10")
_add("neq", _ORDERS, 'find {o_totalprice: > 0, o_orderstatus: != "F"}', _ID, _O + "o_totalprice > 0 AND o_orderstatus <> 'F'")
_add("neq_type_mismatch", _ORDERS, 'find {o_totalprice: > 0, o_orderstatus: != 5}', _ID, _O + "o_totalprice > 0")
for _name, _op in (("gt", ">"), ("ge", ">="), ("lt", "<"), ("le", "<=")):
    _add(
        f"range_{_name}", _LINES, f"find {{l_quantity: {_op} 25}} return {{k: .l_orderkey, q: .l_quantity}}", {"k": "k", "q": "q"}, f"SELECT l_orderkey AS k, l_quantity AS q FROM lineitem WHERE l_quantity {_op} 25"
    )
_add("range_between", _ORDERS, "find {o_totalprice: > 1000, o_totalprice: <= 50000}", _ID, _O + "o_totalprice > 1000 AND o_totalprice <= 50000")
_add("bool_and", _ORDERS, 'find {o_orderstatus: == "O" && o_totalprice: > 100000}', _ID, _O + "o_orderstatus = 'O' AND o_totalprice > 100000")
_add("bool_or", _PART, "find {p_size: < 5 || p_size: > 45}", _ID, "SELECT p_partkey AS id FROM part WHERE p_size < 5 OR p_size > 45")
_add(
    "bool_or_prec", _PART, "find {p_size: > 10 && p_size: < 20 || p_retailprice: > 1500}", _ID, "SELECT p_partkey AS id FROM part WHERE p_size > 10 AND (p_size < 20 OR p_retailprice > 1500)"
)
_add("bool_paren", _PART, "find {(p_size: > 10 && p_size: < 20) || p_retailprice: > 1500}", _ID, "SELECT p_partkey AS id FROM part WHERE (p_size > 10 AND p_size < 20) OR p_retailprice > 1500")
_add(
    "bool_not", _CUSTOMER, 'find {c_acctbal: > 0 && !(c_mktsegment: == "FURNITURE" || c_mktsegment: == "BUILDING")}', _ID, "SELECT c_custkey AS id FROM customer WHERE c_acctbal > 0 AND c_mktsegment NOT IN ('FURNITURE', 'BUILDING')"
)
_add("bool_objects", _ORDERS, 'find {o_orderstatus: == "F"} && !{o_totalprice: > 50000}', _ID, _O + "o_orderstatus = 'F' AND NOT o_totalprice > 50000")
_add("param_query", _ORDERS, "find {o_orderstatus: == @s, o_totalprice: > @p}", _ID, _O + "o_orderstatus = 'F' AND o_totalprice > 90000", {"s": "F", "p": 90000})
_add("nested_object", event_docs, "find {props: {k: > 50}}", _ID, "SELECT event_id AS id FROM events WHERE CAST(json_extract(props, '$.k') AS DOUBLE) > 50")
_M = "SELECT event_id AS id FROM events WHERE event_id % 7 = "
_add("eq_null", mixed_docs, "find {v: == null}", _ID, _M + "1")
_add("eq_bool", mixed_docs, "find {v: == true}", _ID, _M + "3")
_add("eq_number_dynamic", mixed_docs, "find {v: >= 100}", _ID, _M + "4 AND event_id >= 100")
_add("eq_string_dynamic", mixed_docs, 'find {v: == "s5"}', _ID, _M + "5 AND event_id = 5")
_add("neq_missing", mixed_docs, "find {n: > 10, v: != true}", _ID, "SELECT event_id AS id FROM events WHERE event_id > 10 AND event_id % 7 <> 3")
_add("array_dynamic", mixed_docs, "find {v: [> 50]}", _ID, _M + "6 AND event_id > 50")

# Arrays
_add("array_any", _items("l_returnflag"), 'find {items: [{l_returnflag: == "R"}]}', _ID, _O + f"EXISTS ({_L} AND l_returnflag = 'R')")
_add("array_same_elem", _items("l_returnflag", "l_quantity"), 'find {items: [{l_returnflag: == "R", l_quantity: > 30}]}', _ID, _O + f"EXISTS ({_L} AND l_returnflag = 'R' AND l_quantity > 30)")
_add(
    "array_diff_elem", _items("l_returnflag", "l_quantity"), 'find {items: [{l_returnflag: == "R"}], items: [{l_quantity: > 30}]}', _ID, _O + f"EXISTS ({_L} AND l_returnflag = 'R') AND EXISTS ({_L} AND l_quantity > 30)"
)
_add("not_array", _items("l_returnflag"), 'find {o_orderstatus: == "F", items: ![{l_returnflag: == "R"}]}', _ID, _O + f"o_orderstatus = 'F' AND NOT EXISTS ({_L} AND l_returnflag = 'R')")
_add(
    "not_elem", _items("l_returnflag"), 'find {o_orderstatus: == "F", items: [!{l_returnflag: == "R"}]}', _ID, _O + f"o_orderstatus = 'F' AND (EXISTS ({_L} AND l_returnflag <> 'R') OR NOT EXISTS ({_L}))"
)
_add(
    "array_nested",
    customer_docs,
    'find {orders: [{o_orderstatus: == "F", items: [{l_quantity: > 49}]}]}',
    _ID,
    "SELECT c_custkey AS id FROM customer WHERE EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND l_quantity > 49)",
)

# Bind variables
_SORTED = ", ".join(_LINE_ORDER)
_LIST = "array_join(transform({0}, x -> CAST(CAST(x AS BIGINT) AS STRING)), ',')"


def _listed(condition: str) -> str:
    return f"(SELECT string_agg(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), ',' ORDER BY {_SORTED}) FROM lineitem WHERE l_orderkey = o_orderkey AND {condition})"


_add(
    "bind_path",
    _items("l_quantity"),
    "find {items: x::[{l_quantity: > 45}]} return {id: .o_orderkey, q: x.l_quantity}",
    {"id": "id", "q": _LIST.format("q")},
    f"SELECT o_orderkey AS id, {_listed('l_quantity > 45')} AS q FROM orders WHERE EXISTS ({_L} AND l_quantity > 45)",
)
_add(
    "bind_elems",
    _items("l_quantity", "l_partkey"),
    "find {items: x::[{l_quantity: > 45}]} return {id: .o_orderkey, x: x}",
    {"id": "id", "n": "CAST(size(x) AS BIGINT)", "p": "array_join(transform(x, e -> CAST(e.l_partkey AS STRING)), ',')"},
    f"SELECT l_orderkey AS id, count(*) AS n, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY {_SORTED}) AS p FROM lineitem WHERE l_quantity > 45 AND l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY l_orderkey",
)
_add(
    "bind_two",
    _items("l_quantity"),
    "find {items: x::[{l_quantity: > 45}], items: y::[{l_quantity: < 5}]} return {id: .o_orderkey, q: x.l_quantity, r: y.l_quantity}",
    {"id": "id", "q": _LIST.format("q"), "r": _LIST.format("r")},
    f"SELECT o_orderkey AS id, {_listed('l_quantity > 45')} AS q, {_listed('l_quantity < 5')} AS r FROM orders WHERE EXISTS ({_L} AND l_quantity > 45) AND EXISTS ({_L} AND l_quantity < 5)",
)
_add(
    "bind_merge",
    _items("l_quantity"),
    "find {items: x::[{l_quantity: > 45}] || items: x::[{l_quantity: < 5}]} return {id: .o_orderkey, q: x.l_quantity}",
    {"id": "id", "q": _LIST.format("q")},
    f"SELECT o_orderkey AS id, concat_ws(',', {_listed('l_quantity > 45')}, {_listed('l_quantity < 5')}) AS q FROM orders WHERE EXISTS ({_L} AND (l_quantity > 45 OR l_quantity < 5))",
)

# Return
_add("ret_doc", _NATION, "find {n_regionkey: == 1} return .", {"id": "CAST(doc.n_nationkey AS BIGINT)", "name": "doc.n_name"}, "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation WHERE n_regionkey = 1")
_add("ret_quoted", _CUSTOMER, 'find {c_acctbal: > 0} return {id: .c_custkey, name: .["c_name"]}', {"id": "id", "name": "name"}, "SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_acctbal > 0")
_add("ret_path", _CUSTOMER, "find {c_acctbal: > 0} return .c_name", {"name": "c_name"}, "SELECT c_name AS name FROM customer WHERE c_acctbal > 0")
_add(
    "ret_index",
    _items("l_partkey"),
    "find {o_totalprice: > 1000} return {id: .o_orderkey, p: .items[1].l_partkey default=-1}",
    {"id": "id", "p": "p"},
    f"SELECT o_orderkey AS id, coalesce(p, -1) AS p FROM orders LEFT JOIN (SELECT l_orderkey, list(l_partkey ORDER BY {_SORTED})[2] AS p FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey WHERE o_totalprice > 1000",
)
_add(
    "ret_array_all",
    _items("l_quantity"),
    "find {o_totalprice: > 1000} return {id: .o_orderkey, q: .items[].l_quantity}",
    {"id": "id", "q": _LIST.format("q")},
    f"SELECT o_orderkey AS id, {_listed('true')} AS q FROM orders WHERE o_totalprice > 1000",
)
_add(
    "ret_object",
    _ORDERS,
    'find {o_orderstatus: == "F"} return {id: .o_orderkey, "the price": .o_totalprice, nested: {s: .o_orderstatus}}',
    {"id": "id", "price": "`the price`", "s": "nested.s"},
    "SELECT o_orderkey AS id, o_totalprice AS price, o_orderstatus AS s FROM orders WHERE o_orderstatus = 'F'",
)
_add("ret_array_tmpl", _PART, "find {p_size: < 3} return [.p_partkey, .p_brand, .p_size]", {"a": "_1", "b": "_2", "c": "_3"}, "SELECT p_partkey AS a, p_brand AS b, p_size AS c FROM part WHERE p_size < 3")
_add(
    "ret_literal", _REGION, 'find {} return {id: .r_regionkey, s: "text", n: 1.5, t: true}', {"id": "id", "s": "s", "n": "CAST(n AS DOUBLE)", "t": "t"}, "SELECT r_regionkey AS id, 'text' AS s, CAST(1.5 AS DOUBLE) AS n, true AS t FROM region"
)
_add("ret_default", mixed_docs, "find {n: >= 0} return {id: .n, v: .v default=\"none\"}", {"id": "CAST(id AS BIGINT)", "v": "to_json(v)"}, "SELECT event_id AS id, CASE event_id % 7 WHEN 0 THEN '\"none\"' WHEN 1 THEN 'null' WHEN 2 THEN 'false' WHEN 3 THEN 'true' WHEN 4 THEN CAST(event_id AS VARCHAR) WHEN 5 THEN '\"s' || event_id || '\"' ELSE '[' || event_id || ']' END AS v FROM events")

# Order and limit
_TOP = "SELECT o_orderkey AS id, o_totalprice AS p FROM orders "
_add("limit_order", _ORDERS, "find {o_totalprice: > 0} order .o_totalprice desc return {id: .o_orderkey, p: .o_totalprice} limit 25", {"id": "id", "p": "p"}, _TOP + "WHERE o_totalprice > 0 ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 25")
# Orders of whole tables, where the place of every row counts.
_ALL = "SELECT o_orderkey AS id, {0}row_number() OVER (ORDER BY {1}, o_orderkey DESC) AS rank FROM orders WHERE o_totalprice > 0"
_add_whole("order_asc", _ORDERS, "find {o_totalprice: > 0} order .o_totalprice return {id: .o_orderkey, p: .o_totalprice}", {"id": "id", "p": "p"}, _ALL.format("o_totalprice AS p, ", "o_totalprice"))
_add_whole("order_desc", _ORDERS, "find {o_totalprice: > 0} order .o_totalprice desc return {id: .o_orderkey, p: .o_totalprice}", {"id": "id", "p": "p"}, _ALL.format("o_totalprice AS p, ", "o_totalprice DESC"))
_add_whole(
    "order_multi",
    _ORDERS,
    "find {o_totalprice: > 0} order .o_orderpriority desc, .o_orderstatus asc, .o_totalprice desc return {id: .o_orderkey}",
    {"id": "id"},
    _ALL.format("", "o_orderpriority DESC, o_orderstatus, o_totalprice DESC"),
)
_add_whole(
    "order_default",
    _items("l_quantity"),
    "find {o_totalprice: > 0} order .items[6].l_quantity default=1000 asc return {id: .o_orderkey}",
    {"id": "id"},
    f"SELECT o_orderkey AS id, row_number() OVER (ORDER BY coalesce(q, 1000), o_orderkey DESC) AS rank FROM orders LEFT JOIN (SELECT l_orderkey, list(l_quantity ORDER BY {_SORTED})[7] AS q FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey WHERE o_totalprice > 0",
)
_add("limit_plain", _ORDERS, 'find {o_orderstatus: == "O"} limit 50', _ID, _O + "o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 50")
_add("limit_group", _ORDERS, "find {o_totalprice: > 0} return {p: group(.o_orderpriority), n: count()} limit 3", {"p": "p", "n": "n"}, "SELECT o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1 ORDER BY 1 LIMIT 3")

# Groups and aggregates
_add("group_count", _ORDERS, "find {} return {s: group(.o_orderstatus), n: count()}", {"s": "s", "n": "n"}, "SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1")
_add_whole("group_desc", _ORDERS, "find {} return {p: group(.o_orderpriority order=desc), n: count()}", {"p": "p", "n": "n"}, "SELECT o_orderpriority AS p, count(*) AS n, row_number() OVER (ORDER BY o_orderpriority DESC) AS rank FROM orders GROUP BY 1")
_add(
    "group_multi",
    _ORDERS,
    "find {} return [group(.o_orderstatus), group(.o_orderpriority order=desc), count(), max(.o_totalprice)]",
    {"s": "_1", "p": "_2", "n": "_3", "m": "_4"},
    "SELECT o_orderstatus AS s, o_orderpriority AS p, count(*) AS n, max(o_totalprice) AS m FROM orders GROUP BY 1, 2",
)
_add("group_only", _CUSTOMER, "find {} return group(.c_mktsegment)", {"s": "`group`"}, "SELECT DISTINCT c_mktsegment AS s FROM customer")
_add("group_default", mixed_docs, 'find {n: >= 0} return {v: group(.w) default="none", n: count()}', {"v": "to_json(v)", "n": "CAST(n AS BIGINT)"}, "SELECT '\"none\"' AS v, count(*) AS n FROM events")
for _fun in ("sum", "avg", "min", "max"):
    _add(
        f"agg_{_fun}",
        _LINES,
        f"find {{}} return {{f: group(.l_returnflag), v: {_fun}(.l_quantity)}}",
        {"f": "f", "v": "round(v, 4)"},
        f"SELECT l_returnflag AS f, round({_fun}(l_quantity), 4) AS v FROM lineitem GROUP BY 1",
    )
_add("agg_count", _LINES, "find {l_quantity: > 10} return count()", {"n": "`count`"}, "SELECT count(*) AS n FROM lineitem WHERE l_quantity > 10")
_add("agg_none", _LINES, "find {l_quantity: > 1000000} return {n: count(), s: sum(.l_quantity)}", {"n": "n", "s": "s"}, "SELECT CAST(1 AS BIGINT) AS n, CAST(1 AS DOUBLE) AS s FROM lineitem WHERE l_quantity > 1000000")
_JOINED = "FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderstatus"
for _fun, _sql in (("sum", "coalesce(sum(l_quantity), 0)"), ("avg", "avg(l_quantity)"), ("min_array", "min(l_quantity)"), ("max_array", "max(l_quantity)")):
    _add(
        f"agg_{_fun}" if "array" in _fun else f"agg_{_fun}_array",
        _items("l_quantity"),
        f"find {{}} return {{s: group(.o_orderstatus), v: {_fun}(.items[].l_quantity)}}",
        {"s": "s", "v": "round(v, 4)"},
        f"SELECT o_orderstatus AS s, round({_sql}, 4) AS v {_JOINED}",
    )
_add(
    "agg_array", _NATION, "find {} return {r: group(.n_regionkey), names: array(.n_name)}", {"r": "r", "names": "array_join(names, ',')"}, "SELECT n_regionkey AS r, string_agg(n_name, ',' ORDER BY n_nationkey DESC) AS names FROM nation GROUP BY 1"
)
_add(
    "agg_concat", _NATION, 'find {} return {r: group(.n_regionkey), names: concat(.n_name sep="|")}', {"r": "r", "names": "names"}, "SELECT n_regionkey AS r, string_agg(n_name, '|' ORDER BY n_nationkey DESC) AS names FROM nation GROUP BY 1"
)
_add(
    "agg_array_flat",
    _items("l_quantity"),
    "find {o_totalprice: > 0} return {c: group(.o_custkey), q: array_flat(.items[].l_quantity)}",
    {"c": "c", "n": "CAST(size(filter(q, x -> x IS NOT NULL)) AS BIGINT)", "q": "array_join(transform(q, x -> CAST(CAST(x AS BIGINT) AS STRING)), ',')"},
    f"SELECT o_custkey AS c, count(l_quantity) AS n, coalesce(string_agg(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), ',' ORDER BY o_orderkey DESC, {_SORTED}), '') AS q FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_totalprice > 0 GROUP BY 1",
)
_add(
    "agg_bind",
    _items("l_quantity"),
    "find {items: x::[{l_quantity: > 40}]} return {s: group(.o_orderstatus), q: sum(x.l_quantity), n: count()}",
    {"s": "s", "q": "round(q, 4)", "n": "n"},
    "SELECT o_orderstatus AS s, round(sum(l_quantity), 4) AS q, count(DISTINCT o_orderkey) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity > 40 GROUP BY 1",
)
_add("agg_default", mixed_docs, "find {n: >= 0} return {m: max(.w) default=120, s: sum(.w) default=2}", {"m": "to_json(m)", "s": "CAST(s AS DOUBLE)"}, "SELECT '120' AS m, CAST(2 * count(*) AS DOUBLE) AS s FROM events")
_RANK = "event_id % 7, CASE WHEN event_id % 7 = 4 THEN event_id WHEN event_id % 7 = 6 THEN event_id END"
_add_whole(
    "collation_order",
    mixed_docs,
    "find {n: >= 0} order .v desc return {id: .n}",
    {"id": "CAST(id AS BIGINT)"},
    "SELECT event_id AS id, row_number() OVER (ORDER BY CASE WHEN event_id % 7 = 0 THEN 1 ELSE event_id % 7 END DESC, CASE WHEN event_id % 7 IN (4, 6) THEN event_id END DESC NULLS LAST, CASE WHEN event_id % 7 = 5 THEN 's' || event_id END DESC NULLS LAST, event_id DESC) AS rank FROM events",
)
_add(
    "collation_minmax",
    mixed_docs,
    "find {n: >= 0} return {lo: min(.v), hi: max(.v), hia: max_array(.v)}",
    {"lo": "to_json(lo)", "hi": "to_json(hi)", "hia": "to_json(hia)"},
    "SELECT 'null' AS lo, '[' || max(CASE WHEN event_id % 7 = 6 THEN event_id END) || ']' AS hi, '\"' || max(CASE WHEN event_id % 7 = 5 THEN 's' || event_id END) || '\"' AS hia FROM events",
)

# Text
_P = "SELECT p_partkey AS id FROM part WHERE "
_add("fts_word", _PART, 'find {p_name: ~= "plates"}', _ID, _P + r"regexp_matches(p_name, '\bplates?\b')")
_add("fts_not_word", _PART, 'find {p_size: > 0, p_name: !~= "red"}', _ID, _P + r"p_size > 0 AND NOT regexp_matches(p_name, '\bred\b')")
_add("fts_phrase", _PART, 'find {p_name: ~= "red plate"}', _ID, _P + r"regexp_matches(p_name, '\bred plate\b')")
_DOCUMENTS, _TALK = _plain("documents", "doc_id"), _plain("conversations", "conv_id")
_add("fts_documents", _DOCUMENTS, 'find {text: ~= "licensed"} return {id: .doc_id}', {"id": "id"}, r"SELECT doc_id AS id FROM documents WHERE regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])(licens(e|es|ed|ing))([^\p{L}\p{N}_]|$)')")
#: Words by the rules of segmentation, of which those that begin with a letter count.
_WORDS = r"list_filter(regexp_extract_all(lower({0}), '[\p{{L}}\p{{M}}\p{{N}}_]*\p{{L}}(?:[''’.:]\p{{L}}(?:[\p{{L}}\p{{M}}\p{{N}}_]*\p{{L}})?)*[\p{{M}}\p{{N}}_]*|[\p{{M}}\p{{N}}_]+'), lambda x: regexp_matches(x, '^\p{{L}}'))"
_AT = "list_filter(range(1, len(w) + 1), lambda i: w[i] = '{0}')"


def _near(p: str, q: str, distance: int) -> str:
    """Whether place q of an earlier word is near place p of a later one."""
    return f"({q} - {p} BETWEEN {-distance - 1} AND {distance})"


def _some(condition: str, name: str, places: str) -> str:
    return f"len(list_filter({places}, lambda {name}: {condition})) > 0"


def _placed(table: str, columns: str, text: str, *words: str, where: str = "true") -> str:
    places = ", ".join(f"{_AT.format(word)} AS p{k}" for k, word in enumerate(words))
    return f"WITH w AS (SELECT {columns}, {_WORDS.format(text)} AS w FROM {table} WHERE {where}), t AS (SELECT *, {places} FROM w)"


_add("fts_phrase_documents", _DOCUMENTS, 'find {text: ~= "of the"} return {id: .doc_id}', {"id": "id"}, _placed("documents", "doc_id AS id", "text", "of", "the") + " SELECT id FROM t WHERE " + _some("list_contains(p1, q + 1)", "q", "p0"))
_add("fts_proximity", _DOCUMENTS, 'find {text: ~3= "with from"} return {id: .doc_id}', {"id": "id"}, _placed("documents", "doc_id AS id", "text", "with", "from") + " SELECT id FROM t WHERE " + _some(_some(_near("p", "q", 3), "q", "p0"), "p", "p1"))
_add(
    "fts_proximity3",
    _DOCUMENTS,
    'find {text: ~2= "the of with"} return {id: .doc_id}',
    {"id": "id"},
    _placed("documents", "doc_id AS id", "text", "the", "of", "with")
    + f", k AS (SELECT id, p2, list_filter(p0, lambda q: {_some(_near('p', 'q', 2), 'p', 'p1')}) AS k0, list_filter(p1, lambda p: {_some(_near('p', 'q', 2), 'q', 'p0')}) AS k1 FROM t) SELECT id FROM k WHERE "
    + _some(_some(_near("p", "q", 2), "q", "k0") + " AND " + _some(_near("p", "q", 2), "q", "k1"), "p", "p2"),
)
_add(
    "fts_conversations",
    _TALK,
    'find {role: == "user", text: ~2= "the of"} return {id: .conv_id, t: .turn}',
    {"id": "id", "t": "t"},
    _placed("conversations", "conv_id AS id, turn AS t", "text", "the", "of", where="role = 'user'") + " SELECT id, t FROM t WHERE " + _some(_some(_near("p", "q", 2), "q", "p0"), "p", "p1"),
)


def talk_docs(spark: SparkSession, sf_dir: str) -> Collection:
    """Conversations as documents, with their turns as an array."""
    turns = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return Collection.typed(turns, "conv_id")


_SAID = _placed("conversations", "conv_id AS id, role", "text", "for", "the")
_add("fts_array", talk_docs, 'find {turns: [{role: == "user", text: ~= "for"}]}', _ID, _SAID + " SELECT DISTINCT id FROM t WHERE role = 'user' AND len(p0) > 0")
_add("fts_array_proximity", talk_docs, 'find {turns: [{text: ~4= "for the"}], turns: [{role: == "system"}]}', _ID, _SAID + ", n AS (SELECT id FROM t WHERE " + _some(_some(_near("p", "q", 4), "q", "p0"), "p", "p1") + ") SELECT DISTINCT id FROM n WHERE id IN (SELECT id FROM t WHERE role = 'system')")
_add(
    "fts_array_bind",
    talk_docs,
    'find {turns: x::[{text: ~= "with"}]} return {id: .conv_id, n: x.turn}',
    {"id": "id", "n": "array_join(n, ',')"},
    _placed("conversations", "conv_id AS id, turn", "text", "with") + " SELECT id, string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) AS n FROM t WHERE len(p0) > 0 GROUP BY 1",
)

# Scores
_WEIGHTS = r"""WITH w AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part),
k AS (SELECT count(*) AS k FROM (SELECT DISTINCT p_partkey, word FROM w)),
c AS (SELECT count(*) FILTER (word = 'red') AS red, count(*) FILTER (word = 'plate') AS plate FROM w),
f AS (SELECT 1 + ln(k / (red + 1)) AS a, 1 + ln(k / (plate + 1)) AS b FROM k, c),
d AS (SELECT p_partkey, count(*) AS n, count(*) FILTER (word = 'red') AS red, count(*) FILTER (word = 'plate') AS plate FROM w GROUP BY 1),
s AS (SELECT p_partkey AS id, CASE WHEN red > 0 THEN a * a * sqrt(red) / sqrt(n) ELSE 0 END AS x, CASE WHEN plate > 0 THEN b * b * sqrt(plate) / sqrt(n) ELSE 0 END AS y, (red > 0)::INT + (plate > 0)::INT AS m, 1 / (a * a + b * b) AS norm FROM d, f WHERE red + plate > 0)
"""
_EITHER = 'find {p_name: ~="red" || p_name: ~="plate"} '
_add("score_tfidf", _PART, _EITHER + "return {id: .p_partkey, s: score()}", {"id": "id", "s": "round(s, 4)"}, _WEIGHTS + "SELECT id, round(norm * (x + y) * m / 2, 4) AS s FROM s")
_add("score_boost", _PART, 'find {p_name: ~="red"^2 || p_name: ~="plate"} return {id: .p_partkey, s: score()}', {"id": "id", "s": "round(s, 4)"}, _WEIGHTS + "SELECT id, round(norm * (2 * x + y) * m / 2, 4) AS s FROM s")
_add_whole(
    "order_score",
    _PART,
    _EITHER + "order score() desc, .p_retailprice desc return {id: .p_partkey, s: score()}",
    {"id": "id", "s": "round(s, 4)"},
    _WEIGHTS + "SELECT s.id, round(norm * (x + y) * m / 2, 4) AS s, row_number() OVER (ORDER BY round(norm * (x + y) * m / 2, 4) DESC, p_retailprice DESC, s.id DESC) AS rank FROM s JOIN part ON p_partkey = s.id",
)
_add("score_binary", _PART, "find {p_size: >= 35 || p_size: == 50} return {id: .p_partkey, s: score()}", {"id": "id", "s": "round(s, 5)"}, "SELECT p_partkey AS id, CASE WHEN p_size = 50 THEN 1.0 ELSE 0.25 END::DOUBLE AS s FROM part WHERE p_size >= 35")

# Geometry
_add(
    "geo_bbox",
    point_docs,
    "find {geometry: && [-0.1, -0.1, 0.1, 0.1]}",
    _ID,
    "SELECT vec_id AS id FROM embeddings WHERE embedding[1]::DOUBLE BETWEEN -0.1 AND 0.1 AND embedding[2]::DOUBLE BETWEEN -0.1 AND 0.1",
)


def _edges(w: str, s: str, e: str, n: str) -> str:
    """Whether the box of a shape, given its least and largest coordinates, meets the box of the query."""
    return f"{w} <= 0.1 AND {e} >= -0.05 AND {s} <= 0.1 AND {n} >= -0.05"


_X, _Y = [f"embedding[{k}]::DOUBLE" for k in (1, 3, 5)], [f"embedding[{k}]::DOUBLE" for k in (2, 4, 6)]
_SHAPE = _edges(f"least({', '.join(_X)})", f"least({', '.join(_Y)})", f"greatest({', '.join(_X)})", f"greatest({', '.join(_Y)})")


def shape_docs(kind: str) -> Callable[[SparkSession, str], Collection]:
    """Vectors as lines or triangles of their first three points."""

    def build(spark: SparkSession, sf_dir: str) -> Collection:
        points = [F.array(*(F.col("embedding")[k + i].cast("double") for i in range(2))) for k in (0, 2, 4)]
        coordinates = F.array(*points) if kind == "LineString" else F.array(F.array(*points, points[0]))
        shape = F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates"))
        return Collection.typed(_table(spark, sf_dir, "embeddings").select("vec_id", "label", shape.alias("shape"), F.array(shape).alias("shapes")), "vec_id")

    return build


_add("geo_lines", shape_docs("LineString"), "find {shape: && [-0.05, -0.05, 0.1, 0.1]}", _ID, f"SELECT vec_id AS id FROM embeddings WHERE {_SHAPE}")
_add("geo_polygons", shape_docs("Polygon"), "find {shape: && [-0.05, -0.05, 0.1, 0.1]}", _ID, f"SELECT vec_id AS id FROM embeddings WHERE {_SHAPE}")
_add("geo_bind", shape_docs("Polygon"), "find {shapes: x::[&& [-0.05, -0.05, 0.1, 0.1]]} return {id: .vec_id, kind: x.type}", {"id": "id", "kind": "to_json(kind)"}, f"SELECT vec_id AS id, '[\"Polygon\"]' AS kind FROM embeddings WHERE {_SHAPE}")


# Store
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations with region 1 put in again under a new name, those with region 2 taken out, and a new one added."""
    nation = _table(spark, sf_dir, "nation")
    text = F.to_json(F.struct(F.col("n_nationkey").cast("string").alias("_id"), "n_name", "n_regionkey"))
    base = nation.select(F.col("n_nationkey").cast("bigint").alias("seq"), F.col("n_nationkey").cast("string").alias("_id"), text.alias("text"))
    again = nation.where("n_regionkey = 1").select(F.col("n_nationkey").cast("string").alias("_id"), F.to_json(F.struct(F.col("n_nationkey").cast("string").alias("_id"), F.concat(F.lit("new "), "n_name").alias("n_name"), "n_regionkey")).alias("text"))
    fresh = spark.range(1).select(F.lit("1000").alias("_id"), F.lit('{"_id":"1000","n_name":"NOWHERE","n_regionkey":9}').alias("text"))
    merged = merge_changes(base, again.union(fresh), nation.where("n_regionkey = 2").select(F.col("n_nationkey").cast("string").alias("_id")), 1000)
    docs = Collection.json(merged.select("seq", "_id", F.parse_json("text").alias("doc")))
    return run(docs, "find {} return {id: ._id, name: .n_name, r: .n_regionkey}").selectExpr("CAST(CAST(id AS STRING) AS BIGINT) AS id", "CAST(name AS STRING) AS name", "CAST(r AS BIGINT) AS r")


QUERIES["upsert"] = upsert
ORACLES["upsert"] = (
    "SELECT CAST(n_nationkey AS BIGINT) AS id, CASE WHEN n_regionkey = 1 THEN 'new ' ELSE '' END || n_name AS name, CAST(n_regionkey AS BIGINT) AS r FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT 1000, 'NOWHERE', 9"
)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(_ORDERS(spark, sf_dir), 'find {o_orderstatus: == "F", o_totalprice: > 100000} order .o_totalprice desc return {id: ._id, p: .o_totalprice} limit 10')
