"""Orders of whole tables, held against their SQL row by row, with the place of each row."""

import pytest

from veldra.queries import ORACLES, QUERIES

NAMES = ["order_asc", "order_desc", "order_multi", "order_default", "order_score", "collation_order"]


@pytest.fixture(scope="module")
def sql(sf):
    duckdb = pytest.importorskip("duckdb")
    base = duckdb.connect()
    for name in ("orders", "lineitem", "part", "events"):
        base.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return base


@pytest.mark.parametrize("name", NAMES)
def test_whole_order(spark, sf, sql, name):
    want = sql.execute(ORACLES[name]).fetchall()
    got = [tuple(r) for r in QUERIES[name](spark, sf).collect()]
    assert len(got) == len(want) and sorted(r[-1] for r in got) == list(range(1, len(got) + 1))
    assert {(r[0], r[-1]) for r in got} == {(r[0], r[-1]) for r in want}


def test_every_type_is_ordered(spark, sf):
    rank = {r.id: r.rank for r in QUERIES["collation_order"](spark, sf).collect()}
    assert {k % 7 for k in rank} == set(range(7))
    kinds = [k % 7 or 1 for k in sorted(rank, key=rank.get)]
    assert kinds == sorted(kinds, reverse=True)


def test_limit_order(spark, sf, sql):
    assert [tuple(r) for r in QUERIES["limit_order"](spark, sf).collect()] == sql.execute(ORACLES["limit_order"]).fetchall()


def test_places_over_partitions(spark):
    from veldra.queries import _ranked

    rows = spark.range(0, 1000, 1, 7).where("id % 3 = 0 AND (id < 200 OR id > 600)")  # some partitions are empty
    want = [k for k in range(1000) if k % 3 == 0 and (k < 200 or k > 600)]
    ranked = _ranked(rows)
    assert [(r.id, r.rank) for r in ranked.collect()] == [(k, n) for n, k in enumerate(want, 1)]
    assert dict(ranked.where("rank > 100").union(ranked.where("rank <= 100")).coalesce(2).collect()) == {k: n for n, k in enumerate(want, 1)}
    assert _ranked(rows.where("id < 0")).collect() == []


@pytest.mark.parametrize("name, order", [("mixed_docs", ".v desc"), ("_PART", "score() desc"), ("_ORDERS", ".o_totalprice default=1")])
def test_keys_are_columns_before_the_sort(spark, sf, name, order):
    """A sort evaluates an expression at every comparison."""
    from veldra import queries
    from veldra.plans.engine import run

    find = {"mixed_docs": "{n: >= 0}", "_PART": '{p_name: ~= "red"}', "_ORDERS": "{o_totalprice: > 0}"}[name]
    plan = run(getattr(queries, name)(spark, sf), f"find {find} order {order} return {{s: .x}}")._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort [__key0#" in plan


def test_ranks_are_made_without_python(spark, sf):
    assert "monotonically_increasing_id" in QUERIES["order_asc"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
