"""Aggregates of the return clause. Each builds a column to aggregate by row, and an aggregate over it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F, types as T

from ..functions.collation import collation_key, flat_numbers, flat_values, greatest_flat, least_flat
from ..plans.nodes import Path
from ..sources.values import NUMERIC, Dynamic, Missing, Typed, Value
from .returning import as_json, literal


@dataclass
class Part:
    """``rows``: columns to add to the rows; ``result``: the aggregate, or None for a group key; ``sort``: its order."""

    rows: dict[str, Column]
    result: Column | None
    key: str | None = None
    sort: Column | None = None


def _depth(kind: T.DataType) -> tuple[int, T.DataType]:
    depth = 0
    while isinstance(kind, T.ArrayType):
        depth, kind = depth + 1, kind.elementType
    return depth, kind


def _flat(v: Typed) -> Column:
    """All values inside a typed array; a value that is no array alone."""
    depth, _ = _depth(v.type)
    column = v.column
    for _ in range(depth - 1):
        column = F.flatten(column)
    return F.coalesce(column, F.array(F.lit(None))) if depth else F.array(column)


def _by_seq(value: str) -> Column:
    """Values of the group, latest document first."""
    return F.transform(F.sort_array(F.collect_list(F.struct(F.col("__seq"), F.col(value))), asc=False), lambda s: s[value])


def _joined(values: Column, separator: str) -> Column:
    """Strings joined; if the first value isn't one, the text begins with the separator."""
    strings = F.filter(values, lambda s: s.isNotNull())
    text = F.array_join(strings, separator)
    return F.when(F.get(values, F.lit(0)).isNull() & (F.size(strings) > 0), F.concat(F.lit(separator), text)).otherwise(text)


def build(path: Path, v: Value, name: str, variant: bool) -> Part:
    """The part of one aggregate; ``variant`` sources aggregate JSON text."""
    fun = path.aggregate
    if fun == "count":
        return Part({}, F.count(F.lit(1)))
    return _json_part(path, v, name) if variant else _typed_part(path, v, name)


def _typed_part(path: Path, v: Value, name: str) -> Part:
    fun, a, b = path.aggregate, f"__{name}a", f"__{name}b"
    if isinstance(v, Missing):
        default = path.default
        kind = T.StringType() if default is None or isinstance(default, str) else T.BooleanType() if isinstance(default, bool) else T.DoubleType()
        v = Typed(F.lit(default).cast(kind), kind)
    elif path.default is not None and not isinstance(v.type, T.ArrayType):
        v = Typed(F.coalesce(v.column, literal(path.default, False).cast(v.type)), v.type)
    depth, kind = _depth(v.type)
    number = isinstance(kind, NUMERIC)
    if fun == "group":
        return Part({a: v.column}, None, a, F.col(a).desc() if path.descending else F.col(a).asc())
    if fun in ("sum", "avg"):
        flat = F.filter(_flat(v), lambda x: x.isNotNull())
        if not number:
            return Part({a: F.lit(0.0), b: F.lit(0)}, F.sum(a) if fun == "sum" else F.lit(None).cast("double"))
        total = F.aggregate(flat, F.lit(0.0), lambda s, x: s + x.cast("double")) if depth else v.column.cast("double")
        if fun == "sum":
            return Part({a: total}, F.coalesce(F.sum(a), F.lit(0.0)))
        count = F.size(flat) if depth else F.when(v.column.isNotNull(), 1).otherwise(0)
        return Part({a: total, b: count}, F.sum(a) / F.nullif(F.sum(b), F.lit(0)))
    if fun == "min":  # null is the least of values
        return Part({a: v.column}, F.when(F.count(a) == F.count(F.lit(1)), F.min(a)))
    if fun == "max":
        return Part({a: v.column}, F.max(a))
    if fun in ("min_array", "max_array"):
        flat = _flat(v)
        return Part({a: F.array_min(flat) if fun == "min_array" else F.array_max(flat)}, F.min(a) if fun == "min_array" else F.max(a))
    if fun == "concat":
        return Part({a: v.column if isinstance(v.type, T.StringType) else F.lit(None).cast("string")}, _joined(_by_seq(a), path.separator))
    if fun == "array":
        return Part({a: v.column}, _by_seq(a))
    return Part({a: _flat(v)}, F.flatten(_by_seq(a)))


def _json_part(path: Path, v: Value, name: str) -> Part:
    fun, a, b = path.aggregate, f"__{name}a", f"__{name}b"
    text = as_json(v, path.default)
    if fun == "group":
        return Part({a: text, b: collation_key(text)}, F.min(a), b, F.col(b).desc() if path.descending else F.col(b).asc())
    if fun in ("sum", "avg"):
        flat = flat_numbers(text)
        total = F.aggregate(F.col(b), F.lit(0.0), lambda s, x: s + x)
        rows = {b: flat, a: total}
        if fun == "sum":
            return Part(rows, F.sum(a))
        return Part(rows, F.sum(a) / F.nullif(F.sum(F.size(b)), F.lit(0)))
    if fun in ("min", "max"):
        return Part({a: text, b: collation_key(text)}, F.min_by(a, b) if fun == "min" else F.max_by(a, b))
    if fun in ("min_array", "max_array"):
        # Values that are there; a group without any gives an empty array.
        rows = {a: (least_flat if fun == "min_array" else greatest_flat)(text)}
        rows[b] = collation_key(F.col(a))
        own = F.when(F.col(a).isNotNull(), F.col(b))
        return Part(rows, F.coalesce(F.min_by(a, own) if fun == "min_array" else F.max_by(a, own), F.lit("[]")))
    if fun == "concat":
        string = v.string() if not isinstance(v, Missing) else None
        if isinstance(path.default, str):
            string = F.coalesce(string, F.when(v.column.isNull(), F.lit(path.default))) if string is not None else F.lit(path.default)
        return Part({a: F.lit(None).cast("string") if string is None else string}, F.to_json(_joined(_by_seq(a), path.separator).cast("variant")))
    if fun == "array":
        return Part({a: text}, _array_text(_by_seq(a)))
    return Part({a: flat_values(text)}, _array_text(F.flatten(_by_seq(a))))


def _array_text(values: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(values, ","), F.lit("]"))


def bound_value(array: Column, make, path: Path, variant: bool) -> Value:
    """What a path gives for the bound elements: an array, with the default for a missing value or where nothing is bound."""
    from .returning import walk

    made: list[Value] = []

    def each(e: Column) -> Column:
        inner = walk(make(e), path.steps)
        made.append(inner)
        if isinstance(inner, Dynamic):
            return F.coalesce(inner.column, literal(path.default, True))
        if isinstance(inner, Missing):
            return literal(path.default, variant)
        return inner.column if path.default is None else F.coalesce(inner.column, literal(path.default, False).cast(inner.type))

    values = F.transform(array, each)
    inner = made[-1]
    if isinstance(inner, (Dynamic, Missing)) and (variant or isinstance(inner, Dynamic)):
        values = F.when(F.size(values) > 0, values).otherwise(F.array(literal(path.default, True)))
        return Dynamic(F.to_variant_object(values))
    kind = inner.type if isinstance(inner, Typed) else T.StringType()
    values = F.when(F.size(values) > 0, values).otherwise(F.array(F.lit(None).cast(kind) if path.default is None else literal(path.default, False).cast(kind)))
    return Typed(values, T.ArrayType(kind))
