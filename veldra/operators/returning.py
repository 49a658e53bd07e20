"""The return clause: paths into documents and bound elements, as columns."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, functions as F, types as T

from ..functions.collation import dumps
from ..sources.values import Dynamic, Missing, Typed, Value

Steps = tuple[str | int | None, ...]


def walk(v: Value, steps: Steps) -> Value:
    """The value at a path. A step None visits all elements and keeps those that have the rest of the path."""
    for k, step in enumerate(steps):
        if isinstance(step, str):
            v = v.get(step)
        elif isinstance(step, int):
            v = v.index(step)
        else:
            found = v.elements()
            if found is None:
                return Missing()
            return gather(*found, steps[k + 1 :])
    return v


def gather(array: Column, make, steps: Steps) -> Value:
    """The values at a path in each element of an array, where there are any."""
    made: list[Value] = []

    def each(e: Column) -> Column:
        made.append(walk(make(e), steps))
        return made[-1].column

    column = F.filter(F.transform(array, each), lambda x: x.isNotNull())
    column = F.when(F.size(column) > 0, column)
    inner = made[-1]
    if isinstance(inner, Missing):
        return inner
    if isinstance(inner, Dynamic):
        return Dynamic(F.to_variant_object(column))
    return Typed(column, T.ArrayType(inner.type))


def literal(value: Any, variant: bool) -> Column:
    if variant or isinstance(value, (list, dict)):
        return F.parse_json(F.lit(dumps(value)))
    return F.lit(value)


def as_json(v: Value, default: Any = None) -> Column:
    """The value as JSON text; missing values become the default."""
    if isinstance(v, Missing):
        return F.lit(dumps(default))
    if isinstance(v, Dynamic) or isinstance(v.type, T.VariantType):
        text = F.to_json(v.column)
    elif isinstance(v.type, (T.StructType, T.MapType, T.ArrayType)):
        text = F.to_json(F.to_variant_object(v.column))
    else:
        text = F.to_json(v.column.cast("variant")) if not isinstance(v.type, (T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType)) else F.to_json(v.column.cast("string").cast("variant"))
    return F.coalesce(text, F.lit(dumps(default)))


def or_default(v: Value, default: Any, variant: bool) -> Column:
    """The value as a column; missing becomes the default (NULL where none is given)."""
    if isinstance(v, Missing):
        return F.lit(None).cast("string") if default is None and not variant else literal(default, variant)
    if default is None and not variant:
        return v.column
    if isinstance(v, Dynamic):
        return F.coalesce(v.column, literal(default, True))
    return F.coalesce(v.column, literal(default, False).cast(v.type) if not isinstance(default, (list, dict)) else F.from_json(F.lit(dumps(default)), v.type))
