"""Bounding boxes of GeoJSON geometries."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, functions as F, types as T

from ..sources.values import Missing, Typed, Value, true

GEOMETRIES = ("Point", "MultiPoint", "LineString", "MultiLineString", "Polygon", "MultiPolygon")
_DEPTH = 4


def box_of(value: Any) -> tuple[float, float, float, float] | None:
    """(west, south, east, north) of a geometry object, None if it is none."""
    if not (isinstance(value, dict) and value.get("type") in GEOMETRIES and isinstance(value.get("coordinates"), list)):
        return None
    xs: list[float] = []
    ys: list[float] = []

    def walk(c: Any) -> None:
        if isinstance(c, list):
            if len(c) >= 2 and all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in c[:2]):
                xs.append(float(c[0]))
                ys.append(float(c[1]))
            else:
                for x in c:
                    walk(x)

    walk(value["coordinates"])
    return (min(xs), min(ys), max(xs), max(ys)) if xs else None


def overlaps(value: Value, west: float, south: float, east: float, north: float) -> Column:
    """Whether the geometry's box and the given one have a point in common; false for anything but a geometry."""
    kind, coordinates = value.get("type"), value.get("coordinates")
    name = kind.string()
    if name is None or isinstance(coordinates, Missing):
        return F.lit(False)
    if isinstance(coordinates, Typed) and not isinstance(coordinates.type, T.VariantType):
        depth, kind_ = 0, coordinates.type
        while isinstance(kind_, T.ArrayType):
            depth, kind_ = depth + 1, kind_.elementType
        if not depth:
            return F.lit(False)
        points = coordinates.column
        for _ in range(depth - 2):
            points = F.flatten(points)
        points = F.array(points) if depth == 1 else points
        x, y = (F.transform(points, _axis(k)) for k in (0, 1))
    else:
        column = coordinates.column
        # How deep the positions lie decides the cast.
        kind_ = F.schema_of_variant(column)
        points = F.coalesce(*(F.when(F.startswith(kind_, F.lit("ARRAY<" * d)), _flat(F.try_variant_get(column, "$", "array<" * d + "double" + ">" * d), d)) for d in range(_DEPTH, 0, -1)))
        x, y = (F.transform(points, _axis(k)) for k in (0, 1))
    inside = (F.array_min(x) <= east) & (F.array_max(x) >= west) & (F.array_min(y) <= north) & (F.array_max(y) >= south)
    return true(name.isin(*GEOMETRIES) & inside)


def _axis(k: int):
    return lambda point: F.get(point, F.lit(k)).cast("double")


def _flat(column: Column, depth: int) -> Column:
    for _ in range(depth - 2):
        column = F.flatten(column)
    return F.array(column) if depth == 1 else column


