"""JSON values: order across types, flattening, rendering.

Order: null < false < true < number < string < array < object. Arrays compare element by element, then by length;
objects by their sorted (key, value) pairs.
"""

from __future__ import annotations

import json
import struct
from typing import Any

import pandas as pd
from pyspark.sql import Column, functions as F, types as T


def key(value: Any) -> bytes:
    """Bytes that compare as the values do."""
    if value is None:
        return b"\x01"
    if value is False:
        return b"\x02"
    if value is True:
        return b"\x03"
    if isinstance(value, (int, float)):
        (bits,) = struct.unpack(">Q", struct.pack(">d", float(value) + 0.0))
        return b"\x04" + struct.pack(">Q", bits ^ (0xFFFFFFFFFFFFFFFF if bits >> 63 else 1 << 63))
    if isinstance(value, str):
        return b"\x05" + value.encode("utf-8", "surrogatepass").replace(b"\x00", b"\x00\xff") + b"\x00\x00"
    if isinstance(value, list):
        return b"\x06" + b"".join(map(key, value)) + b"\x00"
    return b"\x07" + b"".join(key(k) + key(v) for k, v in sorted(value.items(), key=lambda kv: kv[0].encode("utf-8", "surrogatepass"))) + b"\x00"


def flatten(value: Any) -> list[Any]:
    """The values inside arrays, at any depth; a value that is no array is itself."""
    return [x for e in value for x in flatten(e)] if isinstance(value, list) else [value]


def numbers(value: Any) -> list[float]:
    return [float(x) for x in flatten(value) if isinstance(x, (int, float)) and not isinstance(x, bool)]


def dumps(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _each(function, series: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else function(json.loads(x)) for x in series], dtype=object)


@F.pandas_udf(T.BinaryType())
def _nested_key(values: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else key(json.loads(x)) for x in values], dtype=object)


def collation_key(text: Column) -> Column:
    """A struct that sorts JSON texts as ``key`` does; SQL NULL (missing) sorts as JSON null does.

    Scalars are told apart and compared by Spark; Python sees arrays and objects only.
    """
    first = F.substring(text, 1, 1)
    kind = F.when(text.isNull() | (first == "n"), 1).when(first == "f", 2).when(first == "t", 3).when(first == '"', 5).when(first == "[", 6).when(first == "{", 7).otherwise(4)
    number = F.when(kind == 4, text.cast("double") + 0.0)
    string = F.when(kind == 5, F.try_variant_get(F.parse_json(F.when(kind == 5, text)), "$", "string"))
    return F.struct(kind.alias("kind"), number.alias("number"), string.alias("string"), _nested_key(F.when(kind >= 6, text)).alias("nested"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def flat_values(values: pd.Series) -> pd.Series:
    return _each(lambda v: [dumps(x) for x in flatten(v)], values)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def flat_numbers(values: pd.Series) -> pd.Series:
    return _each(numbers, values)


@F.pandas_udf(T.StringType())
def least_flat(values: pd.Series) -> pd.Series:
    """Least of the values inside arrays, as JSON; NULL where there is none."""
    return _each(lambda v: dumps(min(x, key=key)) if (x := flatten(v)) else None, values)


@F.pandas_udf(T.StringType())
def greatest_flat(values: pd.Series) -> pd.Series:
    return _each(lambda v: dumps(max(x, key=key)) if (x := flatten(v)) else None, values)


def number_text(value: float) -> str:
    """Shortest decimal text of a number, without exponent; whole numbers without a point."""
    from decimal import Decimal

    value = float(value)
    if value == int(value) if abs(value) < 1e300 else False:
        return format(Decimal(value), "f")
    return format(Decimal(repr(value)), "f")


def render(value: Any, indent: str = "", newline: str = "", space: str = "", depth: int = 0) -> str:
    """JSON text of a value, compact or pretty; only quotes and backslashes are escaped."""
    if value is None:
        return "null"
    if value is True:
        return "true"
    if value is False:
        return "false"
    if isinstance(value, (int, float)):
        return number_text(value)
    if isinstance(value, str):
        return '"' + value.replace("\\", "\\\\").replace('"', '\\"') + '"'
    inner, outer = newline + indent * (depth + 1), newline + indent * depth
    if isinstance(value, list):
        parts = [render(x, indent, newline, space, depth + 1) for x in value]
        return "[" + ",".join(inner + p for p in parts) + (outer if parts else "") + "]"
    parts = [f"{render(k)}:{space}{render(v, indent, newline, space, depth + 1)}" for k, v in value.items()]
    return "{" + ",".join(inner + p for p in parts) + (outer if parts else "") + "}"
