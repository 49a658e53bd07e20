"""A value inside a document as Spark expressions: typed (columns, structs, arrays) or dynamic (VARIANT)."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, functions as F, types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def true(column: Column) -> Column:
    """Two-valued: NULL counts as false."""
    return F.coalesce(column, F.lit(False))


class Value:
    """What the compiler asks of a value. Comparisons are false, never NULL, where the type doesn't fit."""

    def get(self, key: str) -> Value:
        raise NotImplementedError

    def index(self, at: int) -> Value:
        raise NotImplementedError

    def elements(self) -> tuple[Column, Any] | None:
        """(array column or NULL, function from an element's column to a Value); None if it can never be an array."""
        raise NotImplementedError

    def string(self) -> Column | None:
        """The string, NULL if it is none; None if it can never be one."""
        raise NotImplementedError

    def number(self) -> Column | None:
        raise NotImplementedError

    def equals(self, literal: Any) -> Column:
        if literal is None:
            return self.is_null()
        if isinstance(literal, bool):
            column = self.boolean()
        elif isinstance(literal, str):
            column = self.string()
        else:
            column = self.number()
        return F.lit(False) if column is None else true(column == F.lit(literal))


@dataclass
class Missing(Value):
    """Nothing is there."""

    def get(self, key: str) -> Value:
        return self

    def index(self, at: int) -> Value:
        return self

    def elements(self):
        return None

    def string(self):
        return None

    number = boolean = string

    def is_null(self) -> Column:
        return F.lit(False)

    @property
    def column(self) -> Column:
        return F.lit(None)


@dataclass
class Typed(Value):
    """A column of a known type; the type is checked while compiling, so that plain comparisons reach the scan.

    SQL NULL counts as JSON null in predicates, and as missing where a default is given.
    """

    column: Column
    type: T.DataType

    def get(self, key: str) -> Value:
        if isinstance(self.type, T.StructType) and key in self.type.names:
            return Typed(self.column.getField(key), self.type[key].dataType)
        if isinstance(self.type, T.MapType) and isinstance(self.type.keyType, T.StringType):
            return Typed(F.try_element_at(self.column, F.lit(key)), self.type.valueType)
        if isinstance(self.type, T.VariantType):
            return Dynamic(self.column).get(key)
        return Missing()

    def index(self, at: int) -> Value:
        if isinstance(self.type, T.ArrayType):
            return Typed(F.get(self.column, F.lit(at)), self.type.elementType)
        return Dynamic(self.column).index(at) if isinstance(self.type, T.VariantType) else Missing()

    def elements(self):
        if isinstance(self.type, T.ArrayType):
            inner = self.type.elementType
            return self.column, lambda c: Typed(c, inner)
        return Dynamic(self.column).elements() if isinstance(self.type, T.VariantType) else None

    def string(self) -> Column | None:
        if isinstance(self.type, (T.StringType, T.CharType, T.VarcharType)):
            return self.column
        return Dynamic(self.column).string() if isinstance(self.type, T.VariantType) else None

    def number(self) -> Column | None:
        if isinstance(self.type, NUMERIC):
            return self.column
        return Dynamic(self.column).number() if isinstance(self.type, T.VariantType) else None

    def boolean(self) -> Column | None:
        if isinstance(self.type, T.BooleanType):
            return self.column
        return Dynamic(self.column).boolean() if isinstance(self.type, T.VariantType) else None

    def is_null(self) -> Column:
        return Dynamic(self.column).is_null() if isinstance(self.type, T.VariantType) else self.column.isNull()


def _step(key: str) -> str:
    quote = "'" if "'" not in key else '"'
    return f"$[{quote}{key}{quote}]"


@dataclass
class Dynamic(Value):
    """A VARIANT. SQL NULL is a missing value, variant null the JSON null. Reads never convert between types."""

    column: Column

    def get(self, key: str) -> Value:
        return Dynamic(F.try_variant_get(self.column, _step(key), "variant"))

    def index(self, at: int) -> Value:
        return Dynamic(F.try_variant_get(self.column, f"$[{at}]", "variant"))

    def _kind(self) -> Column:
        return F.schema_of_variant(self.column)

    def elements(self):
        return F.when(F.startswith(self._kind(), F.lit("ARRAY<")), F.try_variant_get(self.column, "$", "array<variant>")), Dynamic

    def string(self) -> Column:
        return F.when(self._kind() == "STRING", F.try_variant_get(self.column, "$", "string"))

    def number(self) -> Column:
        kind = self._kind()
        return F.when(kind.isin("BIGINT", "DOUBLE", "FLOAT") | F.startswith(kind, F.lit("DECIMAL")), F.try_variant_get(self.column, "$", "double"))

    def boolean(self) -> Column:
        return F.when(self._kind() == "BOOLEAN", F.try_variant_get(self.column, "$", "boolean"))

    def is_null(self) -> Column:
        return true(F.is_variant_null(self.column))
