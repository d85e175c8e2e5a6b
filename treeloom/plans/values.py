"""Typed column expressions and null-safe access into documents."""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Segment = str | int
NULL = T.NullType()
VARIANT = T.VariantType()
_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATS = (T.FloatType, T.DoubleType)


@dataclass(frozen=True)
class Value:
    """A column and its type as far as the plan knows it (``NullType`` for a value that is always null)."""

    col: Column
    dtype: T.DataType

    @property
    def is_variant(self) -> bool:
        return isinstance(self.dtype, T.VariantType)


def null() -> Value:
    return Value(F.lit(None), NULL)


def as_value(x: Any) -> Value:
    """A Python constant, column or value as a value."""
    if isinstance(x, Value):
        return x
    if isinstance(x, Column):
        return Value(x, T.StringType())
    if x is None:
        return null()
    if isinstance(x, bool):
        return Value(F.lit(x), T.BooleanType())
    if isinstance(x, int):
        return Value(F.lit(x).cast("long"), T.LongType()) if -(2**63) <= x < 2**63 else Value(F.lit(str(x)).cast("decimal(38,0)"), T.DecimalType(38, 0))
    if isinstance(x, float):
        return Value(F.lit(x), T.DoubleType())
    if isinstance(x, str):
        return Value(F.lit(x), T.StringType())
    if isinstance(x, (dict, list, tuple)):
        return Value(F.parse_json(F.lit(json.dumps(x))), VARIANT)
    return Value(F.lit(x), T._infer_type(x))


def known(variant: Column) -> Column:
    """A variant with JSON null turned into null: both are an absent value here."""
    return F.when(~F.is_variant_null(variant), variant)


def _step(value: Value, seg: Segment, digits_index: bool) -> Value:
    d = value.dtype
    if isinstance(d, T.StructType):
        if isinstance(seg, str) and seg in d.fieldNames():
            return Value(value.col.getField(seg), d[seg].dataType)
        return null()
    if isinstance(d, T.MapType):
        if isinstance(d.keyType, T.StringType) and isinstance(seg, str):
            return Value(F.try_element_at(value.col, F.lit(seg)), d.valueType)
        if isinstance(d.keyType, _INTEGERS) and isinstance(seg, int):
            return Value(F.try_element_at(value.col, F.lit(seg).cast(d.keyType)), d.valueType)
        return null()
    if isinstance(seg, str) and digits_index and seg.isdigit() and isinstance(d, T.ArrayType):
        seg = int(seg)
    if isinstance(d, T.ArrayType):
        if isinstance(seg, int) and seg >= 0:
            return Value(F.get(value.col, F.lit(seg)), d.elementType)
        return null()
    if isinstance(d, T.VariantType):
        if isinstance(seg, int):
            return Value(known(F.try_variant_get(value.col, f"$[{seg}]", "variant")), VARIANT) if seg >= 0 else null()
        quoted = f'$["{seg}"]' if "'" in seg else f"$['{seg}']"
        found = F.try_variant_get(value.col, quoted, "variant")
        if digits_index and seg.isdigit():
            found = F.coalesce(found, F.try_variant_get(value.col, f"$[{seg}]", "variant"))
        return Value(known(found), VARIANT)
    return null()


def resolve(value: Value, path: list[Segment], *, digits_index: bool = False) -> Value:
    """The value at a path below another; null where a part is missing, out of range or no container."""
    for seg in path:
        value = _step(value, seg, digits_index)
    return value


def text(value: Value) -> Column:
    """The value as Python's ``str`` writes it, null for null; containers as JSON, doubles in Spark's exponent form."""
    d = value.dtype
    if isinstance(d, T.NullType):
        return F.lit(None).cast("string")
    if isinstance(d, T.BooleanType):
        return F.initcap(value.col.cast("string"))
    if isinstance(d, T.VariantType):
        kind = F.schema_of_variant(value.col)
        whole = value.col.cast("string")
        number = F.when(whole.contains("."), whole).otherwise(F.concat(whole, F.lit(".0")))
        return (
            F.when(kind == "BOOLEAN", F.initcap(whole)).when(kind.startswith("DECIMAL") & (F.length(whole) <= 17), number).when(kind.rlike("^(OBJECT|ARRAY)"), F.to_json(value.col)).otherwise(whole)
        )
    if isinstance(d, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(value.col)
    return value.col.cast("string")


def comparable(value: Value, other: T.DataType, what: str) -> Column:
    """A key column comparable with one of another type by Python's rules: numbers and booleans unify, texts and numbers never do."""
    d = value.dtype
    if isinstance(d, (T.StructType, T.ArrayType, T.MapType)):
        raise TypeError(f"{what}: a list or object cannot be a key")
    if isinstance(d, T.VariantType) or isinstance(other, T.VariantType):
        return F.to_json(value.col if value.is_variant else value.col.cast("variant"))
    if isinstance(d, T.NullType) or isinstance(other, T.NullType):
        return value.col.cast("string") if isinstance(d, T.NullType) and isinstance(other, T.NullType) else value.col.cast(d if isinstance(other, T.NullType) else other)
    if isinstance(d, T.StringType) != isinstance(other, T.StringType):
        raise TypeError(f"{what}: {d.simpleString()} never equals {other.simpleString()}; apply(str, ..) or apply(int, ..) makes them alike")
    if isinstance(d, T.BooleanType) and not isinstance(other, T.BooleanType):
        return value.col.cast("int").cast(other)
    return value.col


def common_type(types: list[T.DataType]) -> T.DataType:
    """A type that holds all: numbers widen, text and anything else meet in VARIANT."""
    real = [t for t in types if not isinstance(t, T.NullType)]
    if not real:
        return NULL
    first = real[0]
    if all(t == first for t in real):
        return first
    if all(isinstance(t, _INTEGERS) for t in real):
        return T.LongType()
    if all(isinstance(t, (*_INTEGERS, *_FLOATS)) for t in real):
        return T.DoubleType()
    if all(isinstance(t, (*_INTEGERS, T.DecimalType)) for t in real):
        return T.DecimalType(38, max((t.scale for t in real if isinstance(t, T.DecimalType)), default=0))
    return VARIANT


def convert(value: Value, dtype: T.DataType) -> Column:
    if value.dtype == dtype:
        return value.col
    if isinstance(dtype, T.VariantType) and isinstance(value.dtype, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_variant_object(value.col)
    return value.col.cast("string" if isinstance(dtype, T.NullType) else dtype)
