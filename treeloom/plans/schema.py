"""Typed targets: column types and validation from classes, and tables of errors."""

from __future__ import annotations

import dataclasses
import datetime
import decimal
import difflib
import inspect
import types
import typing
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeloom.plans.values import Value

_SIMPLE = {str: T.StringType(), int: T.LongType(), float: T.DoubleType(), bool: T.BooleanType(), bytes: T.BinaryType(), datetime.datetime: T.TimestampType(), datetime.date: T.DateType(), decimal.Decimal: T.DecimalType(38, 18)}


@dataclass(frozen=True)
class Target:
    """What a table's rows must look like; None as type takes any value.

    checks are conditions as columns. build, if there is one, sees each row that has
    passed so far as a dict, in Python: what it returns, an object or a mapping, gives
    the row's values, and what it raises is the row's error.
    """

    name: str
    fields: dict[str, T.DataType | None]
    required: frozenset[str] = frozenset()
    checks: dict[str, Callable[[Column], Column]] = field(default_factory=dict)
    partial: bool = False
    build: Callable[[dict], Any] | None = None

    def suggest(self, unknown: str) -> str:
        near = difflib.get_close_matches(unknown, self.fields, n=3, cutoff=0.6)
        return f"{self.name} has no field {unknown!r}" + (f"; did you mean {', '.join(near)}?" if near else "")


def table_name(table: str | type) -> str:
    if isinstance(table, str):
        return table
    return getattr(table, "__tablename__", None) or table.__name__.lower()


def _type(hint: object) -> tuple[T.DataType | None, bool]:
    """Spark type of an annotation, None for any, and whether null is allowed."""
    origin = typing.get_origin(hint)
    if origin in (typing.Required, typing.NotRequired, typing.Annotated):
        return _type(typing.get_args(hint)[0])
    if origin in (typing.Union, types.UnionType):
        args = typing.get_args(hint)
        real = [a for a in args if a is not type(None)]
        return (_type(real[0])[0] if len(real) == 1 else None), len(real) < len(args)
    if origin in (list, tuple, set):
        args = typing.get_args(hint)
        inner = _type(args[0])[0] if args else None
        return (T.ArrayType(inner) if inner is not None else None), False
    if origin is dict:
        k, v = (*typing.get_args(hint), None, None)[:2]
        vt = _type(v)[0] if v is not None else None
        return (T.MapType(T.StringType(), vt) if vt is not None else None), False
    return _SIMPLE.get(hint) if isinstance(hint, type) else None, hint is typing.Any


def target_of(table: str | type | T.StructType, *, name: str | None = None, partial: bool = False) -> Target | None:
    """The target a class, or a struct type, describes; None for a plain table name.

    A mapped class (with __table__ or __tablename__) gives columns without
    requirements, a model class its fields and which have no default, a TypedDict
    its keys, any other class its constructor's parameters. A model class with
    validators of its own also builds each row; so does a class whose
    ``__validators__`` holds conditions in Python by field.
    """
    if isinstance(table, str):
        return None
    if isinstance(table, T.StructType):
        return Target(name or "table", {f.name: f.dataType for f in table.fields}, frozenset(f.name for f in table.fields if not f.nullable), partial=partial)
    label = table_name(table)
    checks = dict(getattr(table, "__checks__", {}))
    build = _build_of(table, partial)
    hints: dict[str, object] = {}
    try:
        hints = typing.get_type_hints(table, include_extras=True)
    except (NameError, TypeError):
        hints = dict(getattr(table, "__annotations__", {}))
    hints = {k: v for k, v in hints.items() if not k.startswith("_")}
    if hasattr(table, "__table__") or hasattr(table, "__mapper__"):
        columns = [c.name for c in getattr(getattr(table, "__table__", None), "columns", [])] or list(hints)
        return Target(label, {c: _type(hints.get(c))[0] for c in columns}, frozenset(), checks, partial, build)
    if hasattr(table, "model_fields"):
        needed = frozenset(k for k, f in table.model_fields.items() if f.is_required())
    elif typing.is_typeddict(table):
        needed = frozenset()
    elif dataclasses.is_dataclass(table):
        needed = frozenset(f.name for f in dataclasses.fields(table) if f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING)
    else:
        parameters = [p for n, p in inspect.signature(table).parameters.items() if p.kind in (p.POSITIONAL_OR_KEYWORD, p.KEYWORD_ONLY)]
        hints = {p.name: hints.get(p.name, p.annotation if p.annotation is not p.empty else typing.Any) for p in parameters}
        needed = frozenset(p.name for p in parameters if p.default is p.empty)
    typed = {k: _type(h) for k, h in hints.items()}
    required = frozenset(k for k in needed if k in typed and not typed[k][1])
    return Target(label, {k: t for k, (t, _) in typed.items()}, frozenset() if partial else required, checks, partial, build)


def _build_of(table: type, partial: bool) -> Callable[[dict], Any] | None:
    conditions = dict(getattr(table, "__validators__", {}))
    if conditions:

        def check(values: dict) -> dict:
            failed = [f"{n}: check failed" for n, holds in conditions.items() if values.get(n) is not None and not holds(values[n])]
            if failed:
                raise RowError(failed)
            return values

        return check
    decorators = getattr(table, "__pydantic_decorators__", None)
    own = any(getattr(decorators, kind, None) for kind in ("validators", "field_validators", "root_validators", "model_validators"))
    return table.model_validate if own and not partial and hasattr(table, "model_validate") else None


class RowError(ValueError):
    """Several messages about one row."""

    def __init__(self, messages: list[str]):
        super().__init__("; ".join(messages))
        self.messages = messages


def _messages(error: Exception) -> list[str]:
    if isinstance(error, RowError):
        return error.messages
    listed = getattr(error, "errors", None)
    if callable(listed):
        try:
            return [f"{'.'.join(map(str, e['loc'])) or 'row'}: {e['msg']}" for e in listed()]
        except (KeyError, TypeError):
            pass
    return [f"{type(error).__name__}: {error}"]


def builder(build: Callable[[dict], Any], columns: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Runs ``build`` over the rows of Arrow batches; a batch's last column takes the messages."""

    def values_of(built: Any) -> dict:
        if isinstance(built, Mapping):
            return dict(built)
        return built.model_dump() if hasattr(built, "model_dump") else vars(built)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema, rows, messages = batch.schema, batch.select(columns).to_pylist(), []
            for row in rows:
                try:
                    built = values_of(build(dict(row)))
                    for c in columns:
                        if c in built:
                            row[c] = pa.scalar(built[c], schema.field(c).type).as_py()
                    messages.append([])
                except Exception as error:  # whatever a user's code raises belongs to the row
                    messages.append(_messages(error))
            arrays = [pa.array([r[n] for r in rows], schema.field(n).type) if n in columns else batch.column(n) for n in schema.names[:-1]]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(messages, schema.types[-1])], schema=schema)

    return run


def validated(value: Value, name: str, target: Target) -> tuple[Column, Column]:
    """The value as the target's type, null if it cannot be, and an error text or null."""
    want = target.fields.get(name)
    col, error = value.col, F.lit(None).cast("string")
    if want is not None and not isinstance(value.dtype, T.NullType) and value.dtype != want:
        source = F.trim(col) if isinstance(value.dtype, T.StringType) and not isinstance(want, T.StringType) else col
        cast = F.try_variant_get(col, "$", want.simpleString()) if value.is_variant else source.try_cast(want)
        error = F.when(col.isNotNull() & cast.isNull(), F.lit(f"{name}: not a valid {want.simpleString()}"))
        col = cast
    elif isinstance(value.dtype, T.NullType):
        col = col.cast(want or T.StringType())
    checks = [error]
    if name in target.required:
        checks.append(F.when(value.col.isNull(), F.lit(f"{name}: required")))
    if name in target.checks:
        checks.append(F.when(col.isNotNull() & ~F.coalesce(target.checks[name](col), F.lit(False)), F.lit(f"{name}: check failed")))
    return col, F.coalesce(*checks)
