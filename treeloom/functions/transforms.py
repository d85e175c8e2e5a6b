"""Column-building transforms. Each takes a :class:`Scope` and returns a value, column or constant."""

from __future__ import annotations

import functools
import inspect
import json
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeloom.plans.scope import Scope, Transform
from treeloom.plans.values import Value, as_value, common_type, convert, null, resolve, text

__all__ = ["apply", "coalesce", "concat", "format_id", "get", "get_from_parent", "get_from_root", "index", "key", "len_of", "literal", "lookup", "node", "parent_index", "parent_key", "transform"]


def evaluate(t: Any, scope: Scope) -> Value:
    """The value of a transform, or of a constant in its place."""
    return as_value(t(scope) if callable(t) else t)


def parse_path(path: str | int | list) -> list[str | int]:
    """Segments of a dotted path, all-digit ones as positions; a list is taken as it is."""
    if isinstance(path, str):
        return [int(p) if p.isdigit() else p for p in path.split(".") if p]
    return [path] if isinstance(path, int) else list(path)


def transform(func: Callable[..., Any]) -> Callable[..., Transform]:
    """Make a transform factory of a function whose first parameter is ``ctx``; the others are bound when it is called."""
    parameters = list(inspect.signature(func).parameters)
    if not parameters or parameters[0] != "ctx":
        raise ValueError("the first parameter of a @transform function must be called 'ctx'")

    @functools.wraps(func)
    def factory(*args: Any, **kwargs: Any) -> Transform:
        return lambda ctx: func(ctx, *args, **kwargs)

    return factory


@transform
def get(ctx: Scope, path: str | int | list = "") -> Value:
    """The value at a path below the current node."""
    return resolve(ctx.node, parse_path(path))


@transform
def get_from_root(ctx: Scope, path: str | int | list = "") -> Value:
    return resolve(ctx.root, parse_path(path))


@transform
def get_from_parent(ctx: Scope, path: str | int | list = "", depth: int = 1) -> Value:
    """The value at a path below an ancestor's node; null above the outermost container."""
    above = ctx.ancestor(depth)
    return resolve(above.node, parse_path(path)) if above else null()


@transform
def node(ctx: Scope) -> Value:
    return ctx.node


@transform
def key(ctx: Scope) -> Value:
    """The current object key, null where the level is no object."""
    return ctx.key


@transform
def index(ctx: Scope) -> Value:
    """The current list position, null where the level is no list."""
    return ctx.index


@transform
def parent_key(ctx: Scope, depth: int = 1) -> Value:
    above = ctx.ancestor(depth)
    return above.key if above else null()


@transform
def parent_index(ctx: Scope, depth: int = 1) -> Value:
    above = ctx.ancestor(depth)
    return above.index if above else null()


def literal(value: Any) -> Transform:
    """A constant; a callable is used as a transform."""
    return value if callable(value) else lambda ctx: as_value(value)


@transform
def concat(ctx: Scope, *parts: Any) -> Value:
    """The texts of all parts joined, null parts as nothing."""
    texts = [F.coalesce(text(evaluate(p, ctx)), F.lit("")) for p in parts]
    return Value(F.concat(*texts) if texts else F.lit(""), T.StringType())


@transform
def format_id(ctx: Scope, *parts: Any, sep: str = "_") -> Value:
    """The texts of the parts that are neither null nor empty, joined by ``sep``."""
    texts = [F.nullif(text(evaluate(p, ctx)), F.lit("")) for p in parts]
    return Value(F.concat_ws(sep, *texts), T.StringType())


@transform
def coalesce(ctx: Scope, *inners: Any) -> Value:
    """The first value that is not null."""
    values = [evaluate(t, ctx) for t in inners]
    dtype = common_type([v.dtype for v in values])
    if not values or isinstance(dtype, T.NullType):
        return null()
    return Value(F.coalesce(*(convert(v, dtype) for v in values)), dtype)


@transform
def len_of(ctx: Scope, inner: Any) -> Value:
    """Length of a list, object or text; null for anything else."""
    v = evaluate(inner, ctx)
    d = v.dtype
    if isinstance(d, (T.ArrayType, T.MapType)):
        size = F.when(v.col.isNotNull(), F.size(v.col))
    elif isinstance(d, T.StructType):
        size = F.when(v.col.isNotNull(), F.lit(len(d)))
    elif isinstance(d, T.StringType):
        size = F.char_length(v.col)
    elif v.is_variant:
        kind = F.schema_of_variant(v.col)
        size = (
            F.when(kind.startswith("ARRAY"), F.size(F.try_variant_get(v.col, "$", "array<variant>")))
            .when(kind.startswith("OBJECT"), F.size(F.try_variant_get(v.col, "$", "map<string,variant>")))
            .when(kind == "STRING", F.char_length(v.col.cast("string")))
        )
    else:
        return null()
    return Value(size.cast("long"), T.LongType())


_STRING_METHODS = {str.upper: F.upper, str.lower: F.lower, str.strip: lambda c: F.regexp_replace(c, r"^\s+|\s+$", ""), str.lstrip: F.ltrim, str.rstrip: F.rtrim, str.title: F.initcap}


def _native(func: Any, v: Value, on_error: str) -> Value | None:
    cast = (lambda c, t: c.try_cast(t)) if on_error == "null" else (lambda c, t: c.cast(t))
    if func is int:
        col = v.col if not isinstance(v.dtype, T.StringType) else F.trim(v.col)
        return Value(cast(col, "bigint"), T.LongType())
    if func is float:
        return Value(cast(v.col if not isinstance(v.dtype, T.StringType) else F.trim(v.col), "double"), T.DoubleType())
    if func is str:
        return Value(F.coalesce(text(v), F.lit("None")), T.StringType())
    if func is bool:
        d = v.dtype
        if isinstance(d, T.StringType):
            return Value(F.coalesce(v.col != "", F.lit(False)), T.BooleanType())
        if isinstance(d, (T.ArrayType, T.MapType)):
            return Value(F.coalesce(F.size(v.col) > 0, F.lit(False)), T.BooleanType())
        if not v.is_variant:
            return Value(F.coalesce(v.col.cast("boolean"), F.lit(False)), T.BooleanType())
    if func is len:
        return None
    for method, native in _STRING_METHODS.items():
        if func is method:
            return Value(native(v.col.cast("string")), T.StringType())
    return None


def _python(func: Callable, returns: T.DataType, from_json: bool, on_error: str) -> Callable[[Column], Column]:
    def call(x: Any) -> Any:
        if from_json and x is not None:
            x = json.loads(x)
        elif x is not None and not isinstance(x, (str, bytes, dict, list)) and hasattr(x, "item"):
            x = x.item()
        try:
            return func(x)
        except Exception:
            if on_error == "null":
                return None
            raise

    def run(s: pd.Series) -> pd.Series:
        return pd.Series([call(None if x is None or x is pd.NA or (isinstance(x, float) and x != x) else x) for x in s], dtype=object)

    return F.pandas_udf(run, returns)


def apply(func: Callable[[Any], Any], inner: Any, *, returns: str | T.DataType | None = None, on_error: str = "raise") -> Transform:
    """A Python function of an inner value.

    ``int``, ``float``, ``str``, ``bool`` and the common ``str`` methods become
    built-in expressions. A function marked by :func:`column_function` is called
    with the column. Any other runs in Arrow batches and returns ``returns``
    ("string" by default); it gets null as None. Errors end the query unless
    ``on_error="null"``.
    """
    if on_error not in ("raise", "null"):
        raise ValueError("on_error is 'raise' or 'null'")

    def run(ctx: Scope) -> Value:
        v = evaluate(inner, ctx)
        if getattr(func, "takes_column", False):
            return Value(func(v.col), T.DataType.fromDDL(returns) if isinstance(returns, str) else returns or T.StringType())
        fast = _native(func, v, on_error) if returns is None else None
        if fast is not None:
            return fast
        dtype = T.DataType.fromDDL(returns) if isinstance(returns, str) else returns or T.StringType()
        if v.is_variant:
            return Value(_python(func, dtype, True, on_error)(F.to_json(v.col)), dtype)
        col = v.col.cast("string") if isinstance(v.dtype, T.NullType) else v.col
        return Value(_python(func, dtype, False, on_error)(col), dtype)

    return run


def column_function(func: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """Mark a function of a column, for :func:`apply`."""
    func.takes_column = True  # type: ignore[attr-defined]
    return func


def lookup(index_name: str, key: Any, *, default: Any = None) -> Transform:
    """The value under a key of a named index; the default only where the key is missing."""

    def run(ctx: Scope) -> Value:
        hit, found = ctx.lookup(index_name, evaluate(key, ctx))
        other = evaluate(default, ctx)
        if isinstance(other.dtype, T.NullType):
            return found
        dtype = common_type([found.dtype, other.dtype])
        return Value(F.when(hit.col, convert(found, dtype)).otherwise(convert(other, dtype)), dtype)

    return run


