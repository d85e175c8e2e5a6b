"""Navigation steps as chained generators over a frame of documents.

``plan_levels`` needs types only, so transforms can be evaluated first; what they
use then decides how rows are generated. Positions cost nested-column pruning, so
a list is exploded without them unless an index or the arrival order is asked for.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeloom.plans.scope import Level
from treeloom.plans.values import Segment, Value, common_type, convert, known, resolve

#: The steps of an emission: ("goto", segments), ("each", mode) with mode auto or items, ("single", segments).
Step = tuple[str, object]


@dataclass(frozen=True)
class Hop:
    """How a level is made: a path below the level before, then a way to iterate it."""

    path: tuple[Segment, ...]
    mode: str  # auto, items or single


def hops(steps: list[Step]) -> tuple[tuple[Segment, ...], list[Hop]]:
    """The path to the base container, and one hop a level."""
    path: list[Segment] = []
    base: tuple[Segment, ...] | None = None
    out: list[Hop] = []
    for kind, arg in steps:
        if kind == "goto":
            path += arg  # type: ignore[operator]
            continue
        if base is None:
            base, path = tuple(path), []
        out.append(Hop(tuple(path), str(arg)))
        path = []
    if base is None:
        return tuple(path), [Hop((), "single")]
    if path:
        out.append(Hop(tuple(path), "single"))
    return base, out


def _element(d: T.DataType, mode: str) -> tuple[T.DataType, bool, bool]:
    """Element type, keyed, indexed of what iterating a value yields."""
    if isinstance(d, T.MapType):
        return d.valueType, True, False
    if isinstance(d, T.StructType):
        return common_type([f.dataType for f in d.fields]), True, False
    if isinstance(d, T.VariantType):
        return d, True, mode == "auto"
    if mode == "items":
        return T.NullType(), False, False
    if isinstance(d, T.ArrayType):
        return d.elementType, False, True
    return d, False, False


def plan_levels(root: T.DataType, steps: list[Step]) -> list[Level]:
    """Levels of the scope: the base container, then one for each hop."""
    base, later = hops(steps)
    dtype = resolve(Value(F.lit(None), root), list(base), digits_index=True).dtype
    levels = [Level(0, dtype)]
    for n, hop in enumerate(later, 1):
        dtype = resolve(Value(F.lit(None), dtype), list(hop.path), digits_index=True).dtype
        keyed = indexed = False
        if hop.mode != "single":
            dtype, keyed, indexed = _element(dtype, hop.mode)
        levels.append(Level(n, dtype, keyed, indexed, 0 if hop.mode == "single" and not hop.path and n == 1 else None))
    return levels


def _entries(v: Value, mode: str) -> Column:
    """An array of (i, k, v) for containers that no plain generator covers."""
    entry = lambda i, k, x: F.struct(i.cast("int").alias("i"), k.cast("string").alias("k"), x.alias("v"))
    none = F.lit(None)
    if isinstance(v.dtype, T.StructType):
        dtype = common_type([f.dataType for f in v.dtype.fields])
        rows = [F.when(v.col.getField(f.name).isNotNull(), entry(none, F.lit(f.name), convert(Value(v.col.getField(f.name), f.dataType), dtype))) for f in v.dtype.fields]
        return F.array_compact(F.array(*rows))
    col = known(v.col)
    listed = F.try_variant_get(col, "$", "array<variant>")
    mapped = F.try_variant_get(col, "$", "map<string,variant>")
    objects = F.transform(F.map_entries(mapped), lambda e: entry(none, e["key"], known(e["value"])))
    if mode == "items":
        return F.when(mapped.isNotNull(), objects)
    lists = F.transform(listed, lambda x, i: entry(i, none, known(x)))
    return F.when(listed.isNotNull(), lists).when(mapped.isNotNull(), objects).when(col.isNotNull(), F.array(entry(none, none, col)))


def navigate(docs: DataFrame, root: T.DataType, steps: list[Step], indexes: set[int], ordered: bool) -> tuple[DataFrame, list[Column]]:
    """The frame with columns __n<l>, __k<l>, __i<l> of each level, and the positions that order its rows.

    docs has __doc, and __at if ordered. A null container gives no row, a scalar
    one row, a single level keeps its row whatever it holds.
    """
    base, later = hops(steps)
    keep = ["__doc", *(["__at"] if ordered else []), *(["__chunk"] if "__chunk" in docs.columns else [])]
    above = resolve(Value(F.col("__doc"), root), list(base), digits_index=True)
    frame = docs.select(*keep, above.col.alias("__n0"))
    columns = [*keep, "__n0"]
    value = Value(F.col("__n0"), above.dtype)
    positions: list[Column] = []
    for n, hop in enumerate(later, 1):
        here = resolve(value, list(hop.path), digits_index=True)
        node, key, index, pos = f"__n{n}", f"__k{n}", f"__i{n}", f"__p{n}"
        d = here.dtype
        if hop.mode == "single":
            if n == 1 and not hop.path:
                value = here
                continue
            frame = frame.select(*columns, here.col.alias(node))
            columns.append(node)
            value = Value(F.col(node), d)
            continue
        dtype, keyed, indexed = _element(d, hop.mode)
        counted = ordered or n in indexes
        if isinstance(d, T.MapType):
            made = F.posexplode(here.col).alias(pos, "__key", node) if counted else F.explode(here.col).alias("__key", node)
            frame = frame.select(*columns, made).withColumn(key, F.col("__key").cast("string")).drop("__key")
            columns += [key, node]
        elif isinstance(d, T.ArrayType) and hop.mode == "auto":
            made = F.posexplode(here.col).alias(pos, node) if counted else F.explode(here.col).alias(node)
            frame = frame.select(*columns, made)
            if n in indexes:
                frame = frame.withColumn(index, F.col(pos))
                columns.append(index)
            columns.append(node)
        elif isinstance(d, (T.StructType, T.VariantType)):
            made = F.posexplode(_entries(here, hop.mode)).alias(pos, "__e") if counted else F.explode(_entries(here, hop.mode)).alias("__e")
            parts = [F.col("__e.v").alias(node), F.col("__e.k").alias(key), F.col("__e.i").alias(index)]
            kept = [F.col(pos)] if counted else []
            frame = frame.select(*columns, made).select(*columns, *parts, *kept)
            columns += [node, key, index]
        else:
            none = F.array().cast(T.ArrayType(d if not isinstance(d, T.NullType) else T.StringType()))
            made = F.explode(none if hop.mode == "items" or isinstance(d, T.NullType) else F.when(here.col.isNotNull(), F.array(here.col))).alias(node)
            frame = frame.select(*columns, made)
            columns.append(node)
            counted = False
        if counted:
            positions.append(F.col(pos).cast("long"))
            columns.append(pos)
        value = Value(F.col(node), dtype)
    return frame, positions


