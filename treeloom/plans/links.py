"""Relationships between tables as joins."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeloom.plans.tables import Table
from treeloom.plans.values import Value, comparable


class RelationshipIncompleteError(RuntimeError):
    """A child names a parent that neither its chunk nor an eager table holds."""


@dataclass(frozen=True)
class Link:
    """Many children to one parent; ``by`` maps child fields to parent fields, all of which must be equal."""

    child: str
    parent: str
    by: dict[str, str]
    attr: str
    fk: dict[str, str] = field(default_factory=dict)
    required: bool = False


@dataclass(frozen=True)
class Backlink:
    """A parent's list of children; ``by`` maps the parent's list of ids to a child field."""

    parent: str
    child: str
    attr: str
    by: dict[str, str]


def default_attr(parent: str) -> str:
    return parent.rstrip("s")


def _pairs(child: Table, parent: Table, by: dict[str, str]) -> tuple[list[Column], list[Column]]:
    left, right = [], []
    for c, p in by.items():
        cv, pv = child.value(c), parent.value(p)
        what = f"link {child.name}.{c} to {parent.name}.{p}"
        left.append(comparable(cv, pv.dtype, what))
        right.append(comparable(pv, cv.dtype, what))
    return left, right


def _chunks(child: Table, parent: Table) -> bool:
    return "__chunk" in child.frame.columns and "__chunk" in parent.frame.columns


def parent_rows(parent: Table, keys: list[Column], names: list[str], exact: bool, chunked: bool, attr: str | None) -> DataFrame:
    """The parent's keys, and its row as a struct; of parents that share a key the one that arrived last."""
    extra = [F.col("__chunk").alias("__pchunk")] if chunked else []
    row = F.struct(*(F.col(f"`{c}`") for c in parent.columns)) if attr else F.lit(True)
    order = F.col("__last") if "__last" in parent.frame.columns else F.col("__ord") if "__ord" in parent.frame.columns else F.lit(0)
    rows = parent.frame.select(*(k.alias(n) for k, n in zip(keys, names)), row.alias("__row"), order.alias("__order"), *extra)
    rows = rows.where(reduce(Column.__and__, [F.col(n).isNotNull() for n in names]))
    if exact:
        return rows.drop("__order")
    return rows.groupBy(*names, *(["__pchunk"] if chunked else [])).agg(F.max_by("__row", "__order").alias("__row"))


def bind(child: Table, parent: Table, link: Link) -> Table:
    """The child with its parent's row in ``attr`` and foreign keys filled from it; a missing parent leaves both null."""
    surrogate = [c for c in link.fk.values() if c not in parent.columns]
    if surrogate:
        ids = F.xxhash64(*(parent.value(p).col for p in link.by.values()))
        parent = Table(**{**parent.__dict__, "frame": parent.frame.withColumns({c: ids for c in surrogate}), "columns": [*surrogate, *parent.columns], "types": {**parent.types, **{c: T.LongType() for c in surrogate}}})
    left, right = _pairs(child, parent, link.by)
    names = [f"__p{i}" for i in range(len(right))]
    chunked = _chunks(child, parent)
    rows = parent_rows(parent, right, names, parent.unique_on == frozenset(link.by.values()), chunked, link.attr)
    # children without a key match nothing; a salt keeps them from meeting in one task
    nothing = reduce(Column.__or__, [k.isNull() for k in left])
    salt = F.when(nothing, F.pmod(F.xxhash64(F.lit(0), *(_hashable(child, c) for c in child.columns)), F.lit(1024)) + 1).otherwise(F.lit(0).cast("bigint"))
    frame = child.frame.withColumns({f"__c{i}": k for i, k in enumerate(left)} | {"__salt": salt})
    on = [F.col(f"__c{i}") == F.col(n) for i, n in enumerate(names)] + [F.col("__salt") == F.col("__psalt")]
    if chunked:
        on.append(F.col("__chunk") == F.col("__pchunk"))
    joined = frame.join(rows.withColumn("__psalt", F.lit(0).cast("bigint")), reduce(Column.__and__, on), "left")
    columns = [c for c in child.columns if c not in link.fk and c != link.attr]
    own = [c for c in child.frame.columns if c not in (*child.columns,)]
    fks = [F.col(f"__row.{p}").alias(c) for c, p in link.fk.items()]
    frame = joined.select(*(F.col(f"`{c}`") for c in columns), *fks, F.col("__row").alias(link.attr), *own)
    return Table(**{**child.__dict__, "frame": frame, "columns": [*columns, *link.fk, link.attr], "types": {c: frame.schema[c].dataType for c in frame.columns}})


def _hashable(table: Table, column: str) -> Column:
    col, dtype = F.col(f"`{column}`"), table.types[column]
    if isinstance(dtype, T.VariantType):
        return F.to_json(col)
    return F.lit(0) if _unhashable(dtype) else col


def _unhashable(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.MapType, T.VariantType)) or isinstance(dtype, T.ArrayType) and _unhashable(dtype.elementType) or isinstance(dtype, T.StructType) and any(_unhashable(f.dataType) for f in dtype.fields)


def bind_list(parent: Table, child: Table, back: Backlink) -> Table:
    """The parent with the children its ids name, in the order of the ids; unknown ids are skipped, no ids give an empty list."""
    (listed, of), *more = back.by.items()
    if more:
        raise ValueError("a backlink has one pair of fields")
    lv, cv = parent.value(listed), child.value(of)
    what = f"backlink {parent.name}.{listed} to {child.name}.{of}"
    if isinstance(lv.dtype, T.ArrayType):
        element = lv.dtype.elementType
        ids = F.transform(lv.col, lambda x: comparable(Value(x, element), cv.dtype, what))
        right = comparable(cv, element, what)
    elif lv.is_variant:
        as_list = F.coalesce(F.try_variant_get(lv.col, "$", "array<variant>"), F.when(lv.col.isNotNull(), F.array(lv.col)))
        ids = F.transform(as_list, lambda x: F.to_json(x))
        right = comparable(cv, lv.dtype, what)
    else:
        ids = F.when(lv.col.isNotNull(), F.array(comparable(lv, cv.dtype, what)))
        right = comparable(cv, lv.dtype, what)
    chunked = _chunks(parent, child)
    chunk = ["__chunk"] if chunked else []
    frame = parent.frame.withColumn("__ids", ids)
    frame = frame.withColumn("__list", _digest(F.col("__ids"), frame.schema["__ids"].dataType.elementType))
    rows = parent_rows(child, [right], ["__cid"], child.unique_on == frozenset([of]), chunked, back.attr)
    # one answer for each different list, however many parents have it; an id carries its list's digest, not the list
    lists = frame.where(F.size("__ids") > 0).groupBy("__list", *chunk).agg(F.any_value("__ids").alias("__ids")).select("__list", *chunk, F.posexplode("__ids").alias("__pos", "__id"))
    on = [F.col("__id") == F.col("__cid")] + ([F.col("__chunk") == F.col("__pchunk")] if chunked else [])
    found = lists.join(rows, reduce(Column.__and__, on)).groupBy("__list", *chunk).agg(F.collect_list(F.struct("__pos", "__row")).alias("__found"))
    ordered = F.array_sort("__found", lambda a, b: a["__pos"] - b["__pos"])
    answers = found.select("__list", *chunk, F.transform(ordered, lambda e: e["__row"]).alias("__rows"))
    joined = frame.join(answers, ["__list", *chunk], "left")
    empty = F.array().cast(answers.schema["__rows"].dataType)
    columns = [c for c in parent.columns if c != back.attr]
    own = [c for c in parent.frame.columns if c not in parent.columns]
    frame = joined.select(*(F.col(f"`{c}`") for c in columns), F.coalesce("__rows", empty).alias(back.attr), *own)
    return Table(**{**parent.__dict__, "frame": frame, "columns": [*columns, back.attr], "types": {c: frame.schema[c].dataType for c in frame.columns}})


def _digest(ids: Column, element: T.DataType) -> Column:
    """16 bytes that stand for a list of plain values; nulls, which name nothing, leave no trace."""
    # a comma before each value in hex, so that different lists give different texts; a timestamp's text depends on the time zone
    plain = lambda x: F.unix_micros(x) if isinstance(element, T.TimestampType) else x.cast("string")
    return F.unhex(F.left(F.sha2(F.array_join(F.transform(ids, lambda x: F.concat(F.lit(","), F.hex(plain(x)))), ""), 256), F.lit(32)))


def missing_parents(child: Table, parent: Table, by: dict[str, str]) -> DataFrame:
    """The child's rows whose keys are all given but name no parent row."""
    left, right = _pairs(child, parent, by)
    chunked = _chunks(child, parent)
    keys = parent.frame.select(*(k.alias(f"__p{i}") for i, k in enumerate(right)), *([F.col("__chunk").alias("__pchunk")] if chunked else []))
    frame = child.frame.withColumns({f"__c{i}": k for i, k in enumerate(left)})
    given = reduce(Column.__and__, [F.col(f"__c{i}").isNotNull() for i in range(len(left))])
    on = [F.col(f"__c{i}") == F.col(f"__p{i}") for i in range(len(left))] + ([F.col("__chunk") == F.col("__pchunk")] if chunked else [])
    lost = frame.where(given).join(keys, reduce(Column.__and__, on), "left_anti")
    return lost.select(*(F.col(f"`{c}`") for c in child.columns), *(F.col(f"__c{i}").cast("string").alias(f"missing_{c}") for i, c in enumerate(by)))
