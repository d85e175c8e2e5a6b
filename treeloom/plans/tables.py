"""Emissions into one frame a table: union, keyed merge, and what links need."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeloom.functions.policies import LastWritePolicy, MergePolicy
from treeloom.functions.transforms import evaluate
from treeloom.plans.navigate import Step, navigate, plan_levels
from treeloom.plans.schema import Target, builder, validated
from treeloom.plans.scope import Scope, Usage
from treeloom.plans.values import Value, common_type, comparable, convert
from treeloom.runtime import materialize, ship


@dataclass(frozen=True)
class Field:
    """A column of a table, and how values of one key merge."""

    name: str
    transform: Any
    merge: MergePolicy | None = None


@dataclass(frozen=True)
class TempField:
    """A value for keys and links that is not part of the table."""

    name: str
    transform: Any


@dataclass
class Emission:
    table: str
    root: int
    steps: list[Step]
    fields: list[Field | TempField]
    join_on: list[str]
    target: Target | None = None
    order: int = 0


@dataclass(frozen=True)
class Root:
    """Documents of one shape: a frame with __doc, and __at where a stable order is known."""

    docs: DataFrame
    dtype: T.DataType

    def ordered(self) -> DataFrame:
        if "__at" in self.docs.columns:
            return self.docs
        return self.docs.withColumn("__at", F.monotonically_increasing_id())


@dataclass
class Table:
    """A finished table: visible columns, hidden __t_<temp> ones, and __ord if it has an order."""

    name: str
    frame: DataFrame
    columns: list[str]
    types: dict[str, T.DataType]
    keys: list[str]
    ordered: bool
    target: Target | None = None
    errors: DataFrame | None = None
    unique_on: frozenset[str] = frozenset()

    def value(self, name: str) -> Value:
        if f"__t_{name}" in self.types:
            return Value(F.col(f"__t_{name}"), self.types[f"__t_{name}"])
        if name in self.types:
            return Value(F.col(f"`{name}`"), self.types[name])
        raise ValueError(f"table {self.name} has no field {name!r}")

    def visible(self) -> DataFrame:
        return self.frame.select(*(F.col(f"`{c}`") for c in self.columns))


@dataclass
class _Part:
    """One emission's transforms as values, before its rows are made."""

    emission: Emission
    usage: Usage
    values: dict[str, Value] = field(default_factory=dict)
    temps: dict[str, Value] = field(default_factory=dict)


class TableBuilder:
    """Builds one table from its emissions."""

    def __init__(self, name: str, emissions: list[Emission], roots: list[Root], indices: dict[str, DataFrame], index_types: dict[str, T.DataType], *, in_order: bool = False, inject_id: bool = True):
        self.name, self.emissions, self.roots, self.indices, self.index_types = name, emissions, roots, indices, index_types
        self.target = next((e.target for e in emissions if e.target), None)
        self.inject_id = inject_id and self.target is None
        self.in_order = in_order
        self.policies = self._policies()

    def _policies(self) -> dict[str, MergePolicy]:
        found: dict[str, MergePolicy] = {}
        for e in self.emissions:
            for f in e.fields:
                if isinstance(f, Field) and f.merge is not None:
                    if f.name in found and type(found[f.name]) is not type(f.merge):
                        raise ValueError(f"table {self.name}: field {f.name!r} has two merge policies")
                    found[f.name] = f.merge
        return found

    def _part(self, e: Emission) -> _Part:
        root = self.roots[e.root]
        part = _Part(e, Usage())
        scope = Scope(tuple(plan_levels(root.dtype, e.steps)), root.dtype, part.usage, self.index_types)
        for f in e.fields:
            value = evaluate(f.transform, scope)
            (part.values if isinstance(f, Field) else part.temps)[f.name] = value
        missing = [k for k in e.join_on if k not in part.values and k not in part.temps]
        if missing:
            raise ValueError(f"table {self.name}: join_on names no field: {', '.join(missing)}")
        if self.target:
            for name in part.values:
                if self.target.fields and name not in self.target.fields:
                    raise ValueError(self.target.suggest(name))
        return part

    def build(self) -> Table:
        parts = [self._part(e) for e in self.emissions]
        names = list(dict.fromkeys(n for p in parts for n in p.values))
        temps = list(dict.fromkeys(n for p in parts for n in p.temps))
        types = {n: common_type([p.values[n].dtype for p in parts if n in p.values]) for n in names}
        types |= {f"__t_{n}": common_type([p.temps[n].dtype for p in parts if n in p.temps]) for n in temps}
        keyed = [p for p in parts if p.emission.join_on]
        loose = [p for p in parts if not p.emission.join_on]
        frames: list[DataFrame] = []
        if keyed:
            frames.append(self._merged(keyed, names, temps, types))
        frames += [self._rows(p, names, temps, types, self.in_order) for p in loose]
        frame = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
        for n in names:
            if n in self.policies and keyed:
                types[n] = self.policies[n].result_type(types[n])
        columns = list(names)
        if self.inject_id and "id" in frame.columns and "id" not in columns:
            columns.insert(0, "id")
            types["id"] = frame.schema["id"].dataType
        key_names = keyed[0].emission.join_on if keyed else []
        unique = frozenset(key_names) if keyed and not loose else frozenset()
        table = Table(self.name, frame, columns, {c: frame.schema[c].dataType for c in frame.columns}, key_names, self.in_order or self._needs_order(keyed), self.target, None, unique)
        return self._validated(table) if self.target else table

    def _needs_order(self, keyed: list[_Part]) -> bool:
        if not keyed:
            return self.in_order
        for p in keyed:
            for n in [*p.values, *p.temps]:
                if n not in p.emission.join_on and self.policies.get(n, LastWritePolicy()).ordered:
                    return True
        return self.in_order

    def _frame(self, p: _Part, ordered: bool) -> tuple[DataFrame, Column | None]:
        root = self.roots[p.emission.root]
        docs = root.ordered() if ordered else root.docs
        frame, positions = navigate(docs, root.dtype, p.emission.steps, p.usage.indexes, ordered)
        for name, key, n in p.usage.lookups:
            index = self.indices[name]
            kt = index.schema["key"].dataType
            hidden = index.select(comparable(Value(F.col("key"), kt), key.dtype, f"index {name}").alias(f"__lk{n}"), F.col("value").alias(f"__lv{n}"), F.lit(True).alias(f"__lh{n}"))
            frame = frame.join(hidden, comparable(key, kt, f"lookup in {name}") == F.col(f"__lk{n}"), "left")
        if p.usage.lookups:
            frame = frame.withColumns({f"__lh{n}": F.coalesce(F.col(f"__lh{n}"), F.lit(False)) for _, _, n in p.usage.lookups})
        order = None
        if ordered:
            # the order of arrival: root, document, emission, then positions
            order = F.array(F.lit(p.emission.root).cast("long"), F.col("__at").cast("long"), F.lit(p.emission.order).cast("long"), *positions)
        return frame, order

    def _rows(self, p: _Part, names: list[str], temps: list[str], types: dict[str, T.DataType], ordered: bool) -> DataFrame:
        frame, order = self._frame(p, ordered)
        columns = [convert(p.values[n], types[n]).alias(n) if n in p.values else F.lit(None).cast(_real(types[n])).alias(n) for n in names]
        columns += [convert(p.temps[n], types[f"__t_{n}"]).alias(f"__t_{n}") if n in p.temps else F.lit(None).cast(_real(types[f"__t_{n}"])).alias(f"__t_{n}") for n in temps]
        return frame.select(*columns, *self._extra(frame, order))

    @staticmethod
    def _extra(frame: DataFrame, order: Column | None) -> list[Column]:
        return [*([order.alias("__ord")] if order is not None else []), *([F.col("__chunk")] if "__chunk" in frame.columns else [])]

    def _merged(self, parts: list[_Part], names: list[str], temps: list[str], types: dict[str, T.DataType]) -> DataFrame:
        widths = {len(p.emission.join_on) for p in parts}
        if len(widths) > 1:
            raise ValueError(f"table {self.name}: emissions have keys of different length")
        width = widths.pop()
        key_types = [common_type([self._key(p, i).dtype for p in parts]) for i in range(width)]
        for i in range(width):
            for p in parts:
                for q in parts:
                    a, b = self._key(p, i), self._key(q, i)
                    if not a.is_variant and not b.is_variant:
                        comparable(a, b.dtype, f"table {self.name}, key {p.emission.join_on[i]}")
        ordered = self._needs_order(parts)
        frames = []
        for p in parts:
            frame, order = self._frame(p, ordered)
            columns, present = [], []
            for i in range(width):
                value = self._key(p, i)
                columns.append(comparable(Value(convert(value, key_types[i]), key_types[i]), key_types[i], self.name).cast(_key_type(key_types[i])).alias(f"__key{i}"))
                columns.append(convert(value, key_types[i]).alias(f"__id{i}"))
                text = F.col(f"__key{i}").cast("string")
                present.append(F.col(f"__key{i}").isNotNull() & ~text.isin("", '""', "null"))
            for n in names:
                columns.append(convert(p.values[n], types[n]).alias(n) if n in p.values else F.lit(None).cast(_real(types[n])).alias(n))
                columns.append(F.lit(n in p.values).alias(f"__has_{n}"))
            for n in temps:
                columns.append(convert(p.temps[n], types[f"__t_{n}"]).alias(f"__t_{n}") if n in p.temps else F.lit(None).cast(_real(types[f"__t_{n}"])).alias(f"__t_{n}"))
                columns.append(F.lit(n in p.temps).alias(f"__has___t_{n}"))
            rows = frame.select(*columns, *self._extra(frame, order))
            frames.append(rows.where(reduce(Column.__and__, present)))
        rows = reduce(DataFrame.unionByName, frames)
        order_col = F.col("__ord") if ordered else F.lit(0)
        in_key = {n: i for i in range(width) for n in [parts[0].emission.join_on[i]] if all(p.emission.join_on[i] == n for p in parts)}
        everywhere = lambda label: all(label.removeprefix("__t_") in (p.temps if label.startswith("__t_") else p.values) for p in parts)
        aggs: list[Column] = []
        for label in [*names, *(f"__t_{n}" for n in temps)]:
            plain = label.removeprefix("__t_")
            value = Value(F.col(f"`{label}`"), types[label])
            defined = None if everywhere(label) else F.col(f"`__has_{label}`")
            policy = self.policies.get(plain) if label == plain else None
            if policy is None and plain in in_key:
                # part of the key: any row of the group has it
                aggs.append(F.any_value(value.col if defined is None else F.when(defined, value.col), F.lit(True)).alias(label))
            else:
                aggs.append((policy or LastWritePolicy()).aggregate(value, order_col, defined).alias(label))
        if self.inject_id and width == 1:
            own = F.any_value("__id0", F.lit(True))
            if "id" not in names:
                aggs.append(own.alias("id"))
            elif not everywhere("id") and types["id"] == key_types[0]:
                at = [i for i, label in enumerate(names) if label == "id"][0]
                aggs[at] = F.when(F.max(F.col("__has_id").cast("int")) == 1, (self.policies.get("id") or LastWritePolicy()).aggregate(Value(F.col("id"), types["id"]), order_col, F.col("__has_id"))).otherwise(own).alias("id")
        if ordered:
            aggs.append(F.min("__ord").alias("__ord"))
            aggs.append(F.max("__ord").alias("__last"))
        if not aggs:
            aggs.append(F.any_value("__id0").alias("__one"))
        # rows of different chunks never merge here: a chunk holds all rows of its keys, or the sink merges
        chunk = ["__chunk"] if "__chunk" in rows.columns else []
        return rows.groupBy(*chunk, *(f"__key{i}" for i in range(width))).agg(*aggs).drop(*(f"__key{i}" for i in range(width)))

    def _key(self, p: _Part, i: int) -> Value:
        name = p.emission.join_on[i]
        return p.temps[name] if name in p.temps else p.values[name]

    def _validated(self, table: Table) -> Table:
        """Rows that fit the target, cast to it; the others as (key, messages)."""
        target = table.target
        assert target is not None
        columns, errors = [], []
        for name in table.columns:
            col, error = validated(Value(F.col(f"`{name}`"), table.types[name]), name, target)
            columns.append(col.alias(name))
            errors.append(error)
        for name in sorted(target.required - set(table.columns)):
            errors.append(F.lit(f"{name}: required"))
        hidden = [c for c in table.frame.columns if c.startswith("__") and c not in table.columns]
        keys = [table.value(k).col.cast("string") for k in table.keys] or [F.lit(None).cast("string")]
        checked = table.frame.select(*columns, *hidden, F.array_compact(F.array(*errors)).alias("__errors"), F.array(*keys).alias("__error_key"))
        if target.build is not None:
            untyped = [c for c in table.columns if isinstance(checked.schema[c].dataType, T.VariantType)]
            if untyped:
                raise ValueError(f"table {table.name}: a target that builds rows needs types for {', '.join(untyped)}")
            ship(checked.sparkSession)
            passed = checked.where(F.size("__errors") == 0).withColumn("__errors", F.array().cast("array<string>"))
            last = [c for c in passed.columns if c != "__errors"] + ["__errors"]
            built = passed.select(*(F.col(f"`{c}`") for c in last)).mapInArrow(builder(target.build, table.columns), checked.select(*(F.col(f"`{c}`") for c in last)).schema)
            # kept as a table, so that a user's code sees each row once
            checked = materialize(checked.where(F.size("__errors") > 0).unionByName(built), table.name)
        good = checked.where(F.size("__errors") == 0).drop("__errors", "__error_key")
        bad = checked.where(F.size("__errors") > 0).select(F.lit(table.name).alias("table"), F.col("__error_key").alias("key"), F.transform("__errors", lambda m: F.concat(F.lit(f"table={table.name} key="), F.concat_ws(",", "__error_key"), F.lit(" "), m)).alias("messages"))
        table.frame, table.errors = good, bad
        table.types = {c: good.schema[c].dataType for c in good.columns}
        return table


def _real(dtype: T.DataType) -> T.DataType:
    return T.StringType() if isinstance(dtype, T.NullType) else dtype


def _key_type(dtype: T.DataType) -> T.DataType:
    return T.StringType() if isinstance(dtype, (T.NullType, T.VariantType)) else dtype


