"""Mapping specifications without the fluent builder."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.functions.policies import MergePolicy
from treeloom.functions.selectors import FieldSpec
from treeloom.plans.links import Link, bind, missing_parents
from treeloom.plans.navigate import Step
from treeloom.plans.schema import Target
from treeloom.plans.tables import Emission, Field, Root, Table, TableBuilder, TempField
from treeloom.sources.documents import as_root


@dataclass(frozen=True)
class IterationLevel:
    """A path below the level before, then how to iterate: auto, items (objects only) or single."""

    path: Sequence[str | int] = ()
    mode: str = "auto"


@dataclass(frozen=True)
class TableEmit:
    table: str
    fields: Sequence[Field]
    join_keys: Sequence[Any] = ()


@dataclass(frozen=True)
class InstanceEmit:
    """Rows checked against a target, with merge policies by field."""

    table: str
    fields: Sequence[Field | FieldSpec]
    join_keys: Sequence[Any] = ()
    builder: Target | None = None
    policies: dict[str, MergePolicy] = field(default_factory=dict)
    temp_fields: Sequence[TempField] = ()


@dataclass(frozen=True)
class TraversalSpec:
    path: Sequence[str | int]
    emits: Sequence[TableEmit | InstanceEmit]
    mode: str = "auto"
    inner_path: Sequence[str | int] | None = None
    inner_mode: str = "auto"
    levels: Sequence[IterationLevel] | None = None

    def get_levels(self) -> list[IterationLevel]:
        """The levels given, or the one or two that path and inner_path stand for."""
        if self.levels is not None:
            return list(self.levels)
        outer = [IterationLevel(self.path, self.mode)]
        return outer if self.inner_path is None else [*outer, IterationLevel(self.inner_path, self.inner_mode)]

    def steps(self) -> list[Step]:
        out: list[Step] = []
        for level in self.get_levels():
            if level.path:
                out.append(("goto", list(level.path)))
            if level.mode != "single":
                out.append(("each", level.mode))
        return out


@dataclass(frozen=True)
class MappingSpec:
    traversals: Sequence[TraversalSpec]


@dataclass(frozen=True)
class MappingResult:
    """A table's rows, its errors (or None), and the built table for binding."""

    rows: DataFrame
    errors: DataFrame | None
    table: Table

    @property
    def stats(self) -> dict[str, int]:
        return {"num_instances": self.rows.count(), "num_errors": self.errors.count() if self.errors is not None else 0}


@dataclass(frozen=True)
class ManyToOneSpec:
    """Children find their parent by key values computed in the child's context."""

    child_table: str
    parent_table: str
    attr: str
    child_to_parent_key: Sequence[Any]
    required: bool = True


def _emissions(spec: MappingSpec, links: Sequence[ManyToOneSpec]) -> list[Emission]:
    out = []
    for traversal in spec.traversals:
        for emit in traversal.emits:
            fields: list[Field | TempField] = []
            policies = emit.policies if isinstance(emit, InstanceEmit) else {}
            for f in emit.fields:
                name = f.name(None) if isinstance(f, FieldSpec) else f.name
                merge = policies.get(name) or (f.merge if isinstance(f, Field) else None)
                fields.append(Field(name, f.transform, merge))
            keys = [TempField(f"key_{i}", k) for i, k in enumerate(emit.join_keys)]
            for n, link in enumerate(links):
                if link.child_table == emit.table:
                    fields += [TempField(f"link_{n}_{i}", k) for i, k in enumerate(link.child_to_parent_key)]
            temps = list(emit.temp_fields) if isinstance(emit, InstanceEmit) else []
            out.append(Emission(emit.table, 0, traversal.steps(), [*fields, *temps, *keys], [k.name for k in keys], emit.builder if isinstance(emit, InstanceEmit) else None, len(out)))
    return out


def run_mapping(root: Any, spec: MappingSpec, *, links: Sequence[ManyToOneSpec] = (), in_order: bool = False) -> dict[str, MappingResult]:
    """The tables of a specification over a frame of documents or one Python document."""
    docs: Root = as_root(root)
    emissions = _emissions(spec, links)
    built = {n: TableBuilder(n, [e for e in emissions if e.table == n], [docs], {}, {}, in_order=in_order).build() for n in dict.fromkeys(e.table for e in emissions)}
    return {n: MappingResult(t.visible(), t.errors, t) for n, t in built.items()}


def bind_many_to_one(results: dict[str, MappingResult], links: Sequence[ManyToOneSpec], *, fail_on_missing: bool = True) -> dict[str, MappingResult]:
    """Children with their parents' rows. Missing required parents raise, all of them named together up to 20, or become error rows."""
    out = dict(results)
    for n, spec in enumerate(links):
        child, parent = results[spec.child_table].table, results[spec.parent_table].table
        by = {f"link_{n}_{i}": f"key_{i}" for i in range(len(spec.child_to_parent_key))}
        link = Link(spec.child_table, spec.parent_table, by, spec.attr)
        if spec.required:
            lost = missing_parents(child, parent, by)
            keys = F.array(*(F.col(f"missing_{c}") for c in by))
            errors = lost.select(F.lit(spec.child_table).alias("table"), keys.alias("key"), F.array(F.concat(F.lit(f"no {spec.parent_table} for {spec.attr}: "), F.array_join(keys, ","))).alias("messages"))
            if fail_on_missing:
                found = errors.limit(20).collect()
                if found:
                    raise RuntimeError("; ".join(m for r in found for m in r["messages"]))
            else:
                before = out[spec.child_table].errors
                out[spec.child_table] = MappingResult(out[spec.child_table].rows, errors if before is None else before.unionByName(errors), child)
        bound = bind(out[spec.child_table].table, parent, link)
        out[spec.child_table] = MappingResult(bound.visible(), out[spec.child_table].errors, bound)
    return out
