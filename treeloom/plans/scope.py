"""What a transform may see while a plan is built: the nodes, keys and positions from the current level up."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeloom.plans.values import Value, null, resolve


@dataclass(frozen=True)
class Level:
    """One step of the navigation: its node and, where it has them, its key and position."""

    number: int
    dtype: T.DataType
    keyed: bool = False
    indexed: bool = False
    same_as: int | None = None

    @property
    def node_column(self) -> str:
        return f"__n{self.number if self.same_as is None else self.same_as}"


@dataclass
class Usage:
    """What the transforms of an emission asked for, so that the plan makes nothing else."""

    indexes: set[int] = field(default_factory=set)
    lookups: list[tuple[str, Value, Any]] = field(default_factory=list)


@dataclass(frozen=True)
class Scope:
    """The context of one row at plan time. ``levels[0]`` is the outermost container."""

    levels: tuple[Level, ...]
    root_type: T.DataType
    usage: Usage
    indices: dict[str, T.DataType]

    @property
    def node(self) -> Value:
        level = self.levels[-1]
        return Value(F.col(level.node_column), level.dtype)

    @property
    def root(self) -> Value:
        return Value(F.col("__doc"), self.root_type)

    @property
    def key(self) -> Value:
        level = self.levels[-1]
        return Value(F.col(f"__k{level.number}"), T.StringType()) if level.keyed else null()

    @property
    def index(self) -> Value:
        level = self.levels[-1]
        if not level.indexed:
            return null()
        self.usage.indexes.add(level.number)
        return Value(F.col(f"__i{level.number}").cast("long"), T.LongType())

    @property
    def parent(self) -> Scope | None:
        return Scope(self.levels[:-1], self.root_type, self.usage, self.indices) if len(self.levels) > 1 else None

    def ancestor(self, depth: int) -> Scope | None:
        scope: Scope | None = self
        for _ in range(depth):
            scope = scope.parent if scope else None
        return scope

    def get(self, *path: str | int) -> Value:
        return resolve(self.node, list(path))

    def lookup(self, name: str, key: Value) -> tuple[Value, Value]:
        """(hit, value) columns of a join that the plan adds below this row's projection."""
        if name not in self.indices:
            raise ValueError(f"unknown index {name!r}; available: {sorted(self.indices)}")
        n = len(self.usage.lookups)
        self.usage.lookups.append((name, key, n))
        return Value(F.col(f"__lh{n}"), T.BooleanType()), Value(F.col(f"__lv{n}"), self.indices[name])


Transform = Callable[[Scope], Any]
