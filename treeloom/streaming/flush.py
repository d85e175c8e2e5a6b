"""How a batch of tables reaches its sink."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any, Protocol, runtime_checkable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.plans.tables import Table
from treeloom.telemetry import FlushCompleted, FlushFailed, FlushStarted, TelemetryCallback, emit


@dataclass
class FlushContext:
    """What a flush strategy may use: tables in load order, how they depend on each other, and where they go."""

    tables: dict[str, Table]
    order: list[str]
    sink: Any
    upsert: bool
    upsert_on: dict[str, list[str]]
    stats: dict[str, Any]
    on_event: TelemetryCallback | None
    batch_id: int = 0
    stream: str | None = None
    batch_total: int | None = 1
    links: list[Any] = field(default_factory=list)
    backlinks: list[Any] = field(default_factory=list)

    def keys(self, table: str) -> list[str]:
        """Columns that identify a row: those given to ``load``, else the table's own keys as far as they are columns."""
        if table in self.upsert_on:
            return self.upsert_on[table]
        t = self.tables[table]
        if t.keys and all(k in t.columns for k in t.keys):
            return t.keys
        return ["id"] if len(t.keys) == 1 and "id" in t.columns else []


@runtime_checkable
class FlushStrategy(Protocol):
    def flush(self, ctx: FlushContext) -> None: ...


def latest(table: Table, keys: list[str]) -> DataFrame:
    """One row a key, the one that arrived last."""
    if not keys:
        return table.visible()
    order = F.col("__last") if "__last" in table.frame.columns else F.col("__ord") if "__ord" in table.frame.columns else F.col("__chunk") if "__chunk" in table.frame.columns else F.lit(0)
    row = F.struct(*(F.col(f"`{c}`") for c in table.columns))
    return table.frame.groupBy(*(F.col(f"`{k}`").alias(f"__g{i}") for i, k in enumerate(keys))).agg(F.max_by(row, order).alias("r")).select("r.*")


def _write(ctx: FlushContext, name: str, rows: DataFrame, mode: str, keys: list[str]) -> None:
    stats = ctx.stats[name]
    emit(ctx.on_event, FlushStarted(name, stats.mapped))
    try:
        once = {"batch": (ctx.stream, ctx.batch_id)} if ctx.stream is not None and "batch" in inspect.signature(ctx.sink.write).parameters else {}
        count = ctx.sink.write(name, rows, mode, keys, **once)
    except Exception as error:
        stats.failed += stats.mapped
        emit(ctx.on_event, FlushFailed(name, str(error)[:500], stats.mapped))
        raise
    stats.inserted += count
    emit(ctx.on_event, FlushCompleted(name, count, 0, ctx.batch_id + 1, ctx.batch_total, mode != "append"))


@dataclass(frozen=True)
class KeyCompleteFlushStrategy:
    """Append each table, or upsert where ``load`` asks for it."""

    def flush(self, ctx: FlushContext) -> None:
        for name in ctx.order:
            keys = ctx.keys(name) if ctx.upsert else []
            _write(ctx, name, latest(ctx.tables[name], keys), "update" if keys else "append", keys)


@dataclass(frozen=True)
class UpsertFlushStrategy:
    """Merge by key: newer rows replace ("update") or known keys are left alone ("skip")."""

    on_conflict: str = "update"

    def __post_init__(self) -> None:
        if self.on_conflict not in ("update", "skip"):
            raise ValueError("on_conflict is 'update' or 'skip'")

    def flush(self, ctx: FlushContext) -> None:
        for name in ctx.order:
            keys = ctx.keys(name)
            table = ctx.tables[name]
            rows = latest(table, keys) if self.on_conflict == "update" else _first(table, keys)
            _write(ctx, name, rows, self.on_conflict if keys else "append", keys)


@dataclass(frozen=True)
class BufferedKeyFlushStrategy:
    """Late rows of a key fill in what earlier ones left null; rows without key are appended.

    The merge is exact however many keys there are; ``max_keys`` is accepted and not needed.
    """

    max_keys: int = 10_000

    def __post_init__(self) -> None:
        if self.max_keys < 1:
            raise ValueError("max_keys must be positive")

    def flush(self, ctx: FlushContext) -> None:
        for name in ctx.order:
            keys, table = ctx.keys(name), ctx.tables[name]
            _write(ctx, name, _filled(table, keys), "merge" if keys else "append", keys)


def _first(table: Table, keys: list[str]) -> DataFrame:
    if not keys:
        return table.visible()
    order = F.col("__ord") if "__ord" in table.frame.columns else F.col("__chunk") if "__chunk" in table.frame.columns else F.lit(0)
    row = F.struct(*(F.col(f"`{c}`") for c in table.columns))
    return table.frame.groupBy(*(F.col(f"`{k}`").alias(f"__g{i}") for i, k in enumerate(keys))).agg(F.min_by(row, order).alias("r")).select("r.*")


def _filled(table: Table, keys: list[str]) -> DataFrame:
    """One row a key, each column its latest value that is not null."""
    if not keys or "__chunk" not in table.frame.columns:
        return latest(table, keys)
    order = F.col("__last") if "__last" in table.frame.columns else F.col("__chunk")
    rest = [c for c in table.columns if c not in keys]
    aggs = [F.max_by(F.col(f"`{c}`"), F.when(F.col(f"`{c}`").isNotNull(), order)).alias(c) for c in rest] or [F.count(F.lit(1)).alias("__n")]
    return table.frame.groupBy(*(F.col(f"`{k}`") for k in keys)).agg(*aggs).select(*(F.col(f"`{c}`") for c in table.columns))


FlushFunction = Callable[[FlushContext], None]
