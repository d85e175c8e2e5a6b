"""The fluent builder and its runs."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from typing import Any, Literal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeloom.functions.selectors import FieldSpec
from treeloom.functions.transforms import evaluate
from treeloom.plans.graph import partition_components, topological_sort
from treeloom.plans.links import Backlink, Link, RelationshipIncompleteError, bind, bind_list, default_attr, missing_parents
from treeloom.plans.navigate import Step, navigate, plan_levels
from treeloom.plans.schema import table_name, target_of
from treeloom.plans.scope import Scope, Usage
from treeloom.plans.tables import Emission, Field, Root, Table, TableBuilder, TempField
from treeloom.plans.values import as_value, comparable
from treeloom.runtime import materialize
from treeloom.sources.chunks import batches
from treeloom.sources.documents import as_root, session
from treeloom.streaming.flush import FlushContext, KeyCompleteFlushStrategy
from treeloom.telemetry import MapCompleted, MapStarted, TelemetryCallback, emit

ErrorMode = Literal["collect", "fail_fast"]
ERRORS = "table string, key array<string>, messages array<string>"


@dataclass
class TableStats:
    """Rows of a table: mapped, in error, written and not written."""

    mapped: int = 0
    errors: int = 0
    inserted: int = 0
    failed: int = 0

    def __add__(self, other: TableStats) -> TableStats:
        return TableStats(self.mapped + other.mapped, self.errors + other.errors, self.inserted + other.inserted, self.failed + other.failed)


class Tables(dict):
    """Tables by name or by class."""

    def __getitem__(self, key: str | type) -> DataFrame:
        return super().__getitem__(table_name(key))

    def __contains__(self, key: object) -> bool:
        return super().__contains__(key if isinstance(key, str) else table_name(key))  # type: ignore[arg-type]


class PipelineResult:
    """Lazy tables and errors of a run. Counting happens when ``stats`` is read, unless a load has counted already."""

    def __init__(self, tables: dict[str, Table], errors: DataFrame, stats: dict[str, TableStats] | None = None, loaded: bool = False):
        self._built, self.errors, self._stats = tables, errors, stats
        self.tables = Tables({} if loaded else {n: t.visible() for n, t in tables.items()})

    def in_order(self, table: str | type) -> DataFrame:
        """A table with its rows in the order of arrival, where the run kept it."""
        built = self._built[table_name(table)]
        if "__ord" not in built.frame.columns:
            raise ValueError("run(in_order=True) keeps the order of arrival")
        return built.frame.orderBy("__ord").select(*(F.col(f"`{c}`") for c in built.columns))

    def numbered(self, table: str | type, name: str = "row_number") -> DataFrame:
        """A table with its rows numbered from 0 in the order of arrival, where the run kept it.

        Rows are range-partitioned along the order and numbered within a partition;
        one count a partition is summed in one place.
        """
        built = self._built[table_name(table)]
        if "__ord" not in built.frame.columns:
            raise ValueError("run(in_order=True) keeps the order of arrival")
        ranged = built.frame.repartitionByRange("__ord").sortWithinPartitions("__ord").select(*(F.col(f"`{c}`") for c in built.columns), F.monotonically_increasing_id().alias("__n"))
        ranged = materialize(ranged, "numbered").withColumn("__part", F.shiftright("__n", 33))
        sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__rows"))
        before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        starts = sizes.select("__part", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__start"))
        place = F.col("__start") + F.col("__n").bitwiseAND(F.lit((1 << 33) - 1))
        return ranged.join(F.broadcast(starts), "__part").select(*(F.col(f"`{c}`") for c in built.columns), place.alias(name))

    @property
    def stats(self) -> dict[str, TableStats]:
        if self._stats is None:
            self._stats = {n: _count(t) for n, t in self._built.items()}
        return self._stats


def _count(t: Table) -> TableStats:
    bad = t.errors.count() if t.errors is not None else 0
    return TableStats(t.frame.count(), bad)


class PipelineBuilder:
    """Describes navigation, tables, links and load; ``run`` makes frames of it."""

    def __init__(self, roots: Iterable[Any] = (), *, source: Any = None, eager_roots: Iterable[Any] = (), errors: ErrorMode = "collect", indices: dict[str, Any] | None = None, flush_strategy: Any = None):
        if errors not in ("collect", "fail_fast"):
            raise ValueError("errors is 'collect' or 'fail_fast'")
        self._sources, self._stream, self._eager_sources = list(roots), source, list(eager_roots)
        self._errors, self._flush = errors, flush_strategy or KeyCompleteFlushStrategy()
        self._indices: dict[str, Any] = {n: dict(d) if isinstance(d, dict) else d for n, d in (indices or {}).items()}
        self._index_builds: list[tuple[str, int, list[Step], Any, Any]] = []
        self._emissions: list[Emission] = []
        self._links: list[Link] = []
        self._backlinks: list[Backlink] = []
        self._eager: list[str] = []
        self._load: dict[str, Any] | None = None
        self._root, self._steps = 0, []  # type: tuple[int, list[Step]]

    # navigation -----------------------------------------------------------------------------------------------------

    def goto_root(self, index: int = 0) -> PipelineBuilder:
        """Continue from the top of a root."""
        if index < 0 or self._stream is None and index >= len(self._sources):
            raise IndexError(f"no root {index}")
        self._root, self._steps = index, []
        return self

    def goto(self, path: str | int | list) -> PipelineBuilder:
        """Go down a path; digits are positions where the value is a list."""
        segments = path.split(".") if isinstance(path, str) else [path] if isinstance(path, int) else list(path)
        self._steps = [*self._steps, ("goto", [s for s in segments if s != ""])]
        return self

    def each(self) -> PipelineBuilder:
        """Iterate the value here: list elements, object entries, or a scalar as one."""
        self._steps = [*self._steps, ("each", "auto")]
        return self

    # tables ---------------------------------------------------------------------------------------------------------

    def map_to(self, table: str | type, fields: Iterable[Field | TempField | FieldSpec], join_on: list[str] | None = None, errors: ErrorMode | None = None) -> PipelineBuilder:
        """Emit a row for each context. Rows with equal ``join_on`` values become one; a null or empty key drops the row."""
        if errors not in (None, "collect", "fail_fast"):
            raise ValueError("errors is 'collect' or 'fail_fast'")
        target = target_of(table)
        named = [Field(f.name(table if isinstance(table, type) else None), f.transform) if isinstance(f, FieldSpec) else f for f in fields]
        self._emissions.append(Emission(table_name(table), self._root, list(self._steps), named, list(join_on or []), target, len(self._emissions)))
        return self

    def build_index(self, name: str, *, key: Any = None, value: Any = None, from_dict: dict | None = None) -> PipelineBuilder:
        """A named index for ``lookup``, of a dict or of the contexts here; later values replace earlier ones."""
        if from_dict is not None:
            self._indices[name] = dict(from_dict)
        elif key is not None and value is not None:
            self._index_builds.append((name, self._root, list(self._steps), key, value))
        else:
            raise ValueError("build_index needs from_dict, or key and value")
        return self

    def link_to(self, parent: str | type, by: dict[str, str], fk: dict[str, str] | None = None, *, attr: str | None = None, required: bool = False) -> PipelineBuilder:
        """Link the last table to a parent: its row becomes the column ``attr`` of the child."""
        if not self._emissions:
            raise ValueError("link_to follows a map_to")
        name = table_name(parent)
        self._links.append(Link(self._emissions[-1].table, name, dict(by), attr or default_attr(name), dict(fk or {}), required))
        return self

    def backlink(self, parent: str | type, child: str | type, attr: str, by: dict[str, str]) -> PipelineBuilder:
        """Give a parent the list of children that its list of ids names."""
        self._backlinks.append(Backlink(table_name(parent), table_name(child), attr, dict(by)))
        return self

    # load -----------------------------------------------------------------------------------------------------------

    def load(self, sink: Any, *, upsert: bool = False, upsert_on: dict[str, str | list[str]] | None = None, batch_size: int = 1000) -> PipelineBuilder:
        """Write the tables to a sink, parents first."""
        on = {t: [k] if isinstance(k, str) else list(k) for t, k in (upsert_on or {}).items()}
        if hasattr(sink, "batch_size") and batch_size != 1000:
            sink.batch_size = batch_size
        self._load = {"sink": sink, "upsert": upsert or bool(on), "upsert_on": on}
        return self

    def load_eager(self, table: str | type) -> PipelineBuilder:
        """Map a small table once, from the eager roots or the resident ones, and let every batch link to it."""
        self._eager.append(table_name(table))
        return self

    # run ------------------------------------------------------------------------------------------------------------

    def _dependencies(self) -> dict[str, set[str]]:
        out: dict[str, set[str]] = {}
        for link in self._links:
            out.setdefault(link.child, set()).add(link.parent)
        return out

    def _index_frames(self, roots: list[Root]) -> dict[str, DataFrame]:
        spark = session()
        frames: dict[str, DataFrame] = {}
        for name, source in self._indices.items():
            if isinstance(source, DataFrame):
                frames[name] = source.select(F.col(source.columns[0]).alias("key"), F.col(source.columns[1]).alias("value"))
                continue
            keys = {type(k) for k in source}
            flat = all(isinstance(v, (str, int, float, bool, type(None))) for v in source.values()) and len({type(v) for v in source.values() if v is not None}) <= 1
            kt = T.LongType() if keys and keys <= {int, bool} else T.DoubleType() if keys and keys <= {int, float, bool} else T.StringType()
            cast = int if isinstance(kt, T.LongType) else float if isinstance(kt, T.DoubleType) else str
            if flat:
                vt = next((as_value(v).dtype for v in source.values() if v is not None), T.StringType())
                frame = spark.createDataFrame([(cast(k), v) for k, v in source.items()], T.StructType([T.StructField("key", kt), T.StructField("value", vt)]))
            else:
                import json

                frame = spark.createDataFrame([(cast(k), json.dumps(v)) for k, v in source.items()], T.StructType([T.StructField("key", kt), T.StructField("value", T.StringType())]))
                frame = frame.select("key", F.parse_json("value").alias("value"))
            # a dict has been in the driver's memory, so it is small; a frame is left to the optimizer
            frames[name] = F.broadcast(frame) if len(source) <= 100_000 else frame
        for name in dict.fromkeys(b[0] for b in self._index_builds):
            parts = [self._index_rows(roots, i, b) for i, b in enumerate(self._index_builds) if b[0] == name]
            rows = reduce(DataFrame.unionByName, parts)
            frames[name] = rows.groupBy("key").agg(F.max_by(F.struct("value"), "__ord").alias("v")).select("key", F.col("v.value").alias("value"))
        return frames

    def _index_rows(self, roots: list[Root], number: int, build: tuple) -> DataFrame:
        _, at, steps, key, value = build
        root, usage = roots[at], Usage()
        scope = Scope(tuple(plan_levels(root.dtype, steps)), root.dtype, usage, {})
        k, v = evaluate(key, scope), evaluate(value, scope)
        frame, positions = navigate(root.ordered(), root.dtype, steps, usage.indexes, True)
        order = F.array(F.lit(number).cast("long"), F.col("__at").cast("long"), *positions)
        return frame.select(comparable(k, k.dtype, "index key").alias("key"), v.col.alias("value"), order.alias("__ord")).where("key IS NOT NULL")

    def _needs_order(self, table: str, in_order: bool) -> bool:
        """Whether equal parent keys can meet, so that the last one must be known; or whether an order is asked for."""
        if in_order:
            return True
        keys = [frozenset(e.join_on) for e in self._emissions if e.table == table]
        linked = [frozenset(link.by.values()) for link in self._links if link.parent == table] + [frozenset(b.by.values()) for b in self._backlinks if b.child == table]
        return any(any(k != on for k in keys) for on in linked)

    def _build(self, roots: list[Root], indices: dict[str, DataFrame], names: Iterable[str], in_order: bool) -> dict[str, Table]:
        types = {n: f.schema["value"].dataType for n, f in indices.items()}
        out = {}
        for name in names:
            emissions = [e for e in self._emissions if e.table == name]
            out[name] = TableBuilder(name, emissions, roots, indices, types, in_order=self._needs_order(name, in_order)).build()
        return out

    def _bind(self, tables: dict[str, Table], others: dict[str, Table]) -> dict[str, Table]:
        every = {**others, **tables}
        bound = dict(tables)
        for link in self._links:
            if link.child in bound:
                if link.parent not in every:
                    raise ValueError(f"link to unknown table {link.parent!r}")
                if link.required:
                    lost = missing_parents(every[link.child], every[link.parent], link.by)
                    bound[link.child].errors = _both(bound[link.child].errors, _missing_errors(lost, link))
                bound[link.child] = bind(bound[link.child], every[link.parent], link)
        for back in self._backlinks:
            if back.parent in bound:
                bound[back.parent] = bind_list(bound[back.parent], every[back.child], back)
        return bound

    def _errors_of(self, tables: dict[str, Table]) -> DataFrame:
        found = [t.errors for t in tables.values() if t.errors is not None]
        return reduce(DataFrame.unionByName, found) if found else session().createDataFrame([], ERRORS)

    def _order(self) -> list[str]:
        return topological_sort(self._dependencies(), dict.fromkeys(e.table for e in self._emissions))

    def run(self, on_event: TelemetryCallback | None = None, *, in_order: bool = False, chunks_per_batch: int = 10_000, checkpoint: str | None = None) -> PipelineResult:
        """Build the tables; with a load, write them.

        fail_fast raises on the first bad row before anything is written. A stream's
        ``checkpoint`` also names it to sinks that write each of its batches once;
        chunks that are fed again must then be the same.
        """
        names = list(dict.fromkeys(e.table for e in self._emissions))
        unknown = [t for t in self._eager if t not in names]
        if unknown:
            raise ValueError(f"load_eager of unknown table {unknown[0]!r}")
        if self._stream is not None:
            return self._run_stream(names, on_event, chunks_per_batch, checkpoint)
        roots = [as_root(s) for s in self._sources]
        indices = self._index_frames(roots)
        plain = self._build(roots, indices, names, in_order)
        for eager in self._eager:
            plain[eager].frame = materialize(plain[eager].frame, eager)
        tables = self._bind(plain, {})
        for name in tables:
            emit(on_event, MapStarted(name))
        stats = None
        if on_event is not None or self._load:
            for t in tables.values():
                t.frame = materialize(t.frame, t.name)
            stats = {n: _count(t) for n, t in tables.items()}
            for n, s in stats.items():
                emit(on_event, MapCompleted(n, s.mapped, s.errors))
        errors = self._errors_of(tables)
        self._raise_errors(errors)
        if self._load:
            self._write(tables, stats or {}, on_event, 0)
        return PipelineResult(tables, errors, stats, bool(self._load))

    def _raise_errors(self, errors: DataFrame) -> None:
        if self._errors == "fail_fast":
            first = errors.limit(1).collect()
            if first:
                raise RuntimeError("; ".join(first[0]["messages"]))

    def _write(self, tables: dict[str, Table], stats: dict[str, TableStats], on_event: TelemetryCallback | None, batch: int, stream: str | None = None) -> None:
        assert self._load is not None
        order = self._order()
        for group in partition_components(self._dependencies(), list(tables), self._eager) or [set()]:
            wanted = [t for t in order if t in group and t in tables]
            self._flush.flush(FlushContext(tables, wanted, self._load["sink"], self._load["upsert"], self._load["upsert_on"], stats, on_event, batch, stream, None if self._stream is not None else 1, self._links, self._backlinks))

    # streams --------------------------------------------------------------------------------------------------------

    def _check_stream(self, names: list[str]) -> None:
        if not self._load:
            raise ValueError("a stream needs load()")
        if self._index_builds:
            raise ValueError("a stream has no index of its own contexts; use build_index(from_dict=..)")
        roots = {e.root for e in self._emissions if e.table not in self._eager}
        if getattr(self._stream, "emits_sequential_only", False) and roots - {0}:
            raise ValueError("this source has one root; a pipeline over several needs chunks of several roots")
        for eager in self._eager:
            for link in self._links:
                if link.child == eager and link.parent not in self._eager:
                    raise ValueError(f"eager table {eager!r} links to {link.parent!r}, which is not eager")

    def _run_stream(self, names: list[str], on_event: TelemetryCallback | None, chunks_per_batch: int, checkpoint: str | None) -> PipelineResult:
        self._check_stream(names)
        lazy = [n for n in names if n not in self._eager]
        eager_roots = [as_root(s) for s in self._eager_sources]
        indices = self._index_frames(eager_roots)
        eager = self._build(eager_roots, indices, self._eager, False) if self._eager else {}
        for t in eager.values():
            t.frame = materialize(t.frame, t.name)
        total = {n: TableStats() for n in names}
        bad: list[DataFrame] = []
        if eager:
            stats = {n: _count(t) for n, t in eager.items()}
            self._write(eager, stats, on_event, -1)
            total.update(stats)

        def batch(roots: list[Root], number: int) -> None:
            plain = self._build(roots, indices, lazy, False)
            for t in plain.values():
                emit(on_event, MapStarted(t.name))
                t.frame = materialize(t.frame, t.name)
            for link in self._links:
                if link.child in plain:
                    parent = plain.get(link.parent) or eager.get(link.parent)
                    if parent is None:
                        raise ValueError(f"link to unknown table {link.parent!r}")
                    lost = missing_parents(plain[link.child], parent, link.by).limit(1).collect()
                    if lost:
                        raise RelationshipIncompleteError(f"{link.child}: no {link.parent} for {lost[0].asDict(recursive=True)}")
            tables = self._bind(plain, eager)
            stats = {n: _count(t) for n, t in tables.items()}
            for n, s in stats.items():
                emit(on_event, MapCompleted(n, s.mapped, s.errors))
            errors = self._errors_of(tables)
            self._raise_errors(errors)
            if sum(s.errors for s in stats.values()):
                bad.append(materialize(errors.withColumn("key", F.concat(F.array(F.lit(str(number))), "key")), "errors"))
            self._write(tables, stats, on_event, number, checkpoint)
            for n, s in stats.items():
                total[n] = total[n] + s

        if isinstance(self._stream, DataFrame) and self._stream.isStreaming:
            writer = self._stream.writeStream.foreachBatch(lambda frame, number: batch([as_root(frame)], number)).trigger(availableNow=True)
            if checkpoint:
                writer = writer.option("checkpointLocation", checkpoint)
            writer.start().awaitTermination()
        else:
            for number, roots in enumerate(batches(self._stream, chunks_per_batch)):
                batch(roots, number)
        errors = reduce(DataFrame.unionByName, bad) if bad else session().createDataFrame([], ERRORS)
        return PipelineResult({}, errors, total, True)


def _both(a: DataFrame | None, b: DataFrame) -> DataFrame:
    return b if a is None else a.unionByName(b)


def _missing_errors(lost: DataFrame, link: Link) -> DataFrame:
    keys: list[Column] = [F.col(f"missing_{c}") for c in link.by]
    text = F.concat(F.lit(f"table={link.child} key="), F.concat_ws(",", *keys), F.lit(f" no {link.parent}"))
    return lost.select(F.lit(link.child).alias("table"), F.array(*keys).alias("key"), F.array(text).alias("messages"))


def etl(*roots: Any, errors: ErrorMode = "collect", indices: dict[str, Any] | None = None, flush_strategy: Any = None) -> PipelineBuilder:
    """A pipeline over resident documents: frames whose rows are documents, or Python objects."""
    return PipelineBuilder(roots, errors=errors, indices=indices, flush_strategy=flush_strategy)


def stream(source: Any, *, eager_roots: Iterable[Any] = (), flush_strategy: Any = None, errors: ErrorMode = "collect", indices: dict[str, Any] | None = None) -> PipelineBuilder:
    """A pipeline over batches: a streaming frame, a chunk source, or an iterable of records."""
    return PipelineBuilder(source=source, eager_roots=eager_roots, errors=errors, indices=indices, flush_strategy=flush_strategy)


etl.stream = stream  # type: ignore[attr-defined]
