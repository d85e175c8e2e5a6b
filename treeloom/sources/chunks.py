"""Chunk sources: batches of documents that hold all rows of their keys.

Python records become one frame of many chunks, told apart by ``__chunk``, so that a
run is a few Spark jobs rather than one for each chunk. Rows of different chunks
never merge with each other before they reach the sink.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any, Protocol, runtime_checkable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.plans.tables import Root
from treeloom.runtime import path_exists, scratch_path
from treeloom.sources.documents import as_root, consecutive_groups, from_json, session


@dataclass(frozen=True)
class Chunk:
    """Documents that belong together. Sequential: each is a document of root 0; otherwise the i-th is root i."""

    roots: tuple[Any, ...]
    sequential: bool = True


@runtime_checkable
class ChunkSource(Protocol):
    def chunks(self) -> Iterator[Chunk]: ...


@dataclass(frozen=True)
class OneRecordPerChunkSource:
    records: Iterable[Any]
    emits_sequential_only = True

    def chunks(self) -> Iterator[Chunk]:
        return (Chunk((r,)) for r in self.records)


@dataclass(frozen=True)
class CallableChunkSource:
    factory: Callable[[], Iterable[Chunk]]

    def chunks(self) -> Iterator[Chunk]:
        return iter(self.factory())


@dataclass(frozen=True)
class PreSegmentedChunkSource:
    segments: Iterable[Any]

    def chunks(self) -> Iterator[Chunk]:
        return (s if isinstance(s, Chunk) else Chunk(tuple(s)) for s in self.segments)


@dataclass(frozen=True)
class GroupByChunkSource:
    """One chunk a run of consecutive records with an equal key. A frame of records is grouped along ``order_by``."""

    records: Any
    key: Any
    order_by: str | None = None
    emits_sequential_only = True

    def chunks(self) -> Iterator[Chunk]:
        of = self.key if callable(self.key) else lambda r: r[self.key]
        return (Chunk(tuple(run)) for _, run in itertools.groupby(self.records, of))

    def frame(self) -> DataFrame | None:
        if not isinstance(self.records, DataFrame):
            return None
        if self.order_by is None or callable(self.key):
            raise ValueError("a frame is grouped by a column along order_by")
        return consecutive_groups(self.records, self.key, self.order_by)


@dataclass(frozen=True)
class ExternalPartitionChunkSource:
    """One chunk a key, wherever its records stand.

    In a run neither records nor keys are held in memory: a frame is told apart by the hash of
    its key column, and Python records are spilled to shared storage as they come, in
    slices of ``slice_rows``.
    """

    records: Any
    key: Any
    slice_rows: int = 100_000
    emits_sequential_only = True

    def chunks(self) -> Iterator[Chunk]:
        of = self.key if callable(self.key) else lambda r: r[self.key]
        groups: dict[Any, list[Any]] = {}
        for r in self.records:
            groups.setdefault(of(r), []).append(r)
        return (Chunk(tuple(g)) for g in groups.values())

    def frame(self) -> DataFrame | Root:
        if isinstance(self.records, DataFrame):
            return self.records.withColumn("__chunk", F.xxhash64(F.col(self.key)))
        of = self.key if callable(self.key) else lambda r: r[self.key]
        spark = session()
        folder, schema = scratch_path(spark, "records"), "__at bigint, key string, body string"
        numbered = enumerate(self.records)
        while part := [(i, json.dumps(of(r), default=str), json.dumps(r, default=str)) for i, r in itertools.islice(numbered, self.slice_rows)]:
            spark.createDataFrame(part, schema).write.mode("append").parquet(folder)
        spilled = spark.read.schema(schema).parquet(folder) if path_exists(spark, folder) else spark.createDataFrame([], schema)
        return from_json(spilled.withColumn("__chunk", F.xxhash64("key")), "body")


def batches(source: Any, chunks_per_batch: int, spark: SparkSession | None = None) -> Iterator[list[Root]]:
    """Roots of several chunks at a time, rows marked with their chunk."""
    frame = source.frame() if hasattr(source, "frame") else None
    if frame is not None:
        yield [as_root(frame)]
        return
    if isinstance(source, DataFrame):
        yield [as_root(source)]
        return
    if not isinstance(source, ChunkSource):
        source = OneRecordPerChunkSource(source)
    spark = spark or session()
    numbered, at_next = enumerate(source.chunks()), itertools.count()
    while group := list(itertools.islice(numbered, chunks_per_batch)):
        width = max((len(c.roots) for _, c in group if not c.sequential), default=1)
        rows: list[list[tuple]] = [[] for _ in range(width)]
        frames: list[list[DataFrame]] = [[] for _ in range(width)]
        for number, chunk in group:
            for i, doc in enumerate(chunk.roots):
                at = 0 if chunk.sequential else i
                if isinstance(doc, DataFrame):
                    frames[at].append(doc)
                else:
                    rows[at].append((number, next(at_next), json.dumps(doc, default=str)))
        if any(frames):
            for of in zip(*frames) if width > 1 else ([f] for f in frames[0]):
                yield [as_root(f) for f in of]
            continue
        yield [from_json(spark.createDataFrame(r, "__chunk bigint, __at bigint, body string"), "body") for r in rows]
