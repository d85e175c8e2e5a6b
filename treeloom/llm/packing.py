"""Filling containers of fixed capacity with neighbouring documents along a space-filling curve.

Documents are hashed to vectors, projected to three dimensions and range-sorted by
their Hilbert key, so that each partition holds one stretch of the curve. A
partition walks along its stretch in steps of a few documents. The pieces of a
step go, largest first, each into the fullest container that it fits among those
opened within the last ``reach`` steps; a container that was left behind stays as
it is. So what shares a container lies close together on the curve. Containers
still open where a stretch ends are handed on, to be joined with those of the
stretches after it. Only ids and token counts are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeloom.runtime import materialize

PACKED = "spec_name string, container_id bigint, doc_id bigint, piece_no int, token_start bigint, tokens bigint"

#: Documents a stretch has at least, so that its open containers are few beside its full ones.
STRETCH = 2048


class Packer:
    """Containers of one capacity, filled best fit."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.room: dict[int, list[int]] = {}  # open containers by free space
        self.mask = 0  # bit s is set if a container has s free
        self.count = 0

    def place(self, size: int) -> int:
        """Container number for a piece of this size."""
        fits = self.mask >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            stack = self.room[free]
            number = stack.pop()
            if not stack:
                self._full(free)
        else:
            free, number = self.capacity, self.count
            self.count += 1
        left = free - size
        if left:
            self.room.setdefault(left, []).append(number)
            self.mask |= 1 << left
        return number

    def _full(self, free: int) -> None:
        del self.room[free]
        self.mask ^= 1 << free

    def leave(self, oldest: int) -> None:
        """Close the containers opened before this one."""
        for free, stack in list(self.room.items()):
            stack[:] = [n for n in stack if n >= oldest]
            if not stack:
                self._full(free)

    def open(self) -> list[int]:
        return [n for stack in self.room.values() for n in stack]


def pieces(tokens: int, capacity: int) -> list[tuple[int, int, int]]:
    """(piece_no, start, size): one piece, or full ones and a rest if the document exceeds the capacity."""
    return [(i, start, min(capacity, tokens - start)) for i, start in enumerate(range(0, tokens, capacity))]


_PLACED = pa.schema([("spec_name", pa.string()), ("container_id", pa.int64()), ("doc_id", pa.int64()), ("piece_no", pa.int32()), ("token_start", pa.int64()), ("tokens", pa.int64()), ("handed_on", pa.bool_())])


def _pack(specs: list[tuple[str, int]], step: int, reach: int):
    """Rows of PACKED with handed_on, whether the container was open at the end: its rows wait for this."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walks = [(name, cap, Packer(cap), [], {}) for name, cap in specs]
        ready: list[tuple] = []
        pid = 0

        def walk(block: list[tuple[int, int]]) -> None:
            for name, cap, packer, marks, held in walks:
                marks.append(packer.count)
                todo = [(size, doc, no, start) for doc, tokens in block for no, start, size in pieces(tokens, cap)]
                todo.sort(key=lambda p: -p[0])
                for size, doc, no, start in todo:
                    number = packer.place(size)
                    row = (name, (pid << 36) + number, doc, no, start, size, False)
                    if size == cap:
                        ready.append(row)
                    else:
                        held.setdefault(number, []).append(row)
                if len(marks) > reach:
                    packer.leave(marks.pop(0))
                still = set(packer.open())
                for number in [n for n in held if n not in still]:
                    ready.extend(held.pop(number))

        def emit() -> Iterator[pa.RecordBatch]:
            for at in range(0, len(ready), 50_000):
                part = ready[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), _PLACED)], schema=_PLACED)
            ready.clear()

        waiting: list[tuple[int, int]] = []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            pid = batch.column("pid")[0].as_py()
            waiting.extend(zip(batch.column("doc_id").to_pylist(), batch.column("tokens").to_pylist()))
            while len(waiting) >= step:
                walk(waiting[:step])
                del waiting[:step]
            yield from emit()
        if waiting:
            walk(waiting)
        for *_, held in walks:
            for number, rows in held.items():
                ready.extend((*row[:-1], True) for row in rows)
        yield from emit()

    return run


def _join_open(specs: dict[str, int], reach: int):
    """(spec_name, container_id, joined): open containers, in the order of the curve, poured together where they fit."""
    schema = pa.schema([("spec_name", pa.string()), ("container_id", pa.int64()), ("joined", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[str, list[tuple[int, int]]] = {name: [] for name in specs}

        def pour(name: str) -> Iterator[pa.RecordBatch]:
            packer, first, rows = Packer(specs[name]), {}, []
            for used, container in sorted(((used, c) for c, used in groups[name]), key=lambda x: (-x[0], x[1])):
                number = packer.place(used)
                rows.append((name, container, first.setdefault(number, container)))
            groups[name] = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            for name, container, used in zip(*(batch.column(c).to_pylist() for c in ("spec_name", "container_id", "used"))):
                groups[name].append((container, used))
                if len(groups[name]) >= reach:
                    yield from pour(name)
        for name in specs:
            yield from pour(name)

    return run


def pack(features: DataFrame, specs: DataFrame, *, step: int = 192, reach: int = 2, stretches: int | None = None, max_specs: int = 1000) -> DataFrame:
    """(spec_name, container_id, doc_id, piece_no, token_start, tokens): every token of every document, in one container per spec.

    features(doc_id, tokens, curve). A document is split only if it exceeds the
    capacity, then into full containers and a rest. Documents without tokens go
    nowhere. Specs with a null name or without positive capacity are left out, and
    no specs or no documents give no rows; of equal documents each is packed.
    Container ids are unique within a spec; of several capacities under one name
    the largest counts.

    step: documents packed together. reach: steps a container stays open; more of
    either fills better, less keeps nearer to the curve. stretches: pieces of the
    curve packed side by side, by default one a shuffle partition with at least
    STRETCH documents in each.
    """
    spark = features.sparkSession
    rows = specs.where("spec_name IS NOT NULL AND capacity_tokens > 0").groupBy("spec_name").agg(F.max("capacity_tokens").cast("int")).limit(max_specs + 1).collect()
    if len(rows) > max_specs:
        raise ValueError(f"more than {max_specs} container sizes")
    if not rows:
        return spark.createDataFrame([], T.StructType.fromDDL(PACKED))
    sized = materialize(features.where("tokens > 0").select("curve", "doc_id", "tokens"), "sized")
    parts = stretches or max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), sized.count() // STRETCH))
    along = sized.repartitionByRange(parts, "curve", "doc_id").sortWithinPartitions("curve", "doc_id").select("doc_id", "tokens", F.spark_partition_id().cast("long").alias("pid"))
    placed = materialize(along.mapInArrow(_pack(sorted((r[0], r[1]) for r in rows), step, reach), PACKED + ", handed_on boolean"), "placed")
    if parts == 1:
        return placed.drop("handed_on")
    # a stretch hands on no more than it opens in ``reach`` steps, so these are few however many documents there are
    handed = placed.where("handed_on").groupBy("spec_name", "container_id").agg(F.sum("tokens").alias("used"))
    beside = handed.repartitionByRange(max(1, parts // 64), "container_id").sortWithinPartitions("container_id")
    joined = materialize(beside.mapInArrow(_join_open(dict(sorted((r[0], r[1]) for r in rows)), 1000), "spec_name string, container_id bigint, joined bigint"), "joined")
    final = placed.where("handed_on").drop("handed_on").join(joined, ["spec_name", "container_id"]).select("spec_name", F.col("joined").alias("container_id"), "doc_id", "piece_no", "token_start", "tokens")
    return placed.where("NOT handed_on").drop("handed_on").unionByName(final)


def fill(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec_name, capacity_tokens, containers, tokens, fill): the share of the containers' space that is used."""
    used = packed.groupBy("spec_name").agg(F.count_distinct("container_id").alias("containers"), F.sum("tokens").alias("tokens"))
    sizes = specs.groupBy("spec_name").agg(F.max("capacity_tokens").cast("bigint").alias("capacity_tokens"))
    return used.join(sizes, "spec_name").select("spec_name", "capacity_tokens", "containers", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("fill"))
