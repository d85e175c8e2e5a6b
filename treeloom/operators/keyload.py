"""Per-key results when a few keys hold most rows: exact offset chunking.

Rows are range-partitioned on (key, item), so a hot key spreads over as many
equal partitions as it needs. Each partition numbers its rows per key; the counts
per partition and key give prefix-sum offsets, hence every row's exact position
within its key. Positions cut each key into chunks of ``chunk_rows``; a chunk is
reduced to one small state, and the ordered states of a key are merged, their
boundaries compared so that an item on both sides of a cut counts once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeloom.runtime import materialize


_STATES = pa.schema(
    [("key", pa.string()), ("chunk", pa.int64()), ("pid", pa.int64()), ("position", pa.int64()), ("rows", pa.int64()), ("items", pa.int64()), ("first_item", pa.string()), ("last_item", pa.string())]
)


def _chunk_states(chunk_rows: int):
    """Arrow batches of sorted rows in, one state for each run of rows of one key and chunk out, however many batches it spans."""

    def emit(states: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*states), _STATES)], schema=_STATES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: list[list] = []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            key, item = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "item"))
            pid, position, offset = (batch.column(c).to_numpy() for c in ("pid", "position", "offset"))
            chunk = (offset + position) // chunk_rows
            cut = np.r_[True, (key[1:] != key[:-1]) | (chunk[1:] != chunk[:-1]) | (pid[1:] != pid[:-1])]
            fresh = cut | np.r_[True, item[1:] != item[:-1]]
            start = np.flatnonzero(cut)
            end = np.r_[start[1:], len(key)] - 1
            items = np.add.reduceat(fresh.astype(np.int64), start)
            found = [list(s) for s in zip(key[start], chunk[start].tolist(), pid[start].tolist(), position[start].tolist(), (end - start + 1).tolist(), items.tolist(), item[start], item[end])]
            if states and states[-1][:3] == found[0][:3] and states[-1][3] + states[-1][4] == found[0][3]:
                last, head = states[-1], found.pop(0)
                last[4] += head[4]
                last[5] += head[5] - (last[7] == head[6])
                last[7] = head[7]
            states += found
            if len(states) > 10_000:
                yield emit(states[:-1])
                del states[:-1]
        if states:
            yield emit(states)

    return run


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Position of each row among the rows of its key in this sorted partition."""
    last, run = None, 0
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        key = batch.column("key").to_numpy(zero_copy_only=False)
        cut = np.r_[True, key[1:] != key[:-1]]
        start = np.flatnonzero(cut)
        index = np.arange(n)
        position = index - np.repeat(start, np.diff(np.r_[start, n]))
        if key[0] == last:
            head = start[1] if len(start) > 1 else n
            position[:head] += run
        last, run = key[-1], int(position[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(position, pa.int64())], names=[*batch.schema.names, "position"])


def number_rows(df: DataFrame, key: str, item: str, partitions: int | None = None) -> DataFrame:
    """(key, item, pid, position, offset): each row's place within its key is offset + position.

    Null keys are left out; a null item keeps its row with item null.
    """
    spark = df.sparkSession
    rows = df.where(F.col(key).isNotNull()).select(
        F.col(key).cast("string").alias("key"),
        F.col(item).cast("string").alias("item"),
        # equal rows, however many, differ in the input partition they come from, so a range cut can fall between them
        F.spark_partition_id().alias("from"),
    )
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (
        rows.repartitionByRange(parts, F.col("key"), F.col("item"), F.col("from"))
        .sortWithinPartitions("key", "item", "from")
        .select("key", "item", F.spark_partition_id().cast("long").alias("pid"))
    )
    numbered = materialize(ranged.mapInArrow(_number, "key string, item string, pid bigint, position bigint"), "numbered")
    counts = numbered.groupBy("pid", "key").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("key").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    # A range partition continues at most one key of the one before it, so this has at most one row a partition.
    offsets = counts.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).where("offset > 0").select("pid", "key", "offset")
    return numbered.join(F.broadcast(offsets), ["pid", "key"], "left").withColumn("offset", F.coalesce("offset", F.lit(0)))


def per_key_counts(df: DataFrame, key: str, item: str, *, chunk_rows: int = 100_000, partitions: int | None = None) -> DataFrame:
    """(key, rows, items): rows and distinct non-null items of each non-null key, exact.

    The key comes out as text. Ties and repeated rows count in ``rows`` and once
    in ``items``; null items count in ``rows`` only; an empty table gives no row;
    further columns are ignored.
    """
    numbered = number_rows(df, key, item, partitions).select("key", "item", "pid", "position", "offset")
    states = numbered.mapInArrow(
        _chunk_states(chunk_rows),
        "key string, chunk bigint, pid bigint, position bigint, rows bigint, items bigint, first_item string, last_item string",
    )
    order = Window.partitionBy("key").orderBy("chunk", "pid", "position")
    prev = F.lag("last_item").over(order)
    again = F.row_number().over(order) > 1
    has_null = F.col("first_item").isNull()  # nulls sort first, so only a key's first pieces can hold them
    states = states.withColumn("shared", F.when(again & prev.eqNullSafe(F.col("first_item")), 1).otherwise(0))
    return states.groupBy("key").agg(
        F.sum("rows").alias("rows"),
        (F.sum("items") - F.sum("shared") - F.max(has_null.cast("int"))).alias("items"),
    )


def dominant_keys(counts: DataFrame, share: float) -> DataFrame:
    """Keys that hold at least ``share`` of all items; the total is joined as a one-row aggregate."""
    counts = materialize(counts, "counts")  # used twice
    total = counts.agg(F.sum("items").alias("total"))
    return counts.crossJoin(F.broadcast(total)).where((F.col("items") > 0) & (F.col("items") >= share * F.col("total"))).drop("total")
