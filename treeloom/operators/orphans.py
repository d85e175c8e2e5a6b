"""References to records that do not exist.

The keys present, of parents and references alike, are cut into ranges at their
quantiles. Both sides go to the partition of their key's range; a key that holds
more than one range's share is the bound of several, so its references are spread
over these and its parents copied to each. A task keeps the parents of its range
as sorted arrays, which come first, and probes the references batch by batch with
a vectorised binary search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.runtime import ship

NEVER = np.iinfo(np.int64).max
SINCE_EVER = np.iinfo(np.int64).min

#: Rows a range has at least, so that small tables are not spread over many tasks.
RANGE_ROWS = 4096


def lifetimes(parents: DataFrame, key: str, born: str, died: str) -> DataFrame:
    """(key, born, died) in microseconds, exact repeats removed, null keys dropped.

    A parent without birth has lived since ever, one without death lives for ever.
    """
    return (
        parents.where(F.col(key).isNotNull())
        .select(
            F.col(key).cast("long").alias("key"),
            F.coalesce(F.unix_micros(F.col(born).cast("timestamp")), F.lit(int(SINCE_EVER))).alias("born"),
            F.coalesce(F.unix_micros(F.col(died).cast("timestamp")), F.lit(int(NEVER))).alias("died"),
        )
        .distinct()
    )


class Lives:
    """Lives of parents as sorted arrays of key, birth and death."""

    def __init__(self, key: np.ndarray, born: np.ndarray, died: np.ndarray):
        order = np.lexsort((born, key))
        self.key, born, died = key[order], born[order], died[order]
        # The latest death among the lives begun so far, per key: ranks make one running maximum out of many.
        first = np.r_[True, self.key[1:] != self.key[:-1]]
        self.group = np.cumsum(first) - 1 if len(self.key) else np.empty(0, np.int64)
        deaths = np.unique(died)
        if len(self.key):
            running = np.maximum.accumulate(self.group * len(deaths) + np.searchsorted(deaths, died)) - self.group * len(deaths)
            self.until = deaths[running]
        # Key and birth as one sorted integer, so that one binary search finds the last life begun by then.
        self.births = np.unique(born)
        self.code = self.group * (len(self.births) + 1) + np.searchsorted(self.births, born) + 1

    def kinds(self, ref: np.ndarray, at: np.ndarray, dated: np.ndarray) -> np.ndarray:
        """Kind of each reference that is a case, else an empty text."""
        kind = np.full(len(ref), "", dtype=object)
        if not len(self.key):
            kind[:] = "missing"
            return kind
        lo, hi = np.searchsorted(self.key, ref, "left"), np.searchsorted(self.key, ref, "right")
        missing = lo == hi
        of = np.where(missing, 0, self.group[np.minimum(lo, len(self.key) - 1)])
        last = np.searchsorted(self.code, of * (len(self.births) + 1) + np.searchsorted(self.births, at, "right"), "right") - 1
        begun = ~missing & (last >= lo)
        alive = begun & (self.until[np.maximum(last, 0)] > at)
        kind[missing] = "missing"
        kind[~missing & ~begun & dated] = "late"
        kind[begun & ~alive & dated] = "deleted"
        return kind


_MISSES = pa.schema([("child_id", pa.int64()), ("month", pa.string()), ("kind", pa.string())])


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range: its parents first, then its references."""
    parents: list[pa.RecordBatch] = []
    lives = None
    for batch in batches:
        is_ref = batch.column("is_ref").to_numpy(zero_copy_only=False)
        n = int(np.argmax(is_ref)) if is_ref.any() else len(is_ref)
        if n:
            parents.append(batch.slice(0, n).select(["key", "at", "died"]))
        refs = batch.slice(n)
        if refs.num_rows == 0:
            continue
        if lives is None:
            columns = [np.concatenate([p.column(c).to_numpy() for p in parents]) if parents else np.empty(0, np.int64) for c in ("key", "at", "died")]
            lives, parents = Lives(*columns), []
        kind = lives.kinds(refs.column("key").to_numpy(), refs.column("at").to_numpy(), refs.column("dated").to_numpy(zero_copy_only=False))
        found = np.flatnonzero(kind != "")
        if len(found):
            at = pa.array(found)
            misses = pa.table([refs.column("child_id").take(at), refs.column("month").take(at), pa.array(kind[found], pa.string())], schema=_MISSES)
            yield from misses.group_by(_MISSES.names).aggregate([]).select(_MISSES.names).cast(_MISSES).to_batches()


def _ranges(keys: DataFrame, parts: int, range_rows: int) -> np.ndarray:
    """Bounds of the ranges: quantiles of the keys, a key that holds several ranges' share as often as that.

    They are floats, as quantiles are computed on these: keys too long for one share
    a place with their neighbours, on both sides alike.
    """
    probabilities = [i / parts for i in range(1, parts)] or [0.5]
    count, bounds = keys.agg(F.count("key"), F.percentile_approx(F.col("key").cast("double"), probabilities, max(10_000, 20 * parts))).first()
    wanted = min(parts, count // range_rows)
    if wanted < 2:
        return np.empty(0)
    # few rows make fewer ranges
    return np.array([bounds[len(bounds) * i // wanted] for i in range(1, wanted)])


def orphan_references(
    children: DataFrame,
    parents: DataFrame,
    *,
    child_id: str = "id",
    reference: str,
    child_time: str = "created_at",
    parent_key: str = "id",
    born: str = "created_at",
    died: str = "deleted_at",
    ranges: int | None = None,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """(child_id, month, kind) of each child whose parent does not live at the child's time.

    kind: ``missing`` if no parent row has the key, else ``late`` if all its lives
    began after the child, else ``deleted``. A life spans [born, died).
    ranges: how many ranges the keys are cut into, by default as many as a shuffle
    has partitions, but no more than leave ``range_rows`` rows to each.

    A null reference refers to nothing. A null child time cannot be placed, so
    such a child is a case only if its parent is missing, and its month is null.
    Repeated children give one row; several lives of a key count together;
    children of an empty parent table are all missing; an empty child table gives
    no row; further columns of either table are ignored, whatever their names.
    """
    spark = children.sparkSession
    ship(spark)
    refs = children.where(F.col(reference).isNotNull()).select(
        F.col(child_id).cast("long").alias("child_id"),
        F.col(reference).cast("long").alias("key"),
        F.col(child_time).cast("timestamp").alias("time"),
    )
    lives = lifetimes(parents, parent_key, born, died)
    bounds = _ranges(refs.select("key").unionByName(parents.where(F.col(parent_key).isNotNull()).select(F.col(parent_key).cast("long").alias("key"))), ranges or int(spark.conf.get("spark.sql.shuffle.partitions")), range_rows)

    @F.pandas_udf("int")
    def first_range(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, key.to_numpy(np.float64), "left").astype(np.int32))

    @F.pandas_udf("int")
    def last_range(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, key.to_numpy(np.float64), "right").astype(np.int32))

    @F.pandas_udf("int")
    def one_range(key: pd.Series, spread: pd.Series) -> pd.Series:
        low, high = np.searchsorted(bounds, key.to_numpy(np.float64), "left"), np.searchsorted(bounds, key.to_numpy(np.float64), "right")
        return pd.Series((low + spread.to_numpy(np.int64) % (high - low + 1)).astype(np.int32))

    refs = refs.select(
        one_range("key", F.pmod(F.xxhash64("child_id", "time"), F.lit(1 << 30))).alias("range"),
        F.lit(True).alias("is_ref"),
        "key",
        F.coalesce(F.unix_micros("time"), F.lit(0)).alias("at"),
        F.lit(None).cast("long").alias("died"),
        "child_id",
        F.col("time").isNotNull().alias("dated"),
        F.date_format("time", "yyyy-MM").alias("month"),
    )
    held = lives.select(
        F.explode(F.sequence(first_range("key"), last_range("key"))).alias("range"),
        F.lit(False).alias("is_ref"),
        "key",
        F.col("born").alias("at"),
        "died",
        F.lit(None).cast("long").alias("child_id"),
        F.lit(False).alias("dated"),
        F.lit(None).cast("string").alias("month"),
    )
    placed = held.unionByName(refs).repartitionById(len(bounds) + 1, "range").sortWithinPartitions("is_ref", "key", "at").drop("range")
    return placed.mapInArrow(_probe, "child_id bigint, month string, kind string").distinct()


def orphan_report(misses: DataFrame, table: str = "table_name") -> DataFrame:
    """Cases per table, month and kind."""
    return misses.groupBy(table, "created_month", "kind").agg(F.count(F.lit(1)).alias("cases"))
