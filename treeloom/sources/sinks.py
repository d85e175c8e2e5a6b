"""Where tables go: memory, parquet folders, catalog tables, JDBC, and any DB-API database."""

from __future__ import annotations

import itertools
import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from typing import Any, Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeloom.runtime import drop_path, list_folder, make_folder, materialize, partitions_of, read_text, write_text


@runtime_checkable
class Sink(Protocol):
    """mode: append, update (newer rows replace those of their keys), skip (rows of known keys are left out), merge (newer values that are not null replace).

    A sink whose ``write`` also takes ``batch``, a stream's name and the number of its batch, writes each batch once.
    """

    def write(self, table: str, rows: DataFrame, mode: str, keys: list[str]) -> int: ...


def combine(old: DataFrame, new: DataFrame, mode: str, keys: list[str]) -> DataFrame:
    """The table after a write. ``new`` has at most one row a key unless appended."""
    if mode == "append" or not keys:
        return old.unionByName(new, allowMissingColumns=True)
    same = lambda a, b: reduce(Column.__and__, [a[k].eqNullSafe(b[k]) for k in keys])
    if mode == "update":
        return old.join(new, same(old, new), "left_anti").unionByName(new, allowMissingColumns=True)
    if mode == "skip":
        return old.unionByName(new.join(old, same(new, old), "left_anti"), allowMissingColumns=True)
    if mode == "merge":
        a, b = old.alias("a"), new.alias("b")
        columns = list(dict.fromkeys([*old.columns, *new.columns]))
        pick = [F.coalesce(*([F.col(f"b.`{c}`")] if c in new.columns else []), *([F.col(f"a.`{c}`")] if c in old.columns else [])).alias(c) for c in columns]
        on = reduce(Column.__and__, [F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`")) for k in keys])
        return a.join(b, on, "full_outer").select(*pick)
    raise ValueError(f"unknown write mode {mode!r}")


@dataclass
class MemorySink:
    """Keeps each table as a frame in shared storage; meant for tests and small results."""

    tables: dict[str, DataFrame] = field(default_factory=dict)

    def write(self, table: str, rows: DataFrame, mode: str, keys: list[str]) -> int:
        new = materialize(rows, table)
        self.tables[table] = materialize(combine(self.tables[table], new, mode, keys), table) if table in self.tables else new
        return new.count()


@dataclass
class ParquetSink:
    """One folder a table, of which each write makes a new version that readers see as a whole.

    A version lists the folders of each hash partition of the keys. Appends add
    folders; other modes write only the partitions that the new rows fall into and
    leave the old version's files alone, so neither a crash nor a reader at work
    meets half a table. A batch whose stream and number the table has seen already
    is not written again. ``vacuum`` removes what no version needs any more.
    """

    path: str
    partitions: int | None = None

    def _versions(self, spark: SparkSession, table: str) -> list[int]:
        return sorted(int(n) for n in list_folder(spark, f"{self.path}/{table}/versions") if n.isdigit())

    def _version(self, spark: SparkSession, table: str) -> tuple[int, dict[str, Any]]:
        numbers = self._versions(spark, table)
        if not numbers:
            return 0, {"keys": None, "width": 0, "parts": {}, "streams": {}, "schema": None}
        return numbers[-1], json.loads(read_text(spark, f"{self.path}/{table}/versions/{numbers[-1]}"))

    def write(self, table: str, rows: DataFrame, mode: str, keys: list[str], batch: tuple[str, int] | None = None) -> int:
        spark, folder = rows.sparkSession, f"{self.path}/{table}"
        number, now = self._version(spark, table)
        if batch is not None and now["streams"].get(batch[0], -1) >= batch[1]:
            return 0
        new = materialize(rows, table)
        count = new.count()
        parts = {p: list(folders) for p, folders in now["parts"].items()}
        if mode == "append" or not keys:
            keyed, width = (now["keys"], now["width"]) if parts else (keys or None, self.partitions or int(spark.conf.get("spark.sql.shuffle.partitions")))
            after, touched = new, []
        else:
            keyed, width = keys, now["width"] if now["keys"] == keys else self.partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
            after, touched = new, list(parts)
            if now["keys"] == keys:
                # at most ``width`` numbers
                touched = [p for p in (str(r[0]) for r in new.select(_part(keys, width)).distinct().collect()) if p in parts]
            old = [f for p in touched for f in parts.pop(p)]
            if old:
                after = combine(self._folders(spark, table, old, now["schema"]), new, mode, keys)
        data = f"data-{uuid.uuid4().hex}"
        after.withColumn("__part", _part(keyed, width)).repartition("__part").write.partitionBy("__part").parquet(f"{folder}/{data}")
        for name in partitions_of(spark, f"{folder}/{data}"):
            parts.setdefault(name.partition("=")[2], []).append(f"{data}/{name}")
        schema = after.schema if now["schema"] is None else _wider(T.StructType.fromJson(now["schema"]), after.schema)
        streams = now["streams"] | ({batch[0]: batch[1]} if batch is not None else {})
        make_folder(spark, f"{folder}/versions")
        write_text(spark, f"{folder}/versions/{number + 1}", json.dumps({"keys": keyed, "width": width, "parts": parts, "streams": streams, "schema": schema.jsonValue()}))
        return count

    def _folders(self, spark: SparkSession, table: str, folders: list[str], schema: dict[str, Any]) -> DataFrame:
        return spark.read.schema(T.StructType.fromJson(schema)).parquet(*(f"{self.path}/{table}/{f}" for f in folders))

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        """The table as of its last version."""
        number, now = self._version(spark, table)
        if not number:
            raise ValueError(f"no table {table!r} in {self.path}")
        folders = [f for fs in now["parts"].values() for f in fs]
        return self._folders(spark, table, folders, now["schema"]) if folders else spark.createDataFrame([], T.StructType.fromJson(now["schema"]))

    def vacuum(self, spark: SparkSession, table: str) -> None:
        """Remove old versions and the files only these have."""
        number, now = self._version(spark, table)
        used = {f.partition("/")[0] for fs in now["parts"].values() for f in fs}
        for old in self._versions(spark, table):
            if old != number:
                drop_path(spark, f"{self.path}/{table}/versions/{old}")
        for name in list_folder(spark, f"{self.path}/{table}"):
            if name.startswith("data-") and name not in used:
                drop_path(spark, f"{self.path}/{table}/{name}")


def _part(keys: list[str] | None, width: int) -> Column:
    """The hash partition of a row; without keys rows lie in one partition, which is only appended to."""
    if not keys:
        return F.lit(0).alias("__part")
    return F.pmod(F.xxhash64(*(F.col(f"`{k}`") for k in keys)), F.lit(width)).cast("int").alias("__part")


def _wider(old: T.StructType, new: T.StructType) -> T.StructType:
    names = {f.name for f in old}
    return T.StructType([*old, *(f for f in new if f.name not in names)])


@dataclass
class TableSink:
    """Catalog tables. Formats that can merge rows use it; for others the table is written anew."""

    database: str = "default"
    format: str = "parquet"

    def write(self, table: str, rows: DataFrame, mode: str, keys: list[str]) -> int:
        spark, name = rows.sparkSession, f"{self.database}.{table}"
        new = materialize(rows, table)
        if mode == "append" or not keys or not spark.catalog.tableExists(name):
            new.write.mode("append").format(self.format).saveAsTable(name)
        else:
            after = materialize(combine(spark.table(name), new, mode, keys), table)
            after.write.mode("overwrite").format(self.format).saveAsTable(name)
        return new.count()


@dataclass
class JdbcSink:
    url: str
    properties: dict[str, str] = field(default_factory=dict)
    batch_size: int = 1000

    def write(self, table: str, rows: DataFrame, mode: str, keys: list[str]) -> int:
        if mode != "append":
            raise ValueError("JDBC appends only; a DbApiSink can upsert")
        new = materialize(rows, table)
        new.write.option("batchsize", self.batch_size).jdbc(self.url, table, mode="append", properties=self.properties)
        return new.count()


@dataclass
class DbApiSink:
    """Any database with a Python driver. ``connect`` runs on the executors; each partition writes in batches.

    Upserts use INSERT .. ON CONFLICT. One transaction a partition, so a partition
    that is retried after a lost executor writes once. ``partitions`` is how many
    connections write at a time at most, None as many as there are tasks.
    """

    connect: Callable[[], Any]
    batch_size: int = 1000
    marker: str = "?"
    partitions: int | None = 8

    def write(self, table: str, rows: DataFrame, mode: str, keys: list[str]) -> int:
        columns = rows.columns
        slots = ", ".join([self.marker] * len(columns))
        sql = f"INSERT INTO {table} ({', '.join(columns)}) VALUES ({slots})"
        if mode != "append" and keys:
            rest = [c for c in columns if c not in keys]
            value = (lambda c: f"{c} = coalesce(excluded.{c}, {table}.{c})") if mode == "merge" else (lambda c: f"{c} = excluded.{c}")
            change = "DO UPDATE SET " + ", ".join(map(value, rest)) if mode in ("update", "merge") and rest else "DO NOTHING"
            sql += f" ON CONFLICT ({', '.join(keys)}) {change}"
        connect, size = self.connect, self.batch_size

        def send(part: Iterator[Any]) -> Iterator[int]:
            db, count, batch = connect(), 0, []
            cursor = db.cursor()
            for row in part:
                batch.append(tuple(row))
                if len(batch) == size:
                    cursor.executemany(sql, batch)
                    count, batch = count + len(batch), []
            if batch:
                cursor.executemany(sql, batch)
                count += len(batch)
            db.commit()
            db.close()
            yield count

        rows = rows.coalesce(self.partitions) if self.partitions else rows
        return sum(rows.rdd.mapPartitions(send).collect())


@dataclass
class ClientSink:
    """A service whose client has ``table(name).insert(rows)`` and ``.upsert(rows, on_conflict=..)``, each run by ``.execute()``.

    ``connect`` makes a client on the executors; each partition sends its rows as
    dicts in batches. Such services have no transactions over batches, so a task
    that is retried sends its rows again: upsert where that matters.
    """

    connect: Callable[[], Any]
    batch_size: int = 1000
    partitions: int | None = 8

    def write(self, table: str, rows: DataFrame, mode: str, keys: list[str]) -> int:
        if mode not in ("append", "update"):
            raise ValueError("a client appends or updates")
        connect, size, upsert, conflict = self.connect, self.batch_size, mode == "update" and bool(keys), ",".join(keys) or None

        def send(part: Iterator[Any]) -> Iterator[int]:
            client, count = connect(), 0
            while batch := [r.asDict(recursive=True) for r in itertools.islice(part, size)]:
                target = client.table(table)
                answer = (target.upsert(batch, on_conflict=conflict) if upsert else target.insert(batch)).execute()
                count += len(answer.data or [])
            yield count

        rows = rows.coalesce(self.partitions) if self.partitions else rows
        return sum(rows.rdd.mapPartitions(send).collect())
