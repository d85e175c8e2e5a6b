"""Documents as frames: from Python objects, JSON text, or frames whose rows are documents."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeloom.plans.tables import Root
from treeloom.plans.values import VARIANT
from treeloom.runtime import materialize, ship


def session() -> SparkSession:
    found = SparkSession.getActiveSession()
    if found is None:
        raise RuntimeError("no active Spark session")
    ship(found)
    return found


def from_objects(documents: list[Any], *, schema: T.DataType | str | None = None, spark: SparkSession | None = None) -> Root:
    """One document an object. With a schema they are typed, otherwise VARIANT, whose object keys come in order of name."""
    spark = spark or session()
    rows = [(i, json.dumps(d, default=str)) for i, d in enumerate(documents)]
    return from_json(spark.createDataFrame(rows, "__at bigint, body string"), "body", schema=schema)


def from_json(frame: DataFrame, column: str, *, schema: T.DataType | str | None = None, order_by: str | None = None) -> Root:
    """One document a row of JSON text; a text that is no JSON is a null document."""
    if schema is None:
        doc, dtype = F.try_parse_json(F.col(column).cast("string")), VARIANT
    else:
        dtype = T.DataType.fromDDL(schema) if isinstance(schema, str) else schema
        if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
            doc = F.from_json(F.col(column).cast("string"), dtype)
        else:
            doc = F.try_parse_json(F.col(column).cast("string"))
            dtype = VARIANT
    keep = [c for c in ("__at", "__chunk") if c in frame.columns]
    at = [F.col(order_by).cast("long").alias("__at")] if order_by else []
    return Root(frame.select(doc.alias("__doc"), *at, *(F.col(c) for c in keep if not (at and c == "__at"))), dtype)


def from_rows(frame: DataFrame, *, doc: str | None = None, order_by: str | None = None) -> Root:
    """One document a row: the column ``doc``, or the whole row as an object. ``order_by`` is a number that orders the documents."""
    keep = [c for c in ("__at", "__chunk") if c in frame.columns]
    fields = [c for c in frame.columns if c not in keep]
    node = F.col(doc) if doc else F.struct(*(F.col(f"`{c}`") for c in fields))
    at = [F.col(order_by).cast("long").alias("__at")] if order_by else []
    docs = frame.select(node.alias("__doc"), *at, *(F.col(c) for c in keep if not (at and c == "__at")))
    return Root(docs, docs.schema["__doc"].dataType)


def as_root(source: Any, spark: SparkSession | None = None) -> Root:
    """A root of whatever a pipeline is given: a root, a frame of documents, or one Python document."""
    if isinstance(source, Root):
        return source
    if isinstance(source, DataFrame):
        return from_rows(source)
    return from_objects([source], spark=spark)


def consecutive_groups(frame: DataFrame, key: str, order_by: str, name: str = "__chunk") -> DataFrame:
    """Number the runs of equal keys along ``order_by``: rows of a key that comes again later are another run.

    Run starts are found by comparing neighbours and numbered by a running sum
    over range partitions: only one count a partition is summed in one place.
    """
    parts = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = frame.repartitionByRange(parts, order_by).sortWithinPartitions(order_by).withColumn("__part", F.spark_partition_id())
    ranged = materialize(ranged, "runs")
    along = Window.partitionBy("__part").orderBy(order_by)
    first = F.lag(F.struct(F.col(key).alias("k"))).over(along)
    marked = ranged.withColumn("__new", F.when(first.isNull() | ~first["k"].eqNullSafe(F.col(key)), 1).otherwise(0))
    marked = marked.withColumn("__run", F.sum("__new").over(along))
    ends = ranged.groupBy("__part").agg(F.min_by(F.struct(F.col(key).alias("k")), order_by).alias("first"), F.max_by(F.struct(F.col(key).alias("k")), order_by).alias("last"))
    runs = marked.groupBy("__part").agg(F.max("__run").alias("n")).join(ends, "__part")
    over = Window.orderBy("__part")  # one row a partition
    before = F.coalesce(F.sum("n").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = F.when(F.lag("last").over(over)["k"].eqNullSafe(F.col("first")["k"]) & (F.row_number().over(over) > 1), 1).otherwise(0)
    shifts = runs.withColumn("__joined", joined).withColumn("__before", before).withColumn("__shift", F.col("__before") - F.sum("__joined").over(over.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.join(F.broadcast(shifts.select("__part", "__shift")), "__part").withColumn(name, (F.col("__run") + F.col("__shift")).cast("long")).drop("__part", "__new", "__run", "__shift")
