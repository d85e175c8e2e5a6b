"""New batches checked for repeats against everything accepted before.

A ``History`` is a folder of tables. Every record that can be identified has a
*node*, its canonical text: literal repeats share it. Near repeats are two texts
one keying slip apart whose records also agree in some value. Each (agreeing
value, text) is an *entry*; it is persisted under its minwise band keys, which are
made of a minwise value and the agreeing value, with a signature. The keys are
partitioned by the hash of the band key. A batch shuffles its own keys to these
partitions, probes the persisted ones where they lie, verifies what meets there by
signature and then by the texts, and appends the entries that are new. Accepted
history is never shuffled and never compared with itself again.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.llm.components import connected_components
from treeloom.llm.slips import alike, band_keys, deletions, minwise, one_slip
from treeloom.runtime import drop_path, make_folder, partitions_of, path_exists, scratch_path

#: A persisted row's share of memory in a hash table, in bytes.
ROW_BYTES = 200


class History:
    """Accepted records of one table.

    bands: minwise values, each a band of its own. Two texts of n characters one
    slip apart are alike by (n - 1) / (n + 1) or more, so a pair escapes all bands
    with probability (2 / (n + 1)) ** bands at most.
    buckets: hash partitions of the persisted tables, by default twice as many as
    the cluster has cores; a history that is opened again keeps its number.
    hot: a persisted key is compared with up to this many of a new batch. A band key
    with more new entries is not paired up; its entries meet under hashes of their
    one-character deletions instead, which is exact too.
    hash_bytes: what a batch brings to one partition is held in a hash table up to
    this size, and sorted beyond it. broadcast_rows: the list of hot band keys is
    broadcast up to this many rows (8 bytes each), and shuffled beyond.

    A batch counts once its mark is written, which is the last step; what a failed
    attempt left behind is replaced by the next.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, *, bands: int = 4, buckets: int | None = None, hot: int = 1000, hash_bytes: int = 64 << 20, broadcast_rows: int = 1_000_000):
        self.spark, self.path = spark, path or scratch_path(spark, "history")
        self.bands, self.hot, self.hash_bytes, self.broadcast_rows = bands, hot, hash_bytes, broadcast_rows
        kept = partitions_of(spark, f"{self.path}/layout") if path_exists(spark, f"{self.path}/layout") else []
        self.buckets = int(kept[0].partition("=")[2]) if kept else buckets or max(8, 2 * spark.sparkContext.defaultParallelism)
        if not kept:
            make_folder(spark, f"{self.path}/layout/buckets={self.buckets}")
        self._tables = {}
        for name, by, columns in (("entries", "id", "id BIGINT, check BIGINT, text STRING, node STRING"), ("keys", "band", "band BIGINT, id BIGINT, signature BIGINT")):
            table = self._tables[name] = f"treeloom_{name}_{xxhash.xxh3_64_hexdigest(self.path)}"
            spark.sql(
                f"CREATE TABLE IF NOT EXISTS {table} ({columns}, batch INT) USING parquet OPTIONS (compression 'zstd') PARTITIONED BY (batch) CLUSTERED BY ({by}) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'"
            )
            if kept:
                spark.sql(f"ALTER TABLE {table} RECOVER PARTITIONS")

    def batches(self) -> list[int]:
        """Numbers of the accepted batches."""
        if not path_exists(self.spark, f"{self.path}/accepted"):
            return []
        return sorted(int(n.partition("=")[2]) for n in partitions_of(self.spark, f"{self.path}/accepted"))

    def _read(self, name: str, schema: str, upto: int | None = None) -> DataFrame:
        paths = [f"{self.path}/{name}/batch={n}" for n in self.batches() if upto is None or n <= upto]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(*paths)

    def rows(self, upto: int | None = None) -> DataFrame:
        """(key, node, batch) of every identified record."""
        return self._read("rows", "key bigint, node string, batch int", upto)

    def links(self, upto: int | None = None) -> DataFrame:
        """(a, b) nodes one slip apart."""
        return self._read("links", "a string, b string, batch int", upto).drop("batch")

    def _table(self, name: str, *numbers: int) -> DataFrame:
        return self.spark.table(self._tables[name]).where(F.col("batch").isin(*numbers))

    def accept(self, batch: DataFrame, number: int) -> None:
        """Check one batch against the history and add it; a batch that is in already is left as it is.

        batch(key, texts array<string>, agree array<bigint>): texts are a record's
        canonical writings, the first its identity; a record with none denotes
        nothing and is left out, and so is one without key, which no answer could name.
        agree has hashes of what near repeats must agree in. Null elements of either array are ignored.
        """
        earlier = self.batches()
        if number in earlier:
            return
        self._clear(number)
        known = batch.where(F.col("key").isNotNull() & F.exists("texts", lambda t: t.isNotNull())).withColumn("texts", F.array_compact("texts")).withColumn("node", F.element_at("texts", 1))
        known.select("key", "node").write.mode("overwrite").parquet(f"{self.path}/rows/batch={number}")
        entries = known.select("node", "texts", F.explode("agree").alias("agree")).where("agree IS NOT NULL").select("node", "agree", F.explode("texts").alias("text"))
        # two hashes: the first places and names an entry, both together are its identity
        ids = F.xxhash64("agree", "text", "node").alias("id"), F.xxhash64(F.lit("check"), "agree", "text", "node").alias("check")
        entries = entries.select(*ids, "agree", "text", F.when(F.col("node") != F.col("text"), F.col("node")).alias("node")).repartition(self.buckets, "id").distinct()
        with _joined_in_place(self.spark):
            if earlier:
                rows = self.spark.read.parquet(f"{self.path}/rows/batch={number}").count()
                kept = self._table("entries", *earlier).select("id", "check", F.lit(True).alias("kept"))
                # an outer join, since of an anti join only the history could be held in memory
                entries = self._small(entries, 2 * rows).join(kept, ["id", "check"], "left").where("kept IS NULL").drop("kept")
            path = scratch_path(self.spark, "entries")
            entries.write.option("compression", "zstd").parquet(path)
            entries = self.spark.read.schema(entries.schema).parquet(path)
            entries.select("id", "check", "text", "node", F.lit(number).alias("batch")).write.insertInto(self._tables["entries"])
            banded = entries.select("id", "agree", "text").mapInArrow(_bander(self.bands), "id bigint, signature bigint, bands array<bigint>")
            keys = banded.select(F.explode("bands").alias("band"), "id", "signature", F.lit(number).alias("batch")).repartition(self.buckets, "band")
            keys.write.insertInto(self._tables["keys"])
            drop_path(self.spark, path)
            if path_exists(self.spark, f"{self.path}/keys/batch={number}"):
                links, scratch = self._link(number, earlier)
                links.write.mode("overwrite").parquet(f"{self.path}/links/batch={number}")
                for used in scratch:
                    drop_path(self.spark, used)
        make_folder(self.spark, f"{self.path}/links/batch={number}")
        make_folder(self.spark, f"{self.path}/accepted/batch={number}")

    def _clear(self, number: int) -> None:
        for table in self._tables.values():
            self.spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION (batch = {number})")
        for name in ("rows", "links", *self._tables):
            drop_path(self.spark, f"{self.path}/{name}/batch={number}")

    def _small(self, df: DataFrame, rows: int) -> DataFrame:
        """The frame as the side of a hash join that is held in memory, if its share of a partition is small."""
        return df.hint("shuffle_hash") if rows * ROW_BYTES <= self.hash_bytes * self.buckets else df

    def _link(self, number: int, earlier: list[int]) -> tuple[DataFrame, list[str]]:
        """(a, b) of the nodes of new entries and of those that are one slip apart; and what can be dropped once they are written."""
        scratch = [scratch_path(self.spark, name) for name in ("hot", "alike")]
        new = self._table("keys", number).select("band", "id", "signature")
        old = self._table("keys", *earlier).select("band", "id", "signature") if earlier else None
        rows = new.count()
        hot = new.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > self.hot).select("band")
        hot.write.parquet(scratch[0])
        hot = self.spark.read.schema(hot.schema).parquet(scratch[0])
        n_hot = hot.count()
        sides = [new] if old is None else [new, old]
        pairs = []
        if n_hot:
            listed = F.broadcast(hot) if n_hot <= self.broadcast_rows else hot
            texts = self._table("entries", number, *earlier).select("id", "text")
            spread = [s.join(listed, "band", "left_semi").join(texts, "id").withColumn("less", F.explode(deletions(F.col("text")))) for s in sides]
            pairs += [_meeting(spread[0], s, ["band", "less"], s is spread[0]) for s in spread]
            new = new.join(listed, "band", "left_anti")
        left = self._small(new, rows)
        pairs += [_meeting(left, new if s is sides[0] else s, ["band"], s is sides[0]) for s in sides]
        met = reduce(DataFrame.unionByName, pairs).distinct()
        met.write.parquet(scratch[1])
        return self._verified(self.spark.read.schema(met.schema).parquet(scratch[1]), number, earlier), scratch

    def _verified(self, met: DataFrame, number: int, earlier: list[int]) -> DataFrame:
        """Links of the pairs(x, y) of entries, x of the new batch, whose texts are one slip apart."""
        side = lambda entries, i: entries.select(F.col("id").alias(i), F.coalesce("node", "text").alias(f"n{i}"), F.col("text").alias(f"t{i}"))
        n = met.count()
        first = self._small(met, n).join(side(self._table("entries", number), "x"), "x")
        both = self._small(first, n).join(side(self._table("entries", number, *earlier), "y"), "y")
        apart = both.where((F.col("nx") != F.col("ny")) & one_slip(F.col("tx"), F.col("ty")))
        return apart.select(F.least("nx", "ny").alias("a"), F.greatest("nx", "ny").alias("b")).distinct()

    def repeats(self, batch: int | None = None) -> DataFrame:
        """(key_a, key_b) of each record of batch 1 or later with the earliest record that denotes the same, smaller key first.

        Records come in the order of (batch, key). Sameness carries over along
        links, whichever batch brought them. With ``batch``, the answer for this
        batch as it stood when it was accepted. Only keys, nodes and links are read.
        """
        labels = connected_components(self.links(batch))
        rows = self.rows(batch).join(labels, "node", "left").select("batch", "key", F.coalesce("root", "node").alias("cls"))
        asked = rows.where("batch >= 1") if batch is None else rows.where(F.col("batch") == batch)
        if batch is not None:
            rows = rows.join(asked.select("cls").distinct(), "cls", "left_semi")
        # batch and key as one number, of which hash aggregation keeps the least; a key is far smaller than a batch's step
        step = F.lit(str(10**20)).cast("decimal(21,0)")
        place = lambda: (F.col("batch").cast("decimal(11,0)") * step + F.col("key").cast("decimal(20,0)")).alias("place")
        first = rows.select("cls", place()).groupBy("cls").agg(F.min("place").alias("first"))
        if self.rows(batch).count() * ROW_BYTES <= self.hash_bytes * int(self.spark.conf.get("spark.sql.shuffle.partitions")):
            first = first.hint("shuffle_hash")
        later = asked.select("cls", "key", place()).join(first, "cls").where("first < place")
        key = (F.col("first") - F.round(F.col("first") / step).cast("decimal(11,0)") * step).cast("bigint")
        return later.select("key", key.alias("first")).select(F.least("key", "first").alias("key_a"), F.greatest("key", "first").alias("key_b")).distinct()


def _meeting(new: DataFrame, other: DataFrame, on: list[str], same: bool) -> DataFrame:
    """(x, y) of the entries that meet under a key and may be one slip apart, x new; the signature cannot lose a pair."""
    left = new.select(*on, F.col("id").alias("x"), F.col("signature").alias("sx"))
    right = other.select(*on, F.col("id").alias("y"), F.col("signature").alias("sy"))
    pairs = left.join(right, on).where(alike(F.col("sx"), F.col("sy")) & (F.col("x") < F.col("y") if same else F.col("x") != F.col("y")))
    return pairs.select("x", "y").distinct()


@contextmanager
def _joined_in_place(spark: SparkSession) -> Iterator[None]:
    """Tables partitioned by one of several join keys are joined where they lie."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _bander(bands: int):
    """Signature and band keys of entries (id, agree, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            coded = batch.column("text").dictionary_encode()
            mins, signatures = minwise(coded.dictionary.to_pylist(), bands)
            at = coded.indices.to_numpy()
            keys = band_keys(mins[at], batch.column("agree").to_numpy())
            listed = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, bands, dtype=np.int32), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(signatures[at]), listed], names=["id", "signature", "bands"])

    return run


def deduplicate(batches: DataFrame, *, batch: str, key: str, texts: Column, agree: Column, bands: int = 4, path: str | None = None) -> History:
    """Feed a table to a new history, batch by batch in the order of ``batch``.

    Rows without batch number count as history (batch 0). An empty table leaves an
    empty history. Rows with a null key are left out.
    """
    spark = batches.sparkSession
    history = History(spark, path, bands=bands)
    hashed = F.transform(agree, lambda a: F.when(a.isNotNull(), F.xxhash64(a)))
    columns = [F.col(key).cast("long").alias("key"), texts.alias("texts"), hashed.alias("agree"), F.coalesce(F.col(batch).cast("int"), F.lit(0)).alias("batch")]
    path, prepared = scratch_path(spark, "prepared"), batches.select(*columns)
    prepared.write.partitionBy("batch").option("compression", "zstd").parquet(path)
    prepared = spark.read.schema(prepared.schema).parquet(path)
    numbers = sorted(r[0] for r in prepared.select("batch").distinct().collect())
    for n in numbers:
        history.accept(prepared.where(F.col("batch") == n).drop("batch"), n)
    drop_path(spark, path)
    return history
