"""Session helpers shared by all operators: shared storage, lineage cuts, sizes."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
_shipped: set[str] = set()
_scratch: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, from ``spark.checkpoint.dir``.

    Only in local mode, where all executors share one disk, a temporary folder
    stands in for an unset value. On a cluster an unset value is an error.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    master = spark.sparkContext.master
    if not re.match(r"local(\[|$)", master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="treeloom-")
        atexit.register(shutil.rmtree, _local[app], ignore_errors=True)
    return "file://" + _local[app]


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once an application, so that Python workers need no installed copy."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="treeloom-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder) / "treeloom.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's own folder, which is removed when the driver ends."""
    ship(spark)
    folder = f"{shared_dir(spark)}/treeloom-{spark.sparkContext.applicationId}"
    if folder not in _scratch:
        _scratch.add(folder)
        make_folder(spark, folder)
        system, target = _hadoop(spark, folder)
        system.deleteOnExit(target)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table", partition_by: list[str] | None = None) -> DataFrame:
    """Cut the lineage with a parquet table in the shared folder.

    Unlike a cached or locally checkpointed frame it survives a lost executor,
    and unlike ``checkpoint()`` it stays columnar, so later reads are pruned.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _hadoop(spark: SparkSession, path: str):
    """The file system of a path, and the path as that knows it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def drop_path(spark: SparkSession, path: str) -> None:
    system, target = _hadoop(spark, path)
    system.delete(target, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    system, target = _hadoop(spark, path)
    return system.exists(target)


def make_folder(spark: SparkSession, path: str) -> None:
    system, target = _hadoop(spark, path)
    system.mkdirs(target)


def list_folder(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies right below a folder; none if there is no such folder."""
    system, target = _hadoop(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(target)) if system.exists(target) else []


def partitions_of(spark: SparkSession, path: str) -> list[str]:
    """Names of the partition folders right below a table's folder."""
    return [n for n in list_folder(spark, path) if "=" in n]


def read_text(spark: SparkSession, path: str) -> str:
    system, target = _hadoop(spark, path)
    stream = system.open(target)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there as a whole or not at all; it must be new."""
    system, target = _hadoop(spark, path)
    _, draft = _hadoop(spark, f"{path[: path.rindex('/')]}/.{uuid.uuid4().hex}")
    stream = system.create(draft, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    if system.exists(target) or not system.rename(draft, target):
        system.delete(draft, False)
        raise RuntimeError(f"{path} was written by someone else")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
