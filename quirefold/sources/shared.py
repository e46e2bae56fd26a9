"""Intermediate tables in the folder that driver and executors share.

Executors may be lost at any time and do not see each other's local disks, so tables that are read more than once are
written to the folder that the cluster names in ``spark.checkpoint.dir``. All tables of one application are in one
folder there; results are lazy and read them, so they stay until `release` is called.
"""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A session that names none gets a temporary one if all of it runs in
    one process (tests); elsewhere that is an error, as executors would write where nobody else can read."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError(f"spark.checkpoint.dir must name a shared folder on {master}")
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="quirefold-")
        atexit.register(shutil.rmtree, _own_dirs[app], ignore_errors=True)
    return f"file://{_own_dirs[app]}"


def own_folder(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables."""
    return f"{shared_dir(spark)}/quirefold/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{own_folder(spark)}/{uuid.uuid4().hex}/{name}"


def release(spark: SparkSession) -> None:
    """Delete this application's intermediate tables, once no result that reads them is needed any more."""
    _delete(spark, own_folder(spark))


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Tables written within the calls of `settle` that are under way, the innermost last.
_scopes: list[list[str]] = []


#: Whether the files of a query's exchanges go when it ends; else they stay until the driver's memory is collected.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str, clean: bool = False) -> DataFrame:
    """Write df once and read it back: cuts lineage, survives lost executors. clean: what was shuffled for it goes at once."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    if _scopes:
        _scopes[-1].append(path)
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, str(clean or before == "true").lower())
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def settle(spark: SparkSession, name: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """compute()'s rows, written; the tables that it wrote on the way are deleted, as nothing reads them any more."""
    _scopes.append([])
    try:
        out = materialize(compute(), name)
    finally:
        written = _scopes.pop()
    for path in written[:-1]:
        _delete(spark, path)
    if _scopes:
        _scopes[-1].append(written[-1])
    return out


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df, read from files, in at least as many partitions as there are cores; rows that are moved go by the keys, if any.

    A file of few row groups is read by few tasks, which would also do all work up to the next exchange. Larger inputs
    have more parts than cores and are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def parts_of(df: DataFrame, rows: int) -> int:
    """How many partitions hold so many rows of df each, as many as there are cores at least.

    Keys and small numbers take few bytes in a shuffle and many in a task's tables, so partitions put together by their bytes
    may have any number of rows."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once a session."""
    sc = spark.sparkContext
    if getattr(sc, "_quirefold_shipped", None):
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    zipped = os.path.join(tempfile.mkdtemp(prefix="quirefold-ship-"), "quirefold_pkg.zip")
    with zipfile.ZipFile(zipped, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "quirefold")):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(zipped)
    sc._quirefold_shipped = True
