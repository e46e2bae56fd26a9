"""Code shipping, keys and intermediate tables for the operators of this subpackage.

Intermediate tables go to the folder that the cluster names in ``spark.checkpoint.dir`` (see sources/shared.py):
executors may be lost at any time and do not see each other's local disks, so nothing is kept in local folders.
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.sources import shared
from quirefold.sources.shared import fresh_path, release, settle

__all__ = ["fresh_path", "keyed", "materialize", "prepare", "read_table", "release", "settle", "unused"]

#: Rows of a table that go to a Python worker at once. Texts may be long, so this is far below Spark's default.
ARROW_ROWS = 512
#: Bytes of such a batch.
ARROW_BYTES = 16 << 20

#: Rows of a table of a few narrow columns that one task writes at most, where the number of rows is known.
NARROW_ROWS_PER_TASK = 200_000


def materialize(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage and survives lost executors.

    rows: about how many rows of a few narrow columns it has at most, if known; few rows then go to few files."""
    if rows is not None:
        df = df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // NARROW_ROWS_PER_TASK)))
    return shared.materialize(df, name)


def prepare(spark: SparkSession) -> SparkSession:
    """Make this package importable in Python workers and bound the Arrow batches they get.

    The bounds are settings of the session and stay, as results are computed later than this call; a smaller bound that
    the session already has is kept."""
    sc = spark.sparkContext
    if getattr(sc, "_quirefold_shipped", None) is None:
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
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark


def unused(df: DataFrame, name: str) -> str:
    """The name, with as many underscores before it as make it new to df, whatever the letters' case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def keyed(df: DataFrame, id_col: str) -> tuple[DataFrame, str]:
    """df and the name of an integer column that tells its rows apart.

    That is id_col, if it holds whole numbers and none is null or repeated. Else the rows are written once with a number
    of their own, so that null and repeated ids are judged by their own texts."""
    ids = df.select(F.col(id_col).alias("_id"))
    if ids.dtypes[0][1] in ("tinyint", "smallint", "int", "bigint"):
        if not ids.groupBy("_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1 or _id is null").head(1):
            return df, id_col
    key = unused(df, "_row")
    return materialize(df.withColumn(key, F.monotonically_increasing_id()), "keyed"), key


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
