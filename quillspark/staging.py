"""What executors share: tables written once in a common folder, and this package itself."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once a session: they need not have it installed."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="quillspark-")) / f"{package.name}.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted(package.rglob("*.py")):
            archive.write(source, source.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, under it one for this application.

    Where it is unset, a new temporary folder is taken on a local master (also one with executors, which are on the same
    machine), as in tests; on a cluster that is an error, as each executor would write to a disk of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/quillspark-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table written once in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex[:12]}")
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(table)] = (table, path)
    return table


#: The tables of ``written`` by the identity of their DataFrame, which is held so that the identity stays its own.
_PATHS: dict[int, tuple[DataFrame, str]] = {}


def unwritten(table: DataFrame) -> None:
    """Deletes a table of ``written`` that nothing will read any more."""
    known = _PATHS.pop(id(table), None)
    if known is not None:
        _delete(table.sparkSession, known[1])


def clear(spark: SparkSession) -> None:
    """Deletes all that ``written`` made in this application, once results are stored elsewhere."""
    _PATHS.clear()
    _delete(spark, shared_folder(spark))
