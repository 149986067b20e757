"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Only a local session without it gets a folder of its own, deleted at exit."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        path = tempfile.mkdtemp(prefix="huisclos-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _own[app] = f"file://{path}"
    return _own[app]


def written(df: DataFrame) -> DataFrame:
    """Write once, read often: what several branches need is computed once and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(table: DataFrame) -> DataFrame:
    """Joins of ``table`` shuffle it. Spark takes files for as large as they are on disk, where millions of like rows are a few MB, and would gather them in the driver for a broadcast."""
    return table.hint("merge")


def drop(table: DataFrame | None) -> None:
    """Delete the files of a ``written`` table; only once all that reads it has been written itself."""
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()} if table is not None else ():
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
