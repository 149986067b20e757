"""What the operators share: reading tables, written intermediate tables, words."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, ``spark.checkpoint.dir``. Only a local session without it gets a folder of its own, deleted at exit."""
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


class Written:
    """A table written once to the shared folder: cuts lineage and survives lost executors."""

    def __init__(self, df: DataFrame, *partition_by: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/{uuid.uuid4().hex}"
        writer = df.write
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(self.path)
        self.schema = df.schema

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        """Delete the files; only once every reader has been written itself."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession, factor: int = 1) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")) * factor)


def held_out(remainder: int) -> Column:
    """crc32(doc_id as text) mod 5 equals ``remainder``; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == remainder, F.lit(False))
