"""The vault at rest: one folder of new rows for each batch, dealt into buckets by dossier, and a chain of commits.

A batch reads the buckets of its own dossiers and writes what it has added, so its cost does not grow
with the vault's age. A commit is a small file whose name is the version it makes and which is created
only if it isn't there: of two writers that began at one version the second fails, and no number is
given twice. Rows of a writer that failed are in a folder no commit names, so nobody reads them.

The shared file system must create files exclusively, as HDFS and local ones do.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.coreference import RESOLVED
from ..operators.vault import SURFACES, opened, sealed


class VaultConflict(RuntimeError):
    """Another writer has committed since this one has read."""


@dataclass(frozen=True)
class Commit:
    """``whole``: the folder holds all that came before too."""

    version: int
    folder: str
    whole: bool = False


@dataclass
class VaultStore:
    """``schema`` has dossier_id. ``sensitive`` columns are sealed under ``key``, a table of one row with the column key.

    With ``identity`` a later row replaces an earlier one that agrees in those columns; without, rows are only added.
    """

    spark: SparkSession
    path: str
    key: DataFrame | None = None
    schema: str = SURFACES
    sensitive: tuple[str, ...] = ("surface",)
    identity: tuple[str, ...] = ()
    buckets: int = 256

    def _file(self, name: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def commits(self) -> list[Commit]:
        """From the latest whole one on, in order."""
        fs, folder = self._file("commits")
        if not fs.exists(folder):
            return []
        names = sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName().isdigit())
        chain: list[Commit] = []
        for name in reversed(names):
            stream = fs.open(self._file(f"commits/{name}")[1])
            try:
                held = bytes(stream.readAllBytes()).decode()
            finally:
                stream.close()
            if not held:
                raise ValueError(f"commit {name} was not finished by its writer; remove it once that writer is gone")
            chain.append(Commit(int(name), **json.loads(held)))
            if chain[-1].whole:
                break
        return chain[::-1]

    def version(self) -> int:
        """0 before the first commit."""
        chain = self.commits()
        return chain[-1].version if chain else 0

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("dossier_id"), F.lit(self.buckets)).cast("int")

    def _columns(self) -> list[str]:
        return self.spark.createDataFrame([], self.schema).columns

    def read(self, dossiers: DataFrame | None = None) -> DataFrame:
        """Rows of these dossiers, of all without; the columns of ``schema``. Only the buckets of these dossiers are opened."""
        chain, plain = self.commits(), self.spark.createDataFrame([], self.schema)
        if not chain:
            return plain
        kinds = [f"`{f.name}` {'string' if f.name in self.sensitive else f.dataType.simpleString()}" for f in plain.schema.fields]
        reader = self.spark.read.schema(", ".join([*kinds, "version long", "writer string", "bucket int"])).option("basePath", f"{self.path}/data")
        rows = reader.parquet(*(f"{self.path}/{c.folder}" for c in chain))
        if dossiers is not None:
            asked = dossiers.select("dossier_id").distinct()
            met = [r[0] for r in asked.select(self.bucket().alias("b")).distinct().collect()]  # at most ``buckets`` numbers
            rows = rows.where(F.col("bucket").isin(met)).join(asked, "dossier_id", "left_semi")
        if self.key is not None:
            rows = opened(rows, list(self.sensitive), self.key)
        if self.identity:
            latest = W.partitionBy(*self.identity).orderBy(F.desc("version"))
            rows = rows.withColumn("__n", F.row_number().over(latest)).where("__n = 1")
        return rows.select(*plain.columns)

    def _write(self, rows: DataFrame, version: int) -> str:
        folder = f"data/writer={uuid.uuid4().hex}"
        closed = rows if self.key is None else sealed(rows, list(self.sensitive), self.key)
        dealt = closed.withColumn("version", F.lit(version).cast("long")).withColumn("bucket", self.bucket())
        # a bucket goes to a few tasks, so that one with a large dossier isn't one task
        dealt.repartition("bucket", F.pmod(F.xxhash64(*rows.columns), F.lit(4))).write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        return folder

    def _commit(self, commit: Commit) -> None:
        fs, path = self._file(f"commits/{commit.version:020d}")
        try:
            out = fs.create(path, False)
        except Py4JJavaError as e:
            self._drop(commit.folder)
            if "exist" in str(e.java_exception).lower():
                raise VaultConflict(f"version {commit.version} of {self.path} is taken") from None
            raise
        try:
            out.write(json.dumps({"folder": commit.folder, "whole": commit.whole}).encode())
        finally:
            out.close()

    def _drop(self, folder: str) -> None:
        fs, path = self._file(folder)
        fs.delete(path, True)

    def append(self, new: DataFrame, expected: int) -> int:
        """Commit ``new`` as the version after ``expected``, which the writer has read; fails if that is no longer the latest.

        Without rows there is no commit. ``new`` is a written table: its numbers must be those the texts have.
        """
        if (now := self.version()) != expected:
            raise VaultConflict(f"{self.path} is at version {now}, not {expected}")
        if new.isEmpty():
            return expected
        self._commit(Commit(expected + 1, self._write(new.select(*self._columns()), expected + 1)))
        return expected + 1

    def compact(self) -> int:
        """Write all rows into one folder as a new version. The folders before it stay for readers that have begun; ``clear`` removes them."""
        chain = self.commits()
        if not chain or chain[-1].whole:
            return self.version()
        now = chain[-1].version
        self._commit(Commit(now + 1, self._write(self.read(), now + 1), True))
        return now + 1

    def clear(self) -> int:
        """Delete folders that the chain no longer names; only while nobody reads or writes. Returns how many."""
        fs, data = self._file("data")
        kept = {c.folder for c in self.commits()}
        gone = [f"data/{s.getPath().getName()}" for s in fs.listStatus(data) if f"data/{s.getPath().getName()}" not in kept] if fs.exists(data) else []
        for folder in gone:
            self._drop(folder)
        return len(gone)


def people_store(spark: SparkSession, vault: str, key: DataFrame | None = None) -> VaultStore:
    """The people beside the surfaces of the vault at ``vault``; a surface's latest canonical name counts."""
    return VaultStore(spark, f"{vault}/people", key, RESOLVED, ("surface", "canonical"), ("dossier_id", "surface"))
