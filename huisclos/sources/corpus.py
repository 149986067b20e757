"""Evaluation corpora: texts, ground truth and canaries from JSON files whose ``_`` keys are comments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, type, value) of a ``{doc: {type: [values]}}`` file."""
    raw = spark.read.text(path, wholetext=True)
    docs = raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("doc_id", "types")).where(~F.startswith("doc_id", F.lit("_")))
    kinds = docs.select("doc_id", F.explode(F.from_json("types", "map<string,array<string>>")).alias("type", "values"))
    return kinds.select("doc_id", "type", F.explode("values").alias("value"))


def read_texts(spark: SparkSession, folder: str, truth: DataFrame) -> DataFrame:
    """(doc_id, text): only files that the truth names."""
    files = spark.read.text(folder, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("doc_id"), F.col("value").alias("text"))
    return files.join(truth.select("doc_id").distinct(), "doc_id", "left_semi")


def read_canaries(spark: SparkSession, path: str) -> DataFrame:
    """(n, canary, description, extracts) in file order."""
    raw = spark.read.text(path, wholetext=True)
    shape = "struct<canaris:array<struct<id:string,description:string,extraits:array<string>>>>"
    rows = raw.select(F.posexplode(F.from_json("value", shape)["canaris"]).alias("n", "c"))
    return rows.select("n", F.col("c.id").alias("canary"), F.col("c.description").alias("description"), F.col("c.extraits").alias("extracts"))


def write_baseline(measures: DataFrame, engine: str, reference_engine: str, path: str) -> None:
    """The regression baseline, from the reference engine only."""
    if engine != reference_engine:
        raise ValueError(f"a baseline is only written for {reference_engine!r}, not {engine!r}")
    measures.select("type", "recall", "precision").coalesce(1).write.mode("overwrite").json(path)
