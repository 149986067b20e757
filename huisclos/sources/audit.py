"""The audit trail: a fixed schema of metadata, without any column that could hold a text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = {
    "at": "string",
    "request_id": "string",
    "dossier_id": "string",
    "backend": "string",
    "model": "string",
    "status": "string",
    "counts": "map<string,int>",
    "approximate_size": "long",
    "integrity": "string",
    "error_kind": "string",
    "judge_status": "string",
    "judge_candidates": "int",
}


def events(rows: DataFrame) -> DataFrame:
    """Columns of ``FIELDS`` only; those that are missing are null, all others are left behind."""
    stamped = rows if "at" in rows.columns else rows.withColumn("at", F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'"))
    return stamped.select(*((F.col(n) if n in stamped.columns else F.lit(None)).cast(k).alias(n) for n, k in FIELDS.items()))


def append(rows: DataFrame, path: str) -> None:
    events(rows).write.mode("append").json(path)
