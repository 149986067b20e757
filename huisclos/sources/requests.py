"""Chat requests from JSON documents, read strictly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.regex import let
from ..functions.strict_json import whole_json

REQUEST = "struct<model:string,messages:array<struct<role:string,content:string>>,stream:boolean,temperature:double,max_tokens:int>"
INVALID = "RequeteInvalide"


def _kind(v: Column, path: str) -> Column:
    """A Variant's type at a path; null where nothing is there."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def request_of(raw: Column) -> Column:
    """``REQUEST``, or null for what is no request.

    model is a text; messages is a list of objects whose role and content are texts; stream is true or false (false if
    absent); temperature is a number and max_tokens a whole one, both absent or null too. Other keys are passed over; a
    number in quotes is no number. A key that stands twice is refused.
    """
    absent = lambda kind: kind.isNull() | (kind == "VOID")
    number = lambda kind: kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")

    def message(m: Column) -> Column:
        return F.struct(F.try_variant_get(m, "$.role", "string").alias("role"), F.try_variant_get(m, "$.content", "string").alias("content"))

    def read(v: Column) -> Column:
        messages = F.try_variant_get(v, "$.messages", "array<variant>")
        told = F.forall(messages, lambda m: F.coalesce((_kind(m, "$.role") == "STRING") & (_kind(m, "$.content") == "STRING"), F.lit(False)))
        stream, warm, most = _kind(v, "$.stream"), _kind(v, "$.temperature"), _kind(v, "$.max_tokens")
        limit = F.try_variant_get(v, "$.max_tokens", "double")
        tests = [
            F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), _kind(v, "$.model") == "STRING", messages.isNotNull() & told,
            stream.isNull() | (stream == "BOOLEAN"), absent(warm) | number(warm), absent(most) | (number(most) & (limit == F.floor(limit)) & (F.abs(limit) < 2.0**31)),
        ]
        sound = tests[0]
        for t in tests[1:]:
            sound = sound & t
        fields = [
            F.try_variant_get(v, "$.model", "string").alias("model"), F.transform(messages, message).alias("messages"), F.coalesce(F.try_variant_get(v, "$.stream", "boolean"), F.lit(False)).alias("stream"),
            F.try_variant_get(v, "$.temperature", "double").alias("temperature"), limit.try_cast("int").alias("max_tokens"),
        ]
        return F.when(F.coalesce(sound, F.lit(False)), F.struct(*fields)).cast(REQUEST)

    return let(whole_json(raw), read)


def read_requests(documents: DataFrame, raw: str = "raw") -> DataFrame:
    """``documents`` plus request and error_kind, one of them null."""
    read = documents.withColumn("request", request_of(F.col(raw)))
    return read.withColumn("error_kind", F.when(F.col("request").isNull(), INVALID))
