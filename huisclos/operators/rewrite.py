"""Writing placeholders into texts and values back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.regex import matches, rebuild
from ..plans.materialize import written
from ..sources.audit import events
from .search import values_in_texts

NUMBERED = r"\[[A-Z_]+_\d{3,}\]"
NONE = "array<struct<start:int,end:int,replacement:string>>"


def replace_spans(docs: DataFrame, replacements: DataFrame, keys: list[str], text: str = "text", out: str = "protected") -> DataFrame:
    """``replacements``: ``keys``, start, end, replacement; disjoint in each text. Texts without any are unchanged."""
    spans = replacements.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "end", "replacement"))).alias("__spans"))
    joined = docs.join(spans, keys, "left")
    return joined.withColumn(out, F.when(F.col("__spans").isNull(), F.col(text)).otherwise(rebuild(F.col(text), F.col("__spans")))).drop("__spans")


def placeholders_in(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(``keys``, start, end, placeholder): a row for each numbered token."""
    # ``explode`` would have the matches evaluated twice; see ``span_rows``
    found = docs.where(F.col(text).contains("[")).select(*keys, F.explode_outer(matches(F.col(text), NUMBERED)).alias("m")).where("m IS NOT NULL")
    return found.select(*keys, F.col("m.start").alias("start"), F.col("m.end").alias("end"), F.col("m.value").alias("placeholder"))


def reidentify(replies: DataFrame, canonical: DataFrame, keys: list[str], text: str = "text", out: str = "restored", surrogates: DataFrame | None = None) -> DataFrame:
    """Known placeholders become their canonical values; unknown ones stay. ``keys`` include dossier_id.

    Tokens join the vault by (dossier, placeholder), so a dossier's vault may have any size.
    """
    if surrogates is not None:
        replies = restore_surrogates(replies, surrogates, text)
    tokens = placeholders_in(replies, keys, text).join(canonical.select("dossier_id", "placeholder", F.col("value").alias("replacement")), ["dossier_id", "placeholder"])
    return replace_spans(replies, tokens.select(*keys, "start", "end", "replacement"), keys, text, out)


def restore_surrogates(replies: DataFrame, surrogates: DataFrame, text: str = "text") -> DataFrame:
    """Fake names back to placeholders, the longest first, exact matches only.

    A text meets only those names of its dossier that stand in it, so no dossier's names are in one row.
    """
    held = written(replies.withColumn("__row", F.monotonically_increasing_id()))
    met = values_in_texts(held.select("dossier_id", "__row", text), surrogates.select("dossier_id", F.col("surrogate").alias("value")), ["dossier_id"], text)
    named = met.select("dossier_id", "__row", F.col("value").alias("surrogate")).join(surrogates.select("dossier_id", "surrogate", "placeholder"), ["dossier_id", "surrogate"])
    lists = named.groupBy("__row").agg(F.array_sort(F.collect_list(F.struct((-F.length("surrogate")).alias("o"), "surrogate", "placeholder"))).alias("__pairs"))
    restored = F.aggregate("__pairs", F.col(text), lambda acc, p: F.replace(acc, p["surrogate"], p["placeholder"]))
    return held.join(lists, "__row", "left").withColumn(text, F.when(F.col("__pairs").isNull(), F.col(text)).otherwise(restored)).select(*replies.columns)


def reidentify_audited(replies: DataFrame, canonical: DataFrame, keys: list[str], text: str = "text", out: str = "restored") -> tuple[DataFrame, DataFrame]:
    """(replies with values, audit rows): an event for each dossier with the number of placeholders asked for, and no text."""
    asked = placeholders_in(replies, keys, text).groupBy("dossier_id").agg(F.count("*").cast("int").alias("n"))
    trail = asked.select("dossier_id", F.lit("reidentified").alias("status"), F.create_map(F.lit("placeholders"), "n").alias("counts"))
    return reidentify(replies, canonical, keys, text, out), events(trail)
