"""The vault: placeholders of surface forms by dossier, as tables.

``surfaces``: (dossier_id, type, surface, placeholder, number); ``canonical``: (dossier_id, placeholder,
type, value). Numbers follow the first appearance (seq, start) of each exact surface in its dossier
and label, after those already given, and are never given again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.labels import label, placeholder

SURFACES = "dossier_id string, type string, surface string, placeholder string, number long"
CANONICAL = "dossier_id string, placeholder string, type string, value string"
#: Consecutive seq values that are numbered together; a dossier of any size is spread over many such runs.
RUN = 4096


def number_surfaces(mentions: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The vault's surfaces, old and new, after ``mentions``; see ``new_surfaces``."""
    new = new_surfaces(mentions, known)
    return new if known is None else known.select(*new.columns).unionByName(new)


def new_surfaces(mentions: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``mentions``: (dossier_id, seq, start, type, surface). Returns the rows that the vault has to add.

    ``known`` needs to hold the dossiers of ``mentions`` only, but those whole.
    Only distinct surfaces are numbered. Runs of ``RUN`` seq values are ranked on their own and laid
    end to end by their counts, so that a dossier with most of the rows is not one task.
    """
    first = mentions.groupBy("dossier_id", "type", "surface").agg(F.min(F.struct("seq", "start")).alias("first"))
    if known is not None:
        first = first.join(known.select("dossier_id", "type", "surface"), ["dossier_id", "type", "surface"], "left_anti")
    runs = first.withColumn("label", label(F.col("type"))).withColumn("run", F.floor(F.col("first.seq") / RUN))
    sizes = runs.groupBy("dossier_id", "label", "run").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("dossier_id", "label").orderBy("run")) - F.col("n")
    offsets = sizes.select("dossier_id", "label", "run", before.alias("before"))
    if known is not None:
        top = known.groupBy("dossier_id", label(F.col("type")).alias("label")).agg(F.max("number").alias("top"))
        offsets = offsets.join(top, ["dossier_id", "label"], "left").withColumn("before", F.col("before") + F.coalesce("top", F.lit(0))).drop("top")
    order = W.partitionBy("dossier_id", "label", "run").orderBy("first", "surface")
    numbered = runs.withColumn("row", F.row_number().over(order)).join(offsets, ["dossier_id", "label", "run"]).withColumn("number", F.col("before") + F.col("row"))
    return numbered.select("dossier_id", "type", "surface", placeholder(F.col("type"), F.col("number")).alias("placeholder"), "number")


def canonical_of(surfaces: DataFrame) -> DataFrame:
    """A placeholder's surface (the smallest, if aliases share it) is its canonical value, unless coreference has chosen another."""
    return surfaces.groupBy("dossier_id", "placeholder").agg(F.min("type").alias("type"), F.min("surface").alias("value"))


def value_for(tokens: DataFrame, canonical: DataFrame) -> DataFrame:
    """``tokens`` (dossier_id, placeholder, ...) plus value, null where unknown."""
    return tokens.join(canonical.select("dossier_id", "placeholder", "value"), ["dossier_id", "placeholder"], "left")


def known_placeholders(canonical: DataFrame) -> DataFrame:
    """(dossier_id, placeholder): a row for each, so a dossier may have any number."""
    return canonical.select("dossier_id", "placeholder").distinct()


def surfaces_of(surfaces: DataFrame, kind: str) -> DataFrame:
    return surfaces.where(F.col("type") == kind).select("dossier_id", "surface", "placeholder")


def upsert(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``changes`` replace those with equal keys: aliases, canonical values, modes, surrogates."""
    return table.join(changes.select(*keys), keys, "left_anti").unionByName(changes)


def purge(table: DataFrame, dossiers: DataFrame) -> DataFrame:
    """Drop the mappings of these dossiers; mode and policy tables are left alone by their owners."""
    return table.join(dossiers.select("dossier_id").distinct(), "dossier_id", "left_anti")


def guard_modes(modes: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests`` (dossier_id, mode) plus refused: a demo request while any dossier is serious, or a serious one for a demo dossier."""
    serious = modes.where("mode = 'serieux'").select(F.lit(True).alias("any_serious")).limit(1)
    asked = requests.join(modes.select("dossier_id", F.col("mode").alias("stored")), "dossier_id", "left")
    asked = asked.join(F.broadcast(serious.agg(F.count("*").alias("n_serious"))))  # one row
    refused = F.when((F.col("mode") == "demo") & (F.col("n_serious") > 0), "demo_refused").when((F.col("mode") == "serieux") & (F.col("stored") == "demo"), "conflict")
    return asked.select(*requests.columns, refused.alias("refused"))


def key_table(spark: SparkSession, key: str | None = None, path: str | None = None) -> DataFrame:
    """A key as a table of one row, from a secret file or from memory. A plan that joins it names the column ``key`` and not its value."""
    if (key is None) == (path is None):
        raise ValueError("the key comes from memory or from a file")
    rows = spark.read.text(path, wholetext=True).select(F.rtrim(F.col("value"), F.lit("\r\n")).alias("key")) if path else spark.createDataFrame([(key,)], "key string")
    return rows


def _with_key(table: DataFrame, key: DataFrame) -> DataFrame:
    return table.crossJoin(F.broadcast(key.select(F.col("key").alias("__key")).limit(1)))  # one row


def sealed(table: DataFrame, columns: list[str], key: DataFrame) -> DataFrame:
    """Sensitive columns under AES-GCM, base64; nulls stay null. ``key``: ``key_table``, so that no plan holds the key."""
    keyed = _with_key(table, key)
    return keyed.withColumns({c: F.base64(F.aes_encrypt(F.col(c), F.col("__key"), F.lit("GCM"))) for c in columns}).drop("__key")


def opened(table: DataFrame, columns: list[str], key: DataFrame) -> DataFrame:
    """The inverse of ``sealed``; columns that an older file lacks come back null."""
    missing = {c: F.lit(None).cast("string") for c in columns if c not in table.columns}
    keyed = _with_key(table.withColumns(missing), key)
    return keyed.withColumns({c: F.aes_decrypt(F.unbase64(F.col(c)), F.col("__key"), F.lit("GCM")).cast("string") for c in columns}).drop("__key")
