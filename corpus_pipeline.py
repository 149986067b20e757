"""Corpus cleaning as a chain of operators over ``documents``.

Each stage takes (spark, docs, sf_dir), where ``docs`` is all that the stage before kept, and returns
a DataFrame; all but the last return the columns of ``docs``. ``run`` writes each stage's result to
the shared folder and reads it again for the next one.

Null ids and repeated ids are allowed: stages that drop rows mark rows by a SHA-256 of id and text, so
only rows equal in both share their fate, except that of a group of near copies exactly one row stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from huisclos.llm.common import Written, read_table
from huisclos.llm.decontaminate import contaminated_pairs
from huisclos.llm.mixing import made_names, mix_documents
from huisclos.llm.near_copies import near_copy_components
from huisclos.llm.sharding import shard_documents
from huisclos.llm.toxicity import fit_toxicity, score_texts


def row_key() -> Column:
    """Rows with the same key have the same id and text; a null differs from every value."""
    return F.sha2(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce(F.concat(F.lit("text:"), F.col("text")), F.lit("null"))).cast("binary"), 256)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity of 0.5 or more go."""
    net = fit_toxicity(docs, read_table(spark, sf_dir, "labels"))
    return score_texts(docs, net, "__toxicity").where("__toxicity < 0.5").drop("__toxicity")


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (five-word shingles, Jaccard 0.8) the row with the smallest id stays (null last; ties: the smallest key).

    Links come from SimHash fingerprints through Golay keys, and beyond their two bits from MinHash bands; each is checked exactly.
    The first row of a shingle set is found with map-side limits, then the first one of a component.
    """
    keyed = docs.withColumn("__key", row_key())
    order = [F.asc_nulls_last("doc_id"), F.asc("__key")]
    components = near_copy_components(keyed, "__key", ("doc_id", "__key"), order)
    best = components.withColumn("n", F.row_number().over(W.partitionBy("component").orderBy(*order))).where("n = 1")
    keys = Written(best.select("__key").distinct())
    kept = keyed.join(keys.read(), "__key", "left_semi")
    if kept.select("__key").count() > keys.read().count():  # rows equal in id and text
        kept = kept.dropDuplicates(["__key"])
    return kept.select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    keyed = docs.withColumn("__key", row_key())
    pairs = contaminated_pairs(keyed, read_table(spark, sf_dir, "benchmark"), key="__key")
    found = Written(pairs.select("__key").distinct()).read()
    return keyed.join(found, "__key", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens meet the tempered targets of source, language and topic."""
    return mix_documents(docs).where(F.col(made_names(docs)["keep"])).select(*docs.columns)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shard_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", one_of_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", deal_shards),
]

#: SQL has no network, banding, tiling, raking or heap; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    before = None
    for _, stage in STAGES[:-1]:
        after = Written(stage(spark, docs, sf_dir))
        if before:
            before.drop()
        before, docs = after, after.read()
    return STAGES[-1][1](spark, docs, sf_dir)
