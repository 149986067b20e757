"""Recall, precision, leaks and canaries."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.regex import occurrences
from ..plans.materialize import written
from .search import values_in_texts

def truth_spans(docs: DataFrame, truth: DataFrame) -> DataFrame:
    """Every occurrence of each true value: (doc_id, type, start, end). ``truth``: (doc_id, type, value)."""
    joined = docs.select("doc_id", "text").join(truth.where("value <> ''"), "doc_id")
    # ``explode`` would have the occurrences evaluated twice; see ``span_rows``
    found = joined.select("doc_id", "type", F.explode_outer(occurrences(F.col("text"), F.col("value"))).alias("m")).where("m IS NOT NULL")
    return found.select("doc_id", "type", F.col("m.start").alias("start"), F.col("m.end").alias("end"))


#: Characters of a document that one window sweeps; what earlier ones hold is carried on by their sums.
STRETCH = 1 << 16


def _swept(marks: DataFrame, keys: list[str], order: list[str], carry: Column, within: Column) -> DataFrame:
    """``marks`` (``keys``, at, ...) plus carried and swept: the aggregate over all earlier stretches and the one up to the row in its own."""
    cut = marks.withColumn("stretch", F.floor(F.col("at") / STRETCH))
    each = cut.groupBy(*keys, "stretch").agg(within.alias("one"))
    earlier = W.partitionBy(*keys).orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
    before = each.select(*keys, "stretch", carry.over(earlier).alias("carried"))
    here = W.partitionBy(*keys, "stretch").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return cut.withColumn("swept", within.over(here)).join(before, [*keys, "stretch"])


def covered_truth(truth: DataFrame, found: DataFrame) -> DataFrame:
    """True spans that one detected span of their type contains. Spans are not empty.

    By start, found ones first, a true span is covered where the largest end of the found ones so far reaches its own.
    """
    keys, rows = ["doc_id", "type"], written(truth.withColumn("__n", F.monotonically_increasing_id()))
    none = F.lit(None).cast("long")
    theirs = found.select(*keys, F.col("start").alias("at"), F.lit(0).alias("kind"), F.col("end").cast("long").alias("reach"), none.alias("__n"), none.alias("need"))
    ours = rows.select(*keys, F.col("start").alias("at"), F.lit(1).alias("kind"), none.alias("reach"), "__n", F.col("end").cast("long").alias("need"))
    swept = _swept(theirs.unionByName(ours), keys, ["at", "kind"], F.max("one"), F.max("reach"))
    held = swept.where((F.col("kind") == 1) & (F.greatest("carried", "swept") >= F.col("need")))
    return rows.join(held.select("__n"), "__n", "left_semi").select(*truth.columns)


def correct_detections(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Detected spans that overlap a true span of their type. Spans are not empty.

    A found span overlaps as many true ones as begin before its end less those that end by its start.
    """
    keys, rows = ["doc_id", "type"], written(found.withColumn("__n", F.monotonically_increasing_id()))
    none, one = F.lit(None).cast("long"), F.lit(1).cast("long")
    mark = lambda df, at, axis, kind, count, n: df.select(*keys, F.col(at).alias("at"), F.lit(axis).alias("axis"), F.lit(kind).alias("kind"), count.alias("count"), n.alias("__n"))
    # begins count before a found end at another place only, ends before a found start at the same one too
    marks = mark(truth, "start", "begin", 1, one, none).unionAll(mark(rows, "end", "begin", 0, one * 0, F.col("__n")))
    marks = marks.unionAll(mark(truth, "end", "end", 0, one, none)).unionAll(mark(rows, "start", "end", 1, one * 0, F.col("__n")))
    swept = _swept(marks, [*keys, "axis"], ["at", "kind"], F.sum("one"), F.sum("count")).where("__n IS NOT NULL")
    sign = F.when(F.col("axis") == "begin", 1).otherwise(-1)
    held = swept.groupBy("__n").agg(F.sum(sign * (F.coalesce("carried", F.lit(0)) + F.col("swept"))).alias("n")).where("n > 0")
    return rows.join(held, "__n", "left_semi").select(*found.columns)


def recall_precision(truth: DataFrame, found: DataFrame) -> DataFrame:
    """By type: n_true, n_covered, n_found, n_correct, recall, precision (null over zero)."""
    parts = [(truth, "n_true"), (covered_truth(truth, found), "n_covered"), (found, "n_found"), (correct_detections(found, truth), "n_correct")]
    rows = None
    for df, name in parts:
        one = df.select("type", F.lit(name).alias("what"))
        rows = one if rows is None else rows.unionAll(one)
    sums = rows.groupBy("type").agg(*(F.count(F.when(F.col("what") == n, 1)).alias(n) for _, n in parts))
    return sums.withColumn("recall", F.try_divide("n_covered", "n_true")).withColumn("precision", F.try_divide("n_correct", "n_found"))


def percent(done: Column, total: Column) -> Column:
    """``75.0 % (3/4)``, or ``n/a`` over zero."""
    share = F.format_string("%.1f %% (%d/%d)", done / total * 100.0, done.cast("long"), total.cast("long"))
    return F.when(total > 0, share).otherwise("n/a")


def report_lines(measures: DataFrame) -> DataFrame:
    """(type, line): a Markdown table row for each type of ``recall_precision``."""
    recall, precision = percent(F.col("n_covered"), F.col("n_true")), percent(F.col("n_correct"), F.col("n_found"))
    return measures.select("type", F.concat(F.lit("| "), "type", F.lit(" | "), recall, F.lit(" | "), precision, F.lit(" |")).alias("line"))


def leaks(payloads: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """(``keys``, value) for each text and each known value of its key that stands in it; must be empty."""
    return values_in_texts(payloads.select(*keys, "protected"), values.select(*keys, "value"), keys, "protected").select(*keys, "value")


#: Words of more than three letters that tell nothing.
STOP_WORDS = (
    "dans", "plus", "même", "meme", "pour", "avec", "sans", "sous", "chez", "tout", "tous", "toute",
    "toutes", "cette", "cettes", "leur", "leurs", "elle", "elles", "vous", "nous", "être", "etre", "avoir",
    "fait", "entre", "vers", "depuis", "dont", "aussi", "comme", "mais", "donc", "alors", "ainsi", "après",
    "apres", "avant", "encore", "était", "etait",
)


def _flat(text: str) -> str:
    return " ".join(text.casefold().split())


def _telling(text: str) -> set[str]:
    return {w for w in re.findall(r"\w+", _flat(text)) if len(w) > 3} - set(STOP_WORDS)


def assign_canaries(canaries: list[tuple[str, list[str]]], segments: list[str]) -> dict[str, int | None]:
    """Each canary in order takes the first free segment that contains an extract or is contained in one, or else shares half an extract's telling words."""
    flat, telling = [_flat(s) for s in segments], [_telling(s) for s in segments]
    free, taken = list(range(len(segments))), {}
    for name, extracts in canaries:
        strong = (i for e in map(_flat, extracts) for i in free if e in flat[i] or flat[i] in e)
        weak = (i for e in map(_telling, extracts) if e for i in free if 2 * len(e & telling[i]) >= len(e))
        taken[name] = next(strong, None)
        if taken[name] is None:
            taken[name] = next(weak, None)
        if taken[name] is not None:
            free.remove(taken[name])
    return taken


def canary_match(canaries: DataFrame, candidates: DataFrame) -> DataFrame:
    """``canaries``: (doc_id, n, canary, extracts), ``candidates``: (doc_id, n, segment). Returns (doc_id, canary, signaled).

    One document's canaries, a handful, are assigned in one place, as each candidate counts once.
    """

    def assign(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        ordered = [(c, list(e)) for c, e in left.sort_values("n")[["canary", "extracts"]].itertuples(index=False)]
        taken = assign_canaries(ordered, list(right.sort_values("n")["segment"]))
        rows = [(left["doc_id"].iloc[0], c, i is not None) for c, i in taken.items()] if len(left) else []
        return pd.DataFrame(rows, columns=["doc_id", "canary", "signaled"])

    return canaries.groupBy("doc_id").cogroup(candidates.groupBy("doc_id")).applyInPandas(assign, "doc_id string, canary string, signaled boolean")


def canary_rate(matched: DataFrame) -> DataFrame:
    rate = F.coalesce(F.try_divide(F.count(F.when(F.col("signaled"), 1)), F.count("*")), F.lit(0.0))
    missed = F.array_sort(F.collect_list(F.when(~F.col("signaled"), F.col("canary"))))
    return matched.agg(F.count("*").alias("n"), rate.alias("rate"), missed.alias("missed"))
