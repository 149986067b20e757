"""Checks and repairs of placeholders in replies against a dossier's vault, by joins.

The same results as the array functions of ``integrity``, but no dossier's placeholders stand in one
row: tokens of replies meet known placeholders by (dossier, placeholder), and altered ones by number
and a spelling of their type with at most one letter left out, which two types within one edit share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import LABELS
from ..functions.regex import matches
from ..plans.materialize import spread, written
from .integrity import BARE, BRACKETED, CANONICAL, LOOSE, canonical, folded, normalize, number_in, plain_token, within_one
from .rewrite import replace_spans


def spellings(kind: Column) -> Column:
    """``kind`` and all that is left of it without one letter."""
    shorter = F.transform(F.sequence(F.lit(1), F.length(kind)), lambda i: F.concat(F.substring(kind, F.lit(1), i - 1), F.substring(kind, i + 1, F.length(kind))))
    return F.array_distinct(F.concat(F.array(kind), F.when(F.length(kind) > 0, shorter).otherwise(F.array().cast("array<string>"))))


def reply_tokens(replies: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(``keys``, start, end, kind, number): whatever looks like a placeholder, with and without brackets; kind in plain capitals."""

    def read(pattern: str) -> Column:
        found = matches(F.col(text), pattern)
        return F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), folded(F.regexp_extract(m["value"], pattern, 1)).alias("kind"), number_in(m["value"], pattern).alias("number")))

    some = replies.where(F.col(text).rlike(r"[ _-]\d"))
    return some.select(*keys, F.explode_outer(F.concat(read(BRACKETED), read(BARE))).alias("t")).where("t IS NOT NULL").select(*keys, "t.*")


def parsed(known: DataFrame) -> DataFrame:
    """(dossier_id, placeholder, kind, number) of the numbered ones."""
    whole = spread(known).select("dossier_id", "placeholder").where(F.col("placeholder").rlike(CANONICAL)).distinct()
    return whole.withColumn("kind", F.regexp_extract("placeholder", CANONICAL, 1)).withColumn("number", number_in(F.col("placeholder"), CANONICAL))


def restore_replies(replies: DataFrame, known: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``replies`` with altered tokens repaired, as ``restore_tokens`` does. ``keys`` identify a reply and hold dossier_id; ``known``: (dossier_id, placeholder)."""
    plain = spread(written(replies.withColumn(text, normalize(F.col(text)))))
    ours = parsed(known)
    tokens = reply_tokens(plain, keys, text).withColumn("placeholder", canonical(F.col("kind"), F.col("number")))
    exact = spread(written(tokens.join(ours.select("dossier_id", "placeholder", F.lit(True).alias("exact")), ["dossier_id", "placeholder"], "left")))
    right = exact.where("exact").select(*keys, "start", "end", F.col("placeholder").alias("replacement"))
    altered = exact.where("exact IS NULL").select(*keys, "start", "end", "kind", "number")
    # only placeholders with the number of an altered token are spelled out
    asked = ours.join(altered.select("dossier_id", "number").distinct(), ["dossier_id", "number"], "left_semi")
    spelled = asked.select("dossier_id", "number", F.col("kind").alias("their_kind"), F.col("placeholder").alias("replacement"), F.explode(spellings(F.col("kind"))).alias("spelling"))
    met = altered.withColumn("spelling", F.explode(spellings(F.col("kind")))).join(spelled, ["dossier_id", "number", "spelling"])
    near = met.where(within_one(F.col("kind"), F.col("their_kind"))).groupBy(*keys, "start", "end").agg(F.countDistinct("replacement").alias("__n"), F.min("replacement").alias("replacement"))
    single = near.where("__n = 1").select(*keys, "start", "end", "replacement")
    return replace_spans(plain, right.unionByName(single), keys, text, text)


def suspect_tokens(replies: DataFrame, known: DataFrame, keys: list[str], text: str = "text", legacy_nearest_type: bool = False) -> DataFrame:
    """(``keys``, placeholder): look-alikes of plausible types, in canonical form, that the dossier does not know; see ``integrity.suspects``."""
    ours, labels = parsed(known), F.array(*map(F.lit, sorted(LABELS)))
    tokens = spread(written(reply_tokens(replies, keys, text).select(*keys, "kind", "number").distinct()))
    types = ours.select("dossier_id", "kind").distinct()
    spelled = types.select("dossier_id", F.col("kind").alias("their_kind"), F.explode(spellings(F.col("kind"))).alias("spelling"))
    kinds = tokens.select("dossier_id", "kind").distinct()
    met = kinds.withColumn("spelling", F.explode(spellings(F.col("kind")))).join(spelled, ["dossier_id", "spelling"]).where(within_one(F.col("kind"), F.col("their_kind")))
    theirs = met.groupBy("dossier_id", "kind").agg(F.min("their_kind").alias("near"), F.max(F.col("kind") == F.col("their_kind")).alias("own"))
    read = tokens.join(theirs, ["dossier_id", "kind"], "left")
    listed = F.array_min(F.filter(labels, lambda p: within_one(p, F.col("kind"))))
    near = F.least("near", listed)  # nulls are passed over
    plausible = F.coalesce("own", F.lit(False)) | F.array_contains(labels, F.col("kind"))
    chosen = near if legacy_nearest_type else F.when(plausible, F.col("kind")).otherwise(near)
    named = read.select(*keys, canonical(chosen, F.col("number")).alias("placeholder")).where("placeholder IS NOT NULL").distinct()
    return named.join(spread(known).select("dossier_id", "placeholder"), ["dossier_id", "placeholder"], "left_anti").select(*keys, "placeholder")


def check_replies(replies: DataFrame, sent: DataFrame, known: DataFrame, keys: list[str], text: str = "text", legacy_nearest_type: bool = False) -> DataFrame:
    """``replies`` plus report, as ``check`` gives it. ``sent``: (``keys``, placeholder), ``known``: (dossier_id, placeholder)."""
    loose = F.transform(matches(F.col(text), LOOSE), plain_token)
    present = replies.where(F.contains(F.col(text), F.lit("["))).select(*keys, F.explode_outer(loose).alias("placeholder")).where("placeholder IS NOT NULL").distinct()
    present = spread(written(present))
    strange = present.join(spread(known).select("dossier_id", "placeholder"), ["dossier_id", "placeholder"], "left_anti").select(*keys, "placeholder")
    suspects = suspect_tokens(replies, known, keys, text, legacy_nearest_type)
    gone = sent.select(*keys, "placeholder").distinct().join(present, [*keys, "placeholder"], "left_anti")
    told = strange.unionByName(suspects).distinct().withColumn("what", F.lit("unknown")).unionByName(gone.withColumn("what", F.lit("missing")))
    of = lambda what: F.array_sort(F.collect_list(F.when(F.col("what") == what, F.col("placeholder"))))
    lists = told.groupBy(*keys).agg(of("unknown").alias("__unknown"), of("missing").alias("__missing"))  # a reply's own tokens
    none = F.array().cast("array<string>")
    joined = spread(replies).join(lists, keys, "left").withColumn("__unknown", F.coalesce("__unknown", none)).withColumn("__missing", F.coalesce("__missing", none))
    # a reply that isn't there has no report
    ok = F.when(F.col(text).isNotNull(), F.size("__unknown") == 0)
    unknown, missing = (F.when(F.col(text).isNotNull(), F.col(c)) for c in ("__unknown", "__missing"))
    report = F.struct(ok.alias("ok"), unknown.alias("unknown"), missing.alias("missing"), F.when(ok, "ok").otherwise("review_required").alias("action"))
    return joined.withColumn("report", report).drop("__unknown", "__missing")
