"""Detect, decide, number, rewrite; and the way back."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import label
from ..functions.regex import rebuild
from ..operators.coreference import resolve_people
from ..operators.detect import Engine, detect, span_rows
from ..operators.policy import KEEP, MASK, REVIEW, action_for, as_maps
from ..operators.vault import canonical_of, new_surfaces
from .materialize import written

KEYS = ["dossier_id", "seq"]


@dataclass
class Protected:
    """``texts``: the documents plus protected, counts, in_review; ``spans``: long, with action and placeholder."""

    texts: DataFrame
    spans: DataFrame
    surfaces: DataFrame
    canonical: DataFrame
    people: DataFrame | None = None
    #: The surfaces that this call has numbered: what a vault has to add.
    fresh: DataFrame | None = None
    #: (dossier_id, placeholder, surrogate) where texts hold fake names.
    surrogates: DataFrame | None = None
    #: (dossier_id, seq, protected, candidates, located, n_unlocated, error_kind) where a judge has read the texts.
    judged: DataFrame | None = None


def long_spans(docs: DataFrame, policies: DataFrame | None = None, engines: Iterable[Engine] = (), engine_threshold: float = 0.0) -> DataFrame:
    """(dossier_id, seq, type, start, end, score, surface, action): a row for each detected span."""
    given = "spans" in docs.columns  # detected before
    found = docs.select(*KEYS, "spans") if given else detect(docs.select(*KEYS, "text"), engines=engines, engine_threshold=engine_threshold)
    rows = span_rows(found, KEYS).select(*KEYS, "s.type", "s.start", "s.end", "s.score", F.col("s.value").alias("surface"))
    if policies is None:
        return rows.withColumn("action", action_for(F.col("type"), F.create_map().cast("map<string,string>")))
    return rows.join(as_maps(policies), "dossier_id", "left").withColumn("action", action_for(F.col("type"), F.col("policy"))).drop("policy")


def pseudonymize(docs: DataFrame, policies: DataFrame | None = None, known: DataFrame | None = None, engines: Iterable[Engine] = (), coreference: bool = False, people: DataFrame | None = None, engine_threshold: float = 0.0, resolved: DataFrame | None = None) -> Protected:
    """``docs``: (dossier_id, seq, text, ...), seq the order of arrival in a dossier, unique in it.

    Masked and kept spans take no number and leave no vault row. ``known`` and ``people`` are the surfaces
    and people of earlier batches, of these dossiers at least; they are read and never written again. With
    coreference, people are numbered by the latter alone, or are ``resolved`` already. A column ``spans`` of
    ``docs`` takes the place of detection.
    """
    spans = written(long_spans(docs, policies, engines, engine_threshold))
    numbered = spans.where(~F.col("action").isin(KEEP, MASK))
    named = F.col("type") == "PERSONNE"
    others = numbered.where(~named) if coreference else numbered
    if known is not None and coreference:
        known = known.where(~named)
    fresh = written(new_surfaces(others.select(*KEYS, "start", "type", "surface"), known))
    surfaces = fresh if known is None else known.select(*fresh.columns).unionByName(fresh)
    canonical = canonical_of(surfaces)
    if coreference:
        if resolved is None:
            resolved = written(resolve_people(numbered.where(named).select(*KEYS, "start", "surface"), people))
        people = resolved
        surfaces = surfaces.unionByName(resolved.select("dossier_id", F.lit("PERSONNE").alias("type"), "surface", "placeholder", "number"))
        chosen = resolved.select("dossier_id", "placeholder", F.lit("PERSONNE").alias("type"), F.col("canonical").alias("value")).distinct()
        canonical = canonical.unionByName(chosen)
    keyed = spans.join(surfaces.drop("number"), ["dossier_id", "type", "surface"], "left")
    marker = F.concat(F.lit("["), label(F.col("type")), F.lit("]"))
    marked = keyed.withColumn("placeholder", F.when(F.col("action") == MASK, marker).when(F.col("action") == KEEP, None).otherwise(F.col("placeholder")))
    listed = F.sort_array(F.collect_list(F.struct("start", "end", F.col("placeholder").alias("replacement"), "type", "action")))  # one text's
    found = marked.groupBy(*KEYS).agg(listed.alias("__s"))
    types = F.array_sort(F.array_distinct(F.transform("__s", lambda s: s["type"])))
    counts = F.map_from_entries(F.transform(types, lambda t: F.struct(t.alias("type"), F.size(F.filter("__s", lambda s: s["type"] == t)).alias("n"))))
    in_review = F.array_sort(F.array_distinct(F.transform(F.filter("__s", lambda s: s["replacement"].isNotNull() & (s["action"] == REVIEW)), lambda s: s["replacement"])))
    told = F.col("__s").isNotNull()
    protected = F.coalesce(rebuild(F.col("text"), F.filter("__s", lambda s: s["replacement"].isNotNull())), F.col("text"))
    joined = docs.join(found, KEYS, "left").withColumns({"protected": protected, "counts": F.when(told, counts), "in_review": F.when(told, in_review)})
    texts = joined.drop("__s")
    return Protected(texts, marked, surfaces, canonical, people, fresh)


def serious_view(spans: DataFrame) -> DataFrame:
    """The projection that may leave the trust boundary: no value, no placeholder."""
    return spans.select(*KEYS, "type", "start", "end", "score")


def demo_view(spans: DataFrame) -> DataFrame:
    return spans.select(*KEYS, "type", "start", "end", "score", "surface", "placeholder")
