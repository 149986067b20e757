"""What happens to each type: pseudonymize, mask, keep or review."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import PRIORITY

#: Actions, and the one type that is kept unless told otherwise.
PSEUDONYMIZE, MASK, KEEP, REVIEW = "pseudonymiser", "masquer", "conserver", "revue"
ACTIONS = (PSEUDONYMIZE, MASK, KEEP, REVIEW)
KEPT_BY_DEFAULT = "DATE_PROCEDURALE"


def validate(actions: Mapping[str, str]) -> None:
    for kind, action in actions.items():
        if kind not in PRIORITY:
            raise ValueError(f"unknown entity type in the policy: {kind!r}")
        if action not in ACTIONS:
            raise ValueError(f"unknown action for {kind}: {action!r}")


def parse(raw: str) -> dict[str, str]:
    """``TYPE=action,TYPE=action``; empty parts are skipped."""
    actions = {}
    for part in filter(None, (p.strip() for p in raw.split(","))):
        kind, equals, action = part.partition("=")
        if not equals:
            raise ValueError(f"a policy entry is TYPE=action: {part!r}")
        actions[kind.strip()] = action.strip()
    validate(actions)
    return actions


def override(instance: Column, own: Column) -> Column:
    """The dossier's map over the instance's, type by type; nulls are empty."""
    empty = F.create_map().cast("map<string,string>")
    low, high = F.coalesce(instance, empty), F.coalesce(own, empty)
    return F.map_concat(F.map_filter(low, lambda k, _: ~F.map_contains_key(high, k)), high)


def action_for(kind: Column, policy: Column) -> Column:
    default = F.when(kind == KEPT_BY_DEFAULT, KEEP).otherwise(PSEUDONYMIZE)
    chosen = F.try_element_at(policy, kind)
    return F.when(chosen.isNull() | (chosen == ""), default).otherwise(chosen)


def checked(policies: DataFrame) -> DataFrame:
    """A policy table (dossier_id, type, action) that fails on unknown values where it is read."""
    bad = ~F.col("type").isin(*PRIORITY) | ~F.col("action").isin(*ACTIONS)
    said = F.raise_error(F.concat(F.lit("unknown type or action in the policy: "), F.concat_ws("=", "type", "action")))
    return policies.withColumn("action", F.when(F.coalesce(bad, F.lit(True)), said).otherwise(F.col("action")))


def as_maps(policies: DataFrame) -> DataFrame:
    """(dossier_id, policy map); a dossier has at most one row for each type."""
    return checked(policies).groupBy("dossier_id").agg(F.map_from_entries(F.collect_set(F.struct("type", "action"))).alias("policy"))


def to_json(policy: Column, surrogates: Column) -> Column:
    return F.to_json(F.struct(policy.alias("actions"), surrogates.alias("surrogates")))


def from_json(text: Column) -> Column:
    return F.from_json(text, "struct<actions:map<string,string>,surrogates:boolean>")


def replace_stored(stored: DataFrame, supplied: DataFrame) -> DataFrame:
    """Policy updates: a dossier that supplies a policy loses its stored rows; others keep theirs."""
    return stored.join(supplied.select("dossier_id").distinct(), "dossier_id", "left_anti").unionByName(supplied)
