"""Entity types, their priority and their placeholder labels."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Entity types, the most reliable first.
PRIORITY = [
    "FR_NIR",
    "FR_SIRET",
    "FR_NIR_SUSPECT",
    "FR_SIRET_SUSPECT",
    "FR_SIREN",
    "FR_SIREN_SUSPECT",
    "IBAN",
    "IBAN_SUSPECT",
    "RPPS",
    "MATRICULE",
    "EMAIL",
    "TELEPHONE",
    "ADRESSE",
    "CODE_POSTAL",
    "CARTE_BANCAIRE",
    "PLAQUE",
    "REFERENCE_DOSSIER",
    "DATE_NAISSANCE",
    "PERSONNE",
    "ORGANISATION",
    "LIEU",
    "DATE_PROCEDURALE",
]
#: Labels that differ from the type's name.
RENAMED = {
    "FR_NIR": "NIR",
    "FR_SIRET": "SIRET",
    "FR_SIREN": "SIREN",
    "FR_NIR_SUSPECT": "NIR_SUSPECT",
    "FR_SIRET_SUSPECT": "SIRET_SUSPECT",
    "FR_SIREN_SUSPECT": "SIREN_SUSPECT",
    "CARTE_BANCAIRE": "CARTE",
    "REFERENCE_DOSSIER": "REFERENCE",
}
LABELS = [RENAMED.get(t, t) for t in PRIORITY]


def rank(kind: Column) -> Column:
    """Place in the priority; unlisted types come last."""
    at = F.array_position(F.array(*map(F.lit, PRIORITY)), kind)
    return F.when(at > 0, at - 1).otherwise(len(PRIORITY)).cast("int")


def label(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*map(F.lit, chain(*RENAMED.items()))), kind), kind)


def placeholder(kind: Column, number: Column) -> Column:
    """``[LABEL_007]``; numbers past 999 grow."""
    return F.concat(F.lit("["), label(kind), F.lit("_"), F.format_string("%03d", number), F.lit("]"))
