"""Checksums of French identifiers as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def without_separators(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)[\s.-]", "")


def luhn_valid(number: Column) -> Column:
    return F.coalesce(F.call_function("luhn_check", number), F.lit(False))


def nir_key(body: Column) -> Column:
    """The two-digit key of the first 13 characters; Corsica's A and B count as 0 less one or two million; null if malformed."""
    digits = F.regexp_replace(body, "[AB]", "0").try_cast("bigint")
    shift = F.when(F.substring(body, 7, 1) == "A", 1_000_000).when(F.substring(body, 7, 1) == "B", 2_000_000).otherwise(0)
    return 97 - (digits - shift) % 97


def nir_valid(candidate: Column) -> Column:
    kept = F.regexp_replace(candidate, "[^0-9AB]", "")
    shaped = kept.rlike(r"^[0-9]{6}[0-9AB][0-9]{8}$") | kept.rlike(r"^[0-9]{5}2[AB][0-9]{8}$")
    key = F.substring(kept, 14, 2).try_cast("int")
    return F.coalesce((F.length(kept) == 15) & shaped & (nir_key(F.substring(kept, 1, 13)) == key), F.lit(False))


def iban_valid(candidate: Column) -> Column:
    """Shape, then the rearranged letters and digits modulo 97, folded a character at a time."""
    kept = F.upper(F.regexp_replace(candidate, r"(?U)\s", ""))
    turned = F.concat(F.substring(kept, 5, 64), F.substring(kept, 1, 4))

    def step(acc: Column, c: Column) -> Column:
        digit = F.ascii(c) - F.when(c.between("0", "9"), 48).otherwise(55)
        return F.when(c.between("0", "9"), acc * 10 + digit).otherwise(acc * 100 + digit) % 97

    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(step(acc, c)).cast("int"))
    return F.coalesce(F.when(kept.rlike(r"^[A-Z]{2}[0-9]{2}[A-Z0-9]{8,30}$"), rest == 1), F.lit(False))
