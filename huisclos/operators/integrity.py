"""Checks and repairs of placeholders in replies, row by row on arrays; ``repair`` does the same by joins, for dossiers of any size."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.labels import LABELS
from ..functions.regex import BORDER, let, matches, rebuild

#: Letters that fold to plain capitals by dropping their accent.
ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "AAAAAACEEEEIIIINOOOOOUUUUY"
LETTERS = r"[A-Za-zÀ-ÖØ-öø-ÿ_]{2,25}"
LOOSE = r"\[([A-Z_]+?)[ _](\d+)\]"
BRACKETED = rf"\[({LETTERS})[ _-]0*(\d+)\]"
BARE = rf"(?<!\[){BORDER}({LETTERS})[_-]0*(\d+){BORDER}(?!\])"
CANONICAL = r"^\[([A-Z_]+)_(\d+)\]$"


def folded(kind: Column) -> Column:
    return F.translate(F.upper(kind), ACCENTED, PLAIN)


def number_in(value: Column, pattern: str) -> Column:
    return F.regexp_extract(value, pattern, 2).try_cast("decimal(30,0)")


def canonical(kind: Column, number: Column) -> Column:
    digits = number.cast("string")
    return F.concat(F.lit("["), kind, F.lit("_"), F.when(F.length(digits) < 3, F.lpad(digits, 3, "0")).otherwise(digits), F.lit("]"))


def plain_token(m: Column) -> Column:
    """A match of ``LOOSE`` in canonical form; as it stands if its number has more than 30 digits, which no placeholder has."""
    return F.coalesce(canonical(F.regexp_extract(m["value"], LOOSE, 1), number_in(m["value"], LOOSE)), m["value"])


def normalize(text: Column) -> Column:
    """``[TYPE 1]`` and ``[TYPE_1]`` become ``[TYPE_001]``."""
    found = F.transform(
        matches(text, LOOSE),
        lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), plain_token(m).alias("replacement")),
    )
    return rebuild(text, found)


def within_one(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b, 1) >= 0


def _restore(text: Column, known: Column, pattern: str) -> Column:
    """Tokens whose exact type and number are known, or else the only known type one edit away with that number."""

    def fix(m: Column) -> Column:
        kind, number = folded(F.regexp_extract(m["value"], pattern, 1)), number_in(m["value"], pattern)

        def chosen(t: Column) -> Column:
            near = F.filter(known, lambda k: (number_in(k, CANONICAL) == t["number"]) & within_one(F.regexp_extract(k, CANONICAL, 1), t["kind"]))
            single = let(near, lambda n: F.when(F.size(n) == 1, F.try_element_at(n, F.lit(1))))
            return let(canonical(t["kind"], t["number"]), lambda exact: F.when(F.array_contains(known, exact), exact).otherwise(F.coalesce(single, m["value"])))

        token = F.struct(kind.alias("kind"), number.alias("number"))
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), let(token, chosen).alias("replacement"))

    return rebuild(text, F.transform(matches(text, pattern), fix))


def restore_tokens(text: Column, known: Column) -> Column:
    """``normalize``, then altered tokens with and without brackets. ``known``: the dossier's placeholders."""
    numbered = F.filter(F.coalesce(known, F.array().cast("array<string>")), lambda k: k.rlike(CANONICAL))

    def steps(k: Column) -> Column:
        repaired = let(normalize(text), lambda t: let(_restore(t, k, BRACKETED), lambda u: _restore(u, k, BARE)))
        return F.when(F.size(k) == 0, normalize(text)).otherwise(repaired)

    return let(numbered, steps)


def suspects(text: Column, known: Column, legacy_nearest_type: bool = False) -> Column:
    """Unrestored look-alikes of plausible types, in canonical form.

    A token whose own type is plausible is taken as it stands; with ``legacy_nearest_type`` the first
    plausible type in alphabetical order within one edit is taken even then.
    """
    plausible = F.array_union(F.array(*map(F.lit, LABELS)), F.transform(known, lambda k: F.regexp_extract(k, CANONICAL, 1)))

    def named(pattern: str, types: Column) -> Column:
        def name(m: Column) -> Column:
            def typed(kind: Column) -> Column:
                near = F.array_min(F.filter(types, lambda p: within_one(p, kind)))
                chosen = near if legacy_nearest_type else F.when(F.array_contains(types, kind), kind).otherwise(near)
                return canonical(chosen, number_in(m["value"], pattern))

            return let(folded(F.regexp_extract(m["value"], pattern, 1)), typed)

        return F.transform(matches(text, pattern), name)

    found = let(plausible, lambda types: F.array_distinct(F.concat(named(BRACKETED, types), named(BARE, types))))
    return F.filter(found, lambda t: t.isNotNull() & ~F.array_contains(known, t))


def check(text: Column, sent: Column, known: Column, legacy_nearest_type: bool = False) -> Column:
    """``struct<ok, unknown, missing, action>``: unknown placeholders block, missing ones only inform."""
    none = F.array().cast("array<string>")
    given = F.struct(text.alias("text"), F.coalesce(sent, none).alias("sent"), F.coalesce(known, none).alias("known"))

    def report(g: Column) -> Column:
        present = F.array_distinct(F.transform(matches(g["text"], LOOSE), plain_token))

        def compared(p: Column) -> Column:
            unknown = F.array_sort(F.array_union(F.array_except(p, g["known"]), suspects(g["text"], g["known"], legacy_nearest_type)))
            missing = F.array_sort(F.array_except(g["sent"], p))
            return let(unknown, lambda u: F.struct((F.size(u) == 0).alias("ok"), u.alias("unknown"), missing.alias("missing"), F.when(F.size(u) == 0, "ok").otherwise("review_required").alias("action")))

        return let(present, compared)

    return let(given, report)
