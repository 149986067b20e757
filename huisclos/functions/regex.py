"""Matches with code-point offsets, as array columns.

Spark finds values but not offsets. Splitting by the pattern gives the gaps around the same matches,
so a match starts after all gaps up to it and all matches before it; ``length`` counts code points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word character in any script; ``\\b`` of the JVM is not used, as its default differs between versions.
WORD = r"[\p{L}\p{N}_]"
#: Borders for a pattern that begins or ends with a word character.
LEFT, RIGHT = rf"(?<!{WORD})", rf"(?!{WORD})"
#: A border on either side of which may stand a word character.
BORDER = rf"(?:(?<!{WORD})(?={WORD})|(?<={WORD})(?!{WORD}))"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often ``body`` names it."""
    return F.transform(F.array(value), body).getItem(0)


MATCHES = "array<struct<start:int,end:int,value:string>>"
#: A character that stands for a match while a text is split.
MARK = "\u0001"
#: Elements that a fold adds to one array before it begins another.
CHUNK = 256


class Growing:
    """An array that a fold lengthens: chunks of ``CHUNK``, so that n additions copy n x ``CHUNK`` elements and not n squared."""

    @staticmethod
    def empty(kind: str) -> list[Column]:
        return [F.array().cast(kind).alias("part"), F.array().cast(f"array<{kind}>").alias("parts")]

    @staticmethod
    def plus(acc: Column, more: Column) -> list[Column]:
        full = F.size(acc["part"]) >= CHUNK
        part = F.when(full, more).otherwise(F.concat(acc["part"], more))
        return [part.alias("part"), F.when(full, F.array_append(acc["parts"], acc["part"])).otherwise(acc["parts"]).alias("parts")]

    @staticmethod
    def same(acc: Column) -> list[Column]:
        return [acc["part"].alias("part"), acc["parts"].alias("parts")]

    @staticmethod
    def whole(acc: Column) -> Column:
        return F.flatten(F.array_append(acc["parts"], acc["part"]))


def matches(text: Column, pattern: str | Column) -> Column:
    """``array<struct<start int, end int, value string>>`` of the non-overlapping matches, left to right.

    One fold carries the offset from match to match. A text is searched once: each match is put between two ``MARK``,
    at which gaps and matches are cut in turn (``split`` compiles its pattern anew for each text, but not one of a
    single character). Texts that hold ``MARK`` themselves are split by the pattern.
    """
    regex = F.lit(pattern) if isinstance(pattern, str) else pattern

    def step(acc: Column, p: Column) -> Column:
        at = acc["at"] + F.length(p["gap"])
        end = at + F.length(p["hit"])
        one = F.array(F.struct(at.alias("start"), end.alias("end"), p["hit"].alias("value")))
        return F.when(p["hit"].isNull(), acc).otherwise(F.struct(end.alias("at"), *Growing.plus(acc, one)))

    def in_turn(cut: Column) -> Column:
        """Gaps and matches, of which one alone needs no fold."""
        start = F.length(F.get(cut, F.lit(0)))
        alone = F.array(F.struct(start.alias("start"), (start + F.length(F.get(cut, F.lit(1)))).alias("end"), F.get(cut, F.lit(1)).alias("value")))
        both = F.arrays_zip(F.filter(cut, lambda _, i: i % 2 == 0).alias("gap"), F.filter(cut, lambda _, i: i % 2 == 1).alias("hit"))
        return F.when(F.size(cut) == 3, alone.cast(MATCHES)).otherwise(folded(both))

    def folded(parts: Column) -> Column:
        return F.aggregate(parts, F.struct(F.lit(0).alias("at"), *Growing.empty(MATCHES)), step, Growing.whole)

    def read(marked: Column) -> Column:
        own = F.arrays_zip(F.split(text, regex, -1).alias("gap"), F.regexp_extract_all(text, regex, F.lit(0)).alias("hit"))
        found = F.when(F.contains(text, F.lit(MARK)), folded(own)).otherwise(let(F.split(marked, MARK, -1), in_turn))
        return F.when(F.contains(marked, F.lit(MARK)), found).when(marked.isNotNull(), F.array().cast(MATCHES))

    return let(F.regexp_replace(text, regex, F.lit(f"{MARK}$0{MARK}")), read)


def occurrences(text: Column, value: Column) -> Column:
    """``matches`` of a value taken literally; no pattern is compiled, except for texts that hold ``MARK``. ``value`` is not empty."""
    quoted = F.concat(F.lit(r"\Q"), F.replace(value, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    gaps = F.when(F.contains(text, F.lit(MARK)), F.split(text, quoted, -1)).otherwise(F.split(F.replace(text, value, F.lit(MARK)), MARK, -1))

    def step(acc: Column, gap: Column) -> Column:
        start = acc["at"] + F.length(gap)
        end = start + F.length(value)
        one = F.array(F.struct(start.alias("start"), end.alias("end"), value.alias("value")))
        return F.struct(end.alias("at"), *Growing.plus(acc, one))

    # the last gap ends with the text
    found = F.aggregate(F.slice(gaps, F.lit(1), F.size(gaps) - 1), F.struct(F.lit(0).alias("at"), *Growing.empty(MATCHES)), step, Growing.whole)
    return F.when(F.contains(text, value), found).when(text.isNotNull() & value.isNotNull(), F.array().cast(MATCHES))


def rebuild(text: Column, spans: Column) -> Column:
    """``text`` with each of the sorted, disjoint ``spans`` (start, end, replacement) replaced."""

    def piece(s: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(spans, i - 1)["end"]).otherwise(0)
        return F.concat(F.substring(text, before + 1, s["start"] - before), s["replacement"])

    tail = F.substring(text, F.coalesce(F.try_element_at(spans, F.lit(-1))["end"], F.lit(0)) + 1, F.length(text))
    return F.when(text.isNotNull() & spans.isNotNull(), F.concat(F.array_join(F.transform(spans, piece), ""), tail))


def context_before(text: Column, start: Column) -> Column:
    """The line up to ``start`` and the line before it, which a blank line cuts off."""
    head = F.substring(text, F.lit(1), start)
    two = F.substring_index(head, "\n", -2)
    return F.when(two.rlike(r"^(?U)\s*\n[^\n]*$"), F.substring_index(head, "\n", -1)).otherwise(two)
