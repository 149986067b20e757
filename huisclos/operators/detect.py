"""Detection: recognizer rules, overlap resolution and merging of adjacent spans, all as array columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import rank
from ..functions.regex import BORDER, LEFT, RIGHT, WORD, Growing, context_before, let, matches
from ..functions.validators import iban_valid, luhn_valid, nir_valid, without_separators

SPAN = "array<struct<type:string,start:int,end:int,score:double,value:string>>"
Engine = Callable[[Column], Column]

#: Months, case folded by the pattern.
MONTHS = "janvier|février|mars|avril|mai|juin|juillet|août|septembre|octobre|novembre|décembre"
DATE = rf"(?:\d{{1,2}}(?:er)?\s+(?i:{MONTHS})\s+\d{{4}}|\d{{1,2}}[/.]\d{{1,2}}[/.]\d{{4}})"


@dataclass(frozen=True)
class Rule:
    """One pattern. ``head`` cuts a match to a leading part, ``tail`` to a trailing one (both patterns)."""

    type: str
    pattern: str
    score: float
    valid: Callable[[Column], Column] | None = None
    context: str | None = None
    suspect: str | None = None
    suspect_score: float = 0.0
    suspect_context: str | None = None
    head: str | None = None
    tail: str | None = None
    #: Only texts in which ``LONG`` occurs can hold a match.
    long: bool = False

    def candidates(self, text: Column) -> Column:
        """Spans of one text. Texts in which the context never occurs skip the search for it before each match."""
        found = matches(text, self.pattern)
        if part := self.head or self.tail:

            def cut(m: Column) -> Column:
                value = F.regexp_extract(m["value"], part, 1)
                start = m["start"] if self.head else m["end"] - F.length(value)
                return F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"))

            found = F.transform(found, cut)

        def judged(found: Column, in_text: Column | None = None) -> Column:
            def judge(m: Column) -> Column:
                sure = F.lit(True) if self.valid is None else self.valid(m["value"])
                kind = F.when(sure, F.lit(self.type) if self.context is None else F.when(context_before(text, m["start"]).rlike(self.context), self.type))
                score = F.when(sure, self.score)
                if self.suspect:
                    kind = kind.otherwise(F.when(in_text & context_before(text, m["start"]).rlike(self.suspect_context), self.suspect))
                    score = score.otherwise(self.suspect_score)
                return F.struct(kind.alias("type"), m["start"].alias("start"), m["end"].alias("end"), score.alias("score"), m["value"].alias("value"))

            return F.filter(F.transform(found, judge), lambda s: s["type"].isNotNull()).cast(SPAN)

        # contexts are looked for only where the pattern occurs
        here, none = text.rlike(self.pattern), F.array().cast(SPAN)
        if self.context:
            return F.when(here & text.rlike(self.context), judged(found)).otherwise(none)
        if self.suspect:
            both = F.struct(found.alias("found"), text.rlike(self.suspect_context).alias("in_text"))
            return F.when(here, let(both, lambda b: judged(b["found"], b["in_text"]))).otherwise(none)
        return judged(found)


def _luhn(value: Column) -> Column:
    return luhn_valid(without_separators(value))


#: Eight digits with one separator at most between two: every match of the rules that are ``long`` holds them.
LONG = r"(?U)\d(?:[\s.-]?\d){7}"
#: Patterns, scores and contexts are fixed values; ``(?U)`` makes classes cover all scripts.
RULES = [
    Rule("FR_NIR", rf"(?U){LEFT}[12]\s?\d{{2}}\s?\d{{2}}\s?(?:\d{{2}}|2[AB])\s?\d{{3}}\s?\d{{3}}\s?\d{{2}}{RIGHT}", 0.95, nir_valid, None, "FR_NIR_SUSPECT", 0.7, rf"(?iU){BORDER}NIR{BORDER}|s[ée]curit[ée]\s+sociale|{BORDER}INSEE{BORDER}", long=True),
    Rule("FR_SIRET", rf"(?U){LEFT}\d{{3}}\s?\d{{3}}\s?\d{{3}}\s?\d{{5}}{RIGHT}", 0.9, _luhn, None, "FR_SIRET_SUSPECT", 0.7, rf"(?iU){BORDER}SIRET{BORDER}", long=True),
    Rule("FR_SIREN", rf"(?U){LEFT}\d{{3}}\s?\d{{3}}\s?\d{{3}}{RIGHT}", 0.85, _luhn, None, "FR_SIREN_SUSPECT", 0.65, rf"(?iU){BORDER}SIREN{BORDER}", long=True),
    Rule("IBAN", rf"(?U){LEFT}[A-Z]{{2}}\d{{2}}(?:\s?[A-Z0-9]{{4}}){{2,7}}(?:\s?[A-Z0-9]{{1,4}})?{RIGHT}", 0.95, iban_valid, None, "IBAN_SUSPECT", 0.7, rf"(?iU){BORDER}IBAN{BORDER}|{BORDER}RIB{BORDER}|compte bancaire"),
    Rule("RPPS", rf"(?U){LEFT}\d{{11}}{RIGHT}", 0.9, None, rf"(?iU){BORDER}RPPS{BORDER}", long=True),
    Rule("MATRICULE", rf"(?U){LEFT}\d{{2,6}}-\d{{2,6}}{RIGHT}", 0.8, None, rf"(?iU){BORDER}matricule{BORDER}"),
    Rule("CODE_POSTAL", rf"(?U){LEFT}\d{{5}}(?=[  ]+[A-ZÀÂÄÇÉÈÊËÎÏÔÖÙÛÜŒÆ][a-zà-öø-ÿœæ'’-])", 0.75),
    Rule("EMAIL", rf"(?:(?=[a-zA-Z0-9_]){LEFT}|(?=[.%+-])(?<={WORD}))[a-zA-Z0-9._%+-]++@[a-zA-Z0-9.-]+\.[a-zA-Z]{{2,}}{RIGHT}", 0.95),
    Rule("TELEPHONE", rf"(?U){LEFT}0[1-9](?:[ .-]?\d{{2}}){{4}}{RIGHT}", 0.85, long=True),
    Rule("CARTE_BANCAIRE", rf"(?U){LEFT}\d(?:[ -]?\d){{12,15}}{RIGHT}", 0.6, _luhn, long=True),
    Rule("PLAQUE", rf"(?U){LEFT}[A-Z]{{2}}-\d{{3}}-[A-Z]{{2}}{RIGHT}", 0.8),
    Rule("REFERENCE_DOSSIER", rf"(?U){LEFT}[A-Z]{{2,5}}-(?:\d{{4}}-)?\d{{3,6}}{RIGHT}", 0.6),
    Rule("DATE_NAISSANCE", rf"(?U){LEFT}(?i:né(?:e|\(e\))?\s+le\s*:?\s+){DATE}", 0.85, tail=rf"(?U)({DATE})$"),
    Rule("DATE_NAISSANCE", rf"(?U){DATE}", 0.8, None, r"(?iU)date\s+de\s+naissance"),
    Rule("DATE_PROCEDURALE", rf"(?U){DATE}", 0.7),
]
#: Fixed value: characters stripped from the borders of what overlap leaves of a span.
TRIMMED = " \t\n\r,;:.()!?«»\"'"
MERGED = ("PERSONNE", "ORGANISATION", "LIEU")


def candidates(text: Column, engines: Iterable[Engine] = (), rules: Iterable[Rule] = RULES) -> Column:
    """All rules' and engines' spans in order of generation. Every rule needs a digit or ``@``, so other texts skip them."""
    none = F.array().cast(SPAN)
    of_all = let(text.rlike(LONG), lambda long: F.concat(*(F.when(long, r.candidates(text)).otherwise(none) if r.long else r.candidates(text) for r in rules)))
    by_rule = F.when(text.rlike(r"[\p{Nd}@]"), of_all).otherwise(none)
    return F.concat(by_rule.cast(SPAN), *(e(text).cast(SPAN) for e in engines))


def _span(type_: Column, start: Column, end: Column, score: Column, value: Column) -> Column:
    return F.struct(type_.alias("type"), start.cast("int").alias("start"), end.cast("int").alias("end"), score.alias("score"), value.alias("value"))


def _left_of(span: Column, kept: Column) -> Column:
    """The stripped pieces of ``span`` that no kept span covers."""
    piece = "array<struct<start:int,end:int>>"
    whole = F.array(F.struct(span["start"].alias("start"), span["end"].alias("end"))).cast(piece)

    def subtract(free: Column, k: Column) -> Column:
        def cut(f: Column) -> Column:
            apart = (k["end"] <= f["start"]) | (k["start"] >= f["end"])
            sides = F.array(F.struct(f["start"].alias("start"), F.least(f["end"], k["start"]).alias("end")), F.struct(F.greatest(f["start"], k["end"]).alias("start"), f["end"].alias("end")))
            return F.when(apart, F.array(f)).otherwise(F.filter(sides, lambda s: s["start"] < s["end"]))

        return F.flatten(F.transform(free, cut)).cast(piece)

    def strip(f: Column) -> Column:
        fragment = F.substring(span["value"], f["start"] - span["start"] + 1, f["end"] - f["start"])
        tail = F.ltrim(fragment, F.lit(TRIMMED))
        value = F.rtrim(tail, F.lit(TRIMMED))
        start = f["start"] + F.length(fragment) - F.length(tail)
        return _span(span["type"], start, start + F.length(value), span["score"], value)

    return F.filter(F.transform(F.aggregate(kept, whole, subtract), strip), lambda s: s["value"] != "")


def _by_priority(spans: Column) -> Column:
    """Keep spans by priority, length, score and order; a span that overlaps kept ones is trimmed to its free parts."""
    keyed = F.transform(
        spans,
        lambda s: F.struct(rank(s["span"]["type"]).alias("rank"), (s["span"]["start"] - s["span"]["end"]).alias("shorter"), (-s["span"]["score"]).alias("worse"), s["order"].alias("order"), s["span"].alias("span")),
    )
    ordered = F.transform(F.array_sort(keyed), lambda k: k["span"])

    def take(kept: Column, s: Column) -> Column:
        apart = F.forall(kept, lambda k: (s["end"] <= k["start"]) | (s["start"] >= k["end"]))
        return F.concat(kept, F.when(apart, F.array(s)).otherwise(_left_of(s, kept)).cast(SPAN))

    kept = F.aggregate(ordered, F.array().cast(SPAN), take)
    by_start = F.array_sort(F.transform(kept, lambda s: F.struct(s["start"].alias("at"), s.alias("span"))))
    return F.transform(by_start, lambda k: k["span"]).cast(SPAN)


def resolve_overlaps(spans: Column) -> Column:
    """Spans without overlaps, by start. Only spans that touch a common stretch of text are compared with each other, and where none do, they are only sorted."""
    held = "array<struct<at:int,order:int,span:struct<type:string,start:int,end:int,score:double,value:string>>>"
    keyed = F.sort_array(F.transform(spans, lambda s, i: F.struct(s["start"].alias("at"), i.alias("order"), s.alias("span"))).cast(held))
    stop = F.array(F.struct(F.lit(2**31 - 1).alias("at"), F.lit(0).alias("order"), F.lit(None).alias("span"))).cast(held)

    def settled(open_: Column) -> Column:
        return F.when(F.size(open_) == 1, F.transform(open_, lambda k: k["span"])).otherwise(_by_priority(open_))

    def step(acc: Column, k: Column) -> Column:
        joined = F.struct(F.concat(acc["open"], F.array(k)).alias("open"), F.greatest(acc["reach"], k["span"]["end"]).alias("reach"), *Growing.same(acc))
        begun = F.struct(F.array(k).alias("open"), k["span"]["end"].alias("reach"), *Growing.plus(acc, settled(acc["open"])))
        return F.when(k["at"] < acc["reach"], joined).otherwise(begun)

    start = F.struct(F.array().cast(held).alias("open"), F.lit(-1).alias("reach"), *Growing.empty(SPAN))

    def resolved(k: Column) -> Column:
        after = F.slice(k, F.lit(2), F.size(k))
        overlaps = F.exists(F.zip_with(k, after, lambda a, b: b["at"] < a["span"]["end"]), lambda x: x)
        return F.when(F.coalesce(overlaps, F.lit(False)), F.aggregate(F.concat(k, stop), start, step, Growing.whole)).otherwise(F.transform(k, lambda x: x["span"]))

    return let(keyed, resolved)


def merge_adjacent(spans: Column) -> Column:
    """Join touching spans of the same name-like type; the lower score stands."""
    stop = F.array(F.lit(None)).cast(SPAN)

    def step(acc: Column, s: Column) -> Column:
        last = acc["last"]
        joins = (last["type"] == s["type"]) & s["type"].isin(*MERGED) & (last["end"] == s["start"])
        merged = _span(s["type"], last["start"], s["end"], F.least(last["score"], s["score"]), F.concat(last["value"], s["value"]))
        done = F.when(last.isNull(), F.array().cast(SPAN)).otherwise(F.array(last))
        return F.when(F.coalesce(joins, F.lit(False)), F.struct(merged.alias("last"), *Growing.same(acc))).otherwise(F.struct(s.alias("last"), *Growing.plus(acc, done)))

    start = F.struct(F.lit(None).cast(SPAN[6:-1]).alias("last"), *Growing.empty(SPAN))
    return F.aggregate(F.concat(spans, stop), start, step, Growing.whole)


def detect(docs: DataFrame, text: str = "text", engines: Iterable[Engine] = (), column: str = "spans", engine_threshold: float = 0.0) -> DataFrame:
    """``docs`` plus ``column``: resolved and merged spans. Null texts have none.

    Spans of ``engines`` below ``engine_threshold`` are dropped; rules have fixed scores.
    """
    sure = [lambda t, e=e: F.filter(e(t).cast(SPAN), lambda s: s["score"] >= engine_threshold) for e in engines]
    found = F.coalesce(candidates(F.col(text), sure), F.array().cast(SPAN))
    resolved = docs.withColumn(column, let(found, lambda c: F.when(F.size(c) > 1, resolve_overlaps(c)).otherwise(c)))
    return resolved.withColumn(column, merge_adjacent(F.col(column))) if sure else resolved  # rules make no names


def span_rows(found: DataFrame, keys: list[str], column: str = "spans") -> DataFrame:
    """(``keys``, s): a row for each span of ``column``.

    ``explode`` would make the optimizer test the size of the array below the projection that makes it, and so
    evaluate all rules again for each test; ``explode_outer`` with the null row dropped after it does not.
    """
    return found.select(*keys, F.explode_outer(column).alias("s")).where("s IS NOT NULL")


def gazetteer_engine(names: dict[str, list[str]], score: float = 0.9) -> Engine:
    """A name engine from fixed lists: type to surface forms; a stand-in for a trained one behind the same protocol."""

    def run(text: Column) -> Column:
        out = []
        for kind, forms in names.items():
            quoted = "|".join(rf"\Q{f}\E" for f in sorted(forms, key=len, reverse=True))
            out.append(F.transform(matches(text, rf"{LEFT}(?:{quoted}){RIGHT}"), named(kind)))
        return F.concat(*out)

    def named(kind: str) -> Callable[[Column], Column]:
        return lambda m: _span(F.lit(kind), m["start"], m["end"], F.lit(score), m["value"])

    return run
