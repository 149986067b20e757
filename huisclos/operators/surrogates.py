"""Fake names for people's placeholders, unique in a dossier and free of its real names.

A name is a function of the dossier, the placeholder's number and a key: a keyed permutation of the
space of first and last names carries numbers to names, so no two numbers of a dossier share one and
nothing has to be drawn in order. Names of one last name come first, then those of two, and so on, so
the space never ends. A name that is somebody's real name in the dossier is stepped over: it gets one of
a few last names more that no other name has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.regex import let
from ..plans.materialize import written
from .coreference import gender_of
from .rewrite import placeholders_in, replace_spans

#: First names, as many for men as for women, and last names to draw from.
MALE_NAMES = "Adrien Bruno Cyril Didier Émile Fabrice Gaston Hugo Ivan Jules Kévin Loïc Marius Noé Olivier Pascal Quentin Rémi Simon Théo Ulysse Victor William Xavier Yann".split()
FEMALE_NAMES = "Agathe Brigitte Céline Delphine Élodie Fanny Gisèle Hélène Inès Jade Karine Lucie Margot Nina Odile Paule Reine Sarah Tania Ursule Valérie Wendy Xénia Yasmine Zoé".split()
LAST_NAMES = "Aubry Bertin Carlier Delmas Estève Fabre Gaillard Hamel Imbert Jacquet Klein Laborde Marchal Navarro Olivier Pasquier Quesnel Rolland Sabatier Texier Urbain Vasseur Weber Ximenes Yvon Zeller".split()
#: The last of the last names mark steps.
STEPS = 6
FIRST, LAST = len(MALE_NAMES), len(LAST_NAMES) - STEPS
#: Last names in a name at most: enough for 10^15 people, and doubles still hold all numbers.
DEPTH = 11
ROUNDS = 4


def _picked(names: list[str], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (at + 1).cast("int"))


def fake_name(dossier: Column, number: Column, gender: Column, step: Column, key: str = "") -> Column:
    """The name of the person with this number (from 1): after ``step`` steps, by ``gender`` ``m``, ``f`` or null."""
    begin, depth, rest = 0, F.lit(None), F.lit(None)
    for k in range(1, DEPTH + 1):
        size = FIRST * LAST**k
        here = (number > begin) & (number <= begin + size)
        depth = F.when(here, k).otherwise(depth)
        rest = F.when(here, number - 1 - begin).otherwise(rest)
        begin += size
    widths = F.array(*(F.lit(LAST**k) for k in range(1, DEPTH + 1)))

    def halves(p: Column) -> Column:
        return F.struct(p["depth"].alias("depth"), F.element_at(widths, p["depth"]).alias("width"), F.pmod(p["rest"], F.lit(FIRST)).alias("first"), F.floor(p["rest"] / FIRST).alias("last"))

    def moved(s: Column, n: int) -> Column:
        """Each half moves by a hash of the other: a permutation of FIRST x LAST^depth."""
        by = lambda other, width: F.pmod(F.xxhash64(F.lit(key), dossier, F.lit(n), other), width)
        first = F.pmod(s["first"] + by(s["last"], F.lit(FIRST)), F.lit(FIRST))
        return let(first, lambda f: F.struct(s["depth"].alias("depth"), s["width"].alias("width"), f.alias("first"), F.pmod(s["last"] + by(f, s["width"]), s["width"]).alias("last")))

    def written_out(s: Column) -> Column:
        female = F.when(gender.isNull(), F.pmod(F.xxhash64(F.lit(key), dossier, number), F.lit(2)) == 0).otherwise(gender == "f")
        ours = F.transform(F.sequence(F.lit(0), s["depth"] - 1), lambda i: _picked(LAST_NAMES[:LAST], F.pmod(F.floor(s["last"] / F.pow(F.lit(float(LAST)), i)), F.lit(LAST))))
        # one name for each of the first steps, then as many of one name as steps
        few = F.when(step <= STEPS, F.array(_picked(LAST_NAMES[LAST:], F.greatest(step, F.lit(1)) - 1))).otherwise(F.array_repeat(F.lit(LAST_NAMES[LAST]), step))
        more = F.when(step == 0, F.array().cast("array<string>")).otherwise(few)
        return F.concat(F.when(female, _picked(FEMALE_NAMES, s["first"])).otherwise(_picked(MALE_NAMES, s["first"])), F.lit(" "), F.array_join(F.concat(ours, more), "-"))

    state = let(F.struct(depth.cast("int").alias("depth"), rest.cast("long").alias("rest")), halves)
    for n in range(ROUNDS):
        state = let(state, lambda s, n=n: moved(s, n))
    return let(state, written_out)


def assign_surrogates(people: DataFrame, known: DataFrame | None = None, key: str = "") -> DataFrame:
    """``people``: (dossier_id, placeholder, surface), numbered placeholders. Returns (dossier_id, placeholder, surrogate); ``known`` ones stay.

    Without ``key`` names can be derived by whoever knows this code; that tells a number, not a person.
    """
    people = written(people)  # read twice
    number = F.regexp_extract("placeholder", r"(\d+)\]$", 1).try_cast("long")
    real = people.select("dossier_id", F.col("surface").alias("surrogate"))
    whole = people.groupBy("dossier_id", "placeholder").agg(F.min(gender_of(F.col("surface"))).alias("gender")).withColumn("number", number).where("number > 0")
    if known is not None:
        whole = whole.join(known.select("dossier_id", "placeholder"), ["dossier_id", "placeholder"], "left_anti")
        real = real.unionByName(known.select("dossier_id", "surrogate"))
    taken, todo, done, step = written(real.distinct()), written(whole), None, 0
    while True:
        named = written(todo.withColumn("surrogate", fake_name(F.col("dossier_id"), F.col("number"), F.col("gender"), F.lit(step), key)))
        free = named.join(taken, ["dossier_id", "surrogate"], "left_anti").select("dossier_id", "placeholder", "surrogate")
        done = free if done is None else done.unionByName(free)
        # nearly always nobody
        todo = written(named.join(taken, ["dossier_id", "surrogate"], "left_semi").select(*todo.columns))
        if todo.isEmpty():
            return done if known is None else done.unionByName(known.select("dossier_id", "placeholder", "surrogate"))
        step += 1


def apply_surrogates(texts: DataFrame, surrogates: DataFrame, text: str = "protected", keys: tuple[str, ...] = ("dossier_id", "seq")) -> DataFrame:
    """All occurrences of each person's placeholder in the dossier's texts become the fake name.

    Tokens of texts join the names by (dossier, placeholder), so no dossier's names meet in one row. ``keys`` identify a text.
    """
    tokens = placeholders_in(texts, list(keys), text).join(surrogates.select("dossier_id", "placeholder", F.col("surrogate").alias("replacement")), ["dossier_id", "placeholder"])
    return replace_spans(texts, tokens.select(*keys, "start", "end", "replacement"), list(keys), text, text)
