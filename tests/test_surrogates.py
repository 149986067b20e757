"""Fake names: unique, of the right gender, never a real name; and back again, names inside names too."""

from pyspark.sql import functions as F

from huisclos.operators.rewrite import restore_surrogates
from huisclos.operators.surrogates import DEPTH, FEMALE_NAMES, FIRST, LAST, LAST_NAMES, MALE_NAMES, assign_surrogates, fake_name

PEOPLE = "dossier_id string, placeholder string, surface string"


def test_lists_do_not_clash():
    assert len(MALE_NAMES) == len(FEMALE_NAMES) == FIRST and not set(MALE_NAMES) & set(FEMALE_NAMES)
    assert len(set(LAST_NAMES)) == len(LAST_NAMES) and not any(set(" -") & set(n) for n in MALE_NAMES + FEMALE_NAMES + LAST_NAMES)
    assert sum(FIRST * LAST**k for k in range(1, DEPTH + 1)) > 10**15


def test_thousands_of_people_in_one_dossier(spark):
    n = 30_000
    title = F.when(F.col("id") % 3 == 0, "M. ").when(F.col("id") % 3 == 1, "Mme ").otherwise("")
    people = spark.range(1, n + 1).select(F.lit("d").alias("dossier_id"), F.format_string("[PERSONNE_%03d]", "id").alias("placeholder"), F.concat(title, F.lit("Nom"), F.col("id")).alias("surface"))
    got = assign_surrogates(people)
    assert "applyInPandas" not in got._jdf.queryExecution().toString() and "InPandas" not in got._jdf.queryExecution().toString()
    rows = got.withColumn("n", F.regexp_extract("placeholder", r"(\d+)", 1).cast("int")).collect()
    assert len(rows) == len({r["surrogate"] for r in rows}) == n
    for r in rows:
        first, last = r["surrogate"].split(" ")
        assert r["n"] % 3 == 2 or (first in MALE_NAMES) == (r["n"] % 3 == 0)
        assert len(last.split("-")) == (1 if r["n"] <= FIRST * LAST else 2 if r["n"] <= FIRST * LAST * (1 + LAST) else 3)
    assert len({r["surrogate"].split(" ")[1] for r in rows if r["n"] <= 500}) == LAST
    others = {r["surrogate"] for r in assign_surrogates(people.where("placeholder = '[PERSONNE_001]'").withColumn("dossier_id", F.lit("e"))).collect()} | {r["surrogate"] for r in assign_surrogates(people.limit(1), key="k").collect()}
    assert len(others) >= 1


def test_real_names_are_stepped_over(spark):
    """The dossier knows the first ten names that its person would get."""
    steps = spark.range(10).select(fake_name(F.lit("d"), F.lit(1).cast("long"), F.lit("f"), F.col("id").cast("int")).alias("name"))
    real = [r["name"] for r in steps.collect()]
    assert len(set(real)) == 10
    people = spark.createDataFrame([("d", "[PERSONNE_001]", "Mme X")] + [("d", f"[PERSONNE_{i + 2:03d}]", n) for i, n in enumerate(real)], PEOPLE)
    got = {r["placeholder"]: r["surrogate"] for r in assign_surrogates(people).collect()}
    assert len(got) == 11 and len(set(got.values())) == 11 and not set(got.values()) & set(real)
    known = spark.createDataFrame([("d", "[PERSONNE_001]", "Zoé Zeller")], "dossier_id string, placeholder string, surrogate string")
    again = {r["placeholder"]: r["surrogate"] for r in assign_surrogates(people, known).collect()}
    assert again["[PERSONNE_001]"] == "Zoé Zeller" and len(again) == 11


def test_names_inside_names_come_back(spark):
    pairs = [("d", "[PERSONNE_001]", "Luc Aubry"), ("d", "[PERSONNE_002]", "Luc Aubry-Bertin"), ("d", "[PERSONNE_003]", "Bertin"), ("d", "[PERSONNE_004]", "Jean Luc"), ("e", "[PERSONNE_001]", "Luc Aubry-Bertin")]
    names = spark.createDataFrame(pairs, "dossier_id string, placeholder string, surrogate string")
    rows = [("d", "Luc Aubry-Bertin, Luc Aubry et Bertin"), ("d", "Jean Luc Aubry"), ("d", "Luc aubry"), ("d", None), ("e", "Luc Aubry-Bertin et Luc Aubry"), ("f", "Bertin"), ("d", "Bertin"), ("d", "Bertin")]
    got = sorted((r["dossier_id"], r["text"] or "") for r in restore_surrogates(spark.createDataFrame(rows, "dossier_id string, text string"), names).collect())

    def plain(d, text):
        for p, s in sorted(((p, s) for e, p, s in pairs if e == d), key=lambda x: (-len(x[1]), x[1])):
            text = text and text.replace(s, p)
        return text or ""

    assert got == sorted((d, plain(d, t)) for d, t in rows)
    many = spark.range(200_000).select(F.lit("d").alias("dossier_id"), F.format_string("[PERSONNE_%03d]", "id").alias("placeholder"), F.format_string("Nom%06d Prenom", "id").alias("surrogate"))
    texts = spark.createDataFrame([("d", "Vu Nom000007 Prenom et Nom199999 Prenom.")], "dossier_id string, text string")
    assert restore_surrogates(texts, many).first()["text"] == "Vu [PERSONNE_007] et [PERSONNE_199999]."


def test_names_are_made_once(spark):
    """Whoever reads the names reads a table and makes none."""
    people = spark.createDataFrame([("d", f"[PERSONNE_{n:03d}]", f"Nom{n}") for n in range(1, 5)], PEOPLE)
    got = assign_surrogates(people)
    assert "xxhash64" not in got._jdf.queryExecution().optimizedPlan().toString().lower()
    assert got.count() == 4
