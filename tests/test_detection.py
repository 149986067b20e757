import random

import pytest
from pyspark.sql import functions as F

from huisclos.functions.labels import PRIORITY
from huisclos.functions.validators import iban_valid, luhn_valid, nir_key, nir_valid
from huisclos.operators.detect import RULES, SPAN, TRIMMED, detect, gazetteer_engine, merge_adjacent, resolve_overlaps, span_rows


def found(spark, texts, engines=()):
    rows = detect(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string"), engines=engines).orderBy("i").collect()
    return [[(s["type"], s["start"], s["end"], s["value"]) for s in r["spans"]] for r in rows]


def test_validators(spark):
    df = spark.createDataFrame([("1800374118218", "2920782045033")], "a string, b string").select(nir_key(F.col("a")), nir_key(F.col("b")))
    assert tuple(df.first()) == (22, 55)
    cases = {
        nir_valid: {"1 80 03 74 118 218 22": True, "1 80 03 74 118 218 23": False, "": False, None: False},
        luhn_valid: {"824750004": True, "82475000400007": True, "824750005": False, "82475OOO4": False, "": False, None: False},
        iban_valid: {"FR11 3000 3000 1100 0987 6543 185": True, "FR12 3000 3000 1100 0987 6543 185": False, "FR11": False, None: False},
    }
    for f, expected in cases.items():
        rows = spark.createDataFrame([(k,) for k in expected], "v string").select(f(F.col("v")).alias("ok")).collect()
        assert [r["ok"] for r in rows] == list(expected.values()), f.__name__
    corsica = spark.createDataFrame([("180032A118218",), ("292072B045033",)], "b string").select("b", nir_key(F.col("b")).alias("k")).collect()
    for r in corsica:
        n = int(r["b"].replace("A", "0").replace("B", "0")) - (1_000_000 if "A" in r["b"] else 2_000_000)
        assert r["k"] == 97 - n % 97


CASES = [
    ("SIRET : 824 750 004 00007.", ["FR_SIRET"]),
    ("Numéro de sécurité sociale 1 80 03 74 118 218 23.", ["FR_NIR_SUSPECT"]),
    ("Le numéro 1 80 03 74 118 218 23 est cité.", []),
    ("NIR : 1 76 12 69 123 094 58.", ["FR_NIR_SUSPECT"]),
    ("Commune de Castelsarrasin, SIRET 218 200 339 00017.", ["FR_SIRET_SUSPECT"]),
    ("docteur Hélène Vasseur (RPPS 10100456789), présente.", ["RPPS"]),
    ("Matricule de l'agent titulaire :\n2014-0883.", ["MATRICULE"]),
    ("NIR :\n\nLe relevé mentionne 1 79 03 26 121 044 88 en marge.", []),
    ("Domiciliée 51480 Œuilly depuis 2019.", ["CODE_POSTAL"]),
    ("45000 EUR", []),
    ("82000\nMontant", []),
    ("IBAN FR11 3000 3000 1100 0987 6543 185", ["IBAN"]),
    ("Appeler le 06 12 34 56 78 ou ab.cd@exemple.fr", ["TELEPHONE", "EMAIL"]),
    ("Plaque AB-123-CD, dossier DOS-2024-0012", ["PLAQUE", "REFERENCE_DOSSIER"]),
    ("né le 14 mars 1979, séance du 12/02/2026 puis 1er juillet 2025", ["DATE_NAISSANCE", "DATE_PROCEDURALE", "DATE_PROCEDURALE"]),
    ("Date de naissance : 03.04.1980", ["DATE_NAISSANCE"]),
    ("Date de naissance : x12/02/1979", ["DATE_NAISSANCE"]),
    ("le 12/02/2026bis, 112/02/1979, le12 mars 1979, 12/02/20261", ["DATE_PROCEDURALE"] * 4),
    ("SIREN 824 750 005", ["FR_SIREN_SUSPECT"]),
    ("RIB FR12 3000 3000 1100 0987 6543 185", ["IBAN_SUSPECT"]),
    ("", []),
    (None, []),
]


def test_rules(spark):
    for (text, types), got in zip(CASES, found(spark, [t for t, _ in CASES])):
        assert [g[0] for g in got] == types, text
        for _, a, b, value in got:
            assert text[a:b] == value


def test_offsets_are_code_points(spark):
    text = "😀 é 😀 a@b.fr et 06 12 34 56 78"
    for _, a, b, value in found(spark, [text])[0]:
        assert text[a:b] == value


def test_engine_trimmed_and_merged(spark):
    text = "Contacter Marie Martin, marie.martin@exemple.fr au plus vite."
    whole = lambda t: F.array(F.struct(F.lit("PERSONNE").alias("type"), F.lit(10).alias("start"), F.lit(47).alias("end"), F.lit(0.9).alias("score"), F.substring(t, 11, 37).alias("value")))
    assert [g[0::3] for g in found(spark, [text], [whole])[0]] == [("PERSONNE", "Marie Martin"), ("EMAIL", "marie.martin@exemple.fr")]
    names = gazetteer_engine({"LIEU": ["Paris"], "PERSONNE": ["Jean Dupont"]})
    assert [g[0] for g in found(spark, ["Jean Dupont à Paris"], [names])[0]] == ["PERSONNE", "LIEU"]


def by_hand(spans, text):
    order = sorted(spans, key=lambda s: (PRIORITY.index(s[0]), -(s[2] - s[1]), -s[3]))
    owner = [None] * len(text)
    kept = []
    for kind, a, b, score, _ in order:
        free, i = [], a
        if all(owner[p] is None for p in range(a, b)):
            free = [(a, b, False)]
        else:
            while i < b:
                j = i
                while j < b and owner[j] is None:
                    j += 1
                if j > i:
                    free.append((i, j, True))
                i = max(j, i + 1)
        for x, y, rest in free:
            while rest and x < y and text[x] in TRIMMED:
                x += 1
            while rest and x < y and text[y - 1] in TRIMMED:
                y -= 1
            if x < y:
                kept.append((kind, x, y, score, text[x:y]))
                owner[x:y] = [1] * (y - x)
    return sorted(kept, key=lambda s: s[1])


def test_overlaps_against_a_greedy_of_our_own(spark):
    rng, rows = random.Random(5), []
    for i in range(300):
        text = "".join(rng.choice("ab ,.") for _ in range(24))
        spans = []
        for _ in range(rng.randint(0, 6)):
            a = rng.randint(0, 22)
            b = rng.randint(a + 1, 24)
            spans.append((rng.choice(PRIORITY[:8]), a, b, rng.choice([0.5, 0.7]), text[a:b]))
        rows.append((i, text, spans))
    df = spark.createDataFrame(rows, f"i int, text string, spans {SPAN}").withColumn("spans", resolve_overlaps(F.col("spans")))
    got = {r["i"]: [tuple(s) for s in r["spans"]] for r in df.collect()}
    for i, text, spans in rows:
        assert got[i] == by_hand(spans, text), (text, spans)


@pytest.mark.parametrize("spans, n", [([("LIEU", 3, 15, 0.9, "avenue de l'"), ("LIEU", 15, 21, 0.8, "Europe")], 1), ([("PERSONNE", 0, 13, 0.9, "Sophie MARTIN"), ("PERSONNE", 14, 25, 0.9, "Paul DURAND")], 2), ([("EMAIL", 0, 3, 0.9, "a@b"), ("EMAIL", 3, 6, 0.9, "c@d")], 2)])
def test_merge(spark, spans, n):
    out = spark.createDataFrame([(spans,)], f"spans {SPAN}").select(merge_adjacent(F.col("spans")).alias("s")).first()["s"]
    assert len(out) == n
    if n == 1:
        assert tuple(out[0])[1:4] == (3, 21, 0.8)


def test_each_rule_is_evaluated_once_a_row(spark, capsys):
    df = spark.range(3).select("id", F.concat(F.lit("a@b.fr "), F.col("id").cast("string")).alias("text"))
    spans = span_rows(detect(df), ["id"]).select("id", "s.type", "s.start")
    spans.explain("extended")
    plan = capsys.readouterr().out.split("== Physical Plan ==")[1]
    assert plan.count("regexp_extract_all") == len(RULES) and spans.count() == 3


def test_a_long_log_ends(spark):
    n = 5_000
    text = "".join(f"12/02/20{i % 90 + 10} x{i}\n" for i in range(n))
    spans = detect(spark.createDataFrame([(text,)], "text string")).first()["spans"]
    assert len(spans) == n and all(text[s["start"] : s["end"]] == s["value"] for s in spans[::997])
