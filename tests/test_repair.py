"""Repairs and checks by joins, against the array functions and on a large dossier."""

import random

from pyspark.sql import functions as F

from huisclos.operators.integrity import check, restore_tokens
from huisclos.operators.repair import check_replies, restore_replies, spellings

KEYS = ["dossier_id", "n"]


def test_joins_equal_arrays(spark):
    rng = random.Random(2)
    types = ["PERSONNE", "EMAIL", "SIRET", "SIREN", "SIRET_SUSPECT", "SIREN_SUSPECT", "REFERENCE", "FONCTION", "FONCTIONS", "TYPE_A"]
    known = {f"d{i}": sorted({f"[{rng.choice(types)}_{rng.choice((1, 1, 2, 3, 1000)):03d}]" for _ in range(rng.randint(0, 8))}) for i in range(8)}

    def spoiled():
        kind = list(rng.choice(types))
        for _ in range(rng.choice((0, 0, 1, 1, 2))):
            at = rng.randrange(len(kind))
            kind[at : at + rng.choice((0, 1))] = rng.choice(("", "É", "X", "e"))
        kind = "".join(kind)
        kind = rng.choice((kind, kind.lower(), kind.capitalize()))
        number = rng.choice(("1", "01", "001", "2", "003", "1000", "10001", "9" * 40))
        return rng.choice((f"[{kind}_{number}]", f"[{kind} {number}]", f"[{kind}-{number}]", f"{kind}_{number}", f"{kind}-{number}", f"x[{kind}", f"{kind} {number}", "é😀", "\n"))

    rows = [(f"d{i % 9}", i, None if i % 50 == 7 else "".join(rng.choice(("", " ", ", ", "]")) + spoiled() for _ in range(rng.randint(0, 9)))) for i in range(500)]
    replies = spark.createDataFrame(rows, "dossier_id string, n long, text string")
    table = spark.createDataFrame([(d, p) for d, ps in known.items() for p in ps], "dossier_id string, placeholder string")
    arrays = replies.join(table.groupBy("dossier_id").agg(F.array_sort(F.collect_set("placeholder")).alias("known")), "dossier_id", "left")
    want = {r["n"]: r["t"] for r in arrays.select("n", restore_tokens(F.col("text"), F.col("known")).alias("t")).collect()}
    got = {r["n"]: r["text"] for r in restore_replies(replies, table, KEYS).collect()}
    assert got == want and sum(got[i] != t for _, i, t in rows) > 80
    sent = arrays.select(*KEYS, F.explode(F.slice("known", 1, 2)).alias("placeholder"))
    for legacy in (False, True):
        one = F.slice("known", 1, 2)
        expected = {r["n"]: r["c"].asDict() for r in arrays.select("n", check(F.col("text"), one, F.col("known"), legacy).alias("c")).collect()}
        found = {r["n"]: r["report"].asDict() for r in check_replies(replies, sent, table, KEYS, legacy_nearest_type=legacy).collect()}
        for n, text in ((i, t) for _, i, t in rows):
            if text is None:
                assert found[n]["ok"] is None and found[n]["action"] == "review_required"
            else:
                assert found[n] == expected[n], text


def test_spellings_meet_within_one_edit(spark):
    pairs = [("EMAIL", "EMIL"), ("EMAIL", "EMAIIL"), ("EMAIL", "EMOIL"), ("EMAIL", "EMIAL"), ("A", ""), ("", "")]
    rows = spark.createDataFrame(pairs, "a string, b string").select(F.size(F.array_intersect(spellings(F.col("a")), spellings(F.col("b")))) > 0).collect()
    assert [r[0] for r in rows] == [True, True, True, True, True, True]


def test_a_dossier_of_a_million_placeholders(spark):
    known = spark.range(1, 1_000_001).select(F.lit("d").alias("dossier_id"), F.format_string("[EMAIL_%03d]", "id").alias("placeholder"))
    texts = [("d", 1, "EMIL_999999, [EMAIL 3] et email-0042"), ("d", 2, "[EMAIL_1000001] [EMAIL_77]")]
    replies = spark.createDataFrame(texts, "dossier_id string, n long, text string")
    fixed = restore_replies(replies, known, KEYS)
    assert {r["n"]: r["text"] for r in fixed.collect()} == {1: "[EMAIL_999999], [EMAIL_003] et [EMAIL_042]", 2: "[EMAIL_1000001] [EMAIL_077]"}
    sent = spark.createDataFrame([("d", 1, "[EMAIL_003]"), ("d", 1, "[EMAIL_004]")], "dossier_id string, n long, placeholder string")
    got = {r["n"]: (r["report"]["ok"], r["report"]["unknown"], r["report"]["missing"]) for r in check_replies(fixed, sent, known, KEYS).collect()}
    assert got == {1: (True, [], ["[EMAIL_004]"]), 2: (False, ["[EMAIL_1000001]"], [])}
