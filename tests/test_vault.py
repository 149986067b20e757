import re

import pytest
from pyspark.sql import functions as F

from huisclos.operators import policy
from huisclos.operators.coreference import resolve_people
from huisclos.operators.detect import gazetteer_engine
from huisclos.operators.integrity import check, restore_tokens
from huisclos.operators.rewrite import reidentify
from huisclos.operators.vault import guard_modes, key_table, number_surfaces, opened, purge, sealed
from huisclos.plans.pseudonymize import pseudonymize, serious_view

DOCS = "dossier_id string, seq long, text string"


def test_numbers_policy_and_round_trip(spark):
    docs = spark.createDataFrame(
        [("A", 1, "Écrire à a@b.fr ou b@b.fr, tél 06 12 34 56 78"), ("A", 2, "Encore b@b.fr, c@b.fr 12/02/2026"), ("B", 1, "b@b.fr"), ("B", 2, None), ("C", 1, "x@y.fr 06 11 22 33 44")], DOCS
    )
    policies = spark.createDataFrame([("C", "EMAIL", "masquer"), ("C", "TELEPHONE", "revue")], "dossier_id string, type string, action string")
    done = pseudonymize(docs, policies)
    got = {(r["dossier_id"], r["seq"]): r for r in done.texts.collect()}
    assert got["A", 1]["protected"] == "Écrire à [EMAIL_001] ou [EMAIL_002], tél [TELEPHONE_001]"
    assert got["A", 2]["protected"] == "Encore [EMAIL_002], [EMAIL_003] 12/02/2026"
    assert got["A", 2]["counts"] == {"EMAIL": 2, "DATE_PROCEDURALE": 1}
    assert got["B", 1]["protected"] == "[EMAIL_001]" and got["B", 2]["protected"] is None
    assert got["C", 1]["protected"] == "[EMAIL] [TELEPHONE_001]" and got["C", 1]["in_review"] == ["[TELEPHONE_001]"]
    back = reidentify(done.texts.select("dossier_id", "seq", F.col("protected").alias("text")), done.canonical, ["dossier_id", "seq"])
    restored = {(r["dossier_id"], r["seq"]): r["restored"] for r in back.collect()}
    assert restored["A", 1] == "Écrire à a@b.fr ou b@b.fr, tél 06 12 34 56 78" and restored["C", 1] == "[EMAIL] 06 11 22 33 44"
    more = pseudonymize(spark.createDataFrame([("A", 3, "d@b.fr a@b.fr")], DOCS), known=done.surfaces)
    assert more.texts.first()["protected"] == "[EMAIL_004] [EMAIL_001]"
    assert set(serious_view(done.spans).columns) == {"dossier_id", "seq", "type", "start", "end", "score"}


def test_numbers_pass_999(spark):
    mentions = spark.range(0, 9000, 3).select(F.lit("D").alias("dossier_id"), F.col("id").alias("seq"), F.lit(0).alias("start"), F.lit("EMAIL").alias("type"), F.concat(F.lit("u"), F.col("id")).alias("surface"))
    rows = {r["surface"]: r["placeholder"] for r in number_surfaces(mentions).collect()}
    assert rows["u0"] == "[EMAIL_001]" and rows["u8997"] == "[EMAIL_3000]" and len(set(rows.values())) == 3000


def test_coreference_in_a_job(spark):
    docs = spark.createDataFrame([("A", 1, "Jean Dupont puis M. Dupont"), ("A", 2, "Mme Dupont")], DOCS)
    engine = gazetteer_engine({"PERSONNE": ["Jean Dupont", "M. Dupont", "Mme Dupont"]})
    done = pseudonymize(docs, engines=[engine], coreference=True)
    assert [r["protected"] for r in done.texts.orderBy("seq").collect()] == ["[PERSONNE_001] puis [PERSONNE_001]", "[PERSONNE_002]"]
    more = spark.createDataFrame([("A", 3, "Mme Dupont et M. Martin, M. Dupont"), ("B", 1, "Jean Dupont")], DOCS)
    names = gazetteer_engine({"PERSONNE": ["Jean Dupont", "M. Dupont", "Mme Dupont", "M. Martin"]})
    after = pseudonymize(more, known=done.surfaces, engines=[names], coreference=True, people=done.people)
    assert [r["protected"] for r in after.texts.orderBy("dossier_id").collect()] == ["[PERSONNE_002] et [PERSONNE_003], [PERSONNE_001]", "[PERSONNE_001]"]


@pytest.mark.parametrize(
    "mentions, numbers, ambiguous, canonical",
    [
        (["Jean Dupont", "M. Dupont"], [1, 1], set(), {1: "Jean Dupont"}),
        (["Jean Dupont", "Marie Dupont", "M. Dupont"], [1, 2, 3], {3}, None),
        (["M. Dupont", "Jean Dupont"], [1, 1], set(), {1: "Jean Dupont"}),
        (["M. Dupont", "Mme Dupont"], [1, 2], set(), None),
        (["Jean Paul Dupont", "Jean Marc Dupont"], [1, 2], set(), None),
        (["Jean Dupont", "M. Dupont", "Pierre Dupont", "M. Dupont"], [1, 1, 2, 1], {1}, None),
        (["jean dupont", "Jean Dupont"], [1, 1], set(), {1: "Jean Dupont"}),
        (["J. Dupont", "Jean Dupont"], [1, 1], set(), {1: "Jean Dupont"}),
    ],
)
def test_coreference(spark, mentions, numbers, ambiguous, canonical):
    rows = [("A", n, 0, m) for n, m in enumerate(mentions)]
    got = {r["surface"]: r for r in resolve_people(spark.createDataFrame(rows, "dossier_id string, seq long, start int, surface string")).collect()}
    assert [got[m]["number"] for m in mentions] == numbers
    assert {r["number"] for r in got.values() if r["ambiguous"]} == ambiguous
    assert canonical is None or {r["number"]: r["canonical"] for r in got.values()} == canonical


KNOWN = ["[PERSONNE_001]", "[EMAIL_001]", "[REFERENCE_001]"]


def test_integrity(spark):
    cases = [
        ("Personne_001 et [personne 1]", "[PERSONNE_001] et [PERSONNE_001]"),
        ("REFERANCE_001, [Référence_001]", "[REFERENCE_001], [REFERENCE_001]"),
        ("il n'y a personne 1 minute, l'article_12", "il n'y a personne 1 minute, l'article_12"),
        ("[EMAIL 1]", "[EMAIL_001]"),
    ]
    df = spark.createDataFrame([(a, b, KNOWN) for a, b in cases], "t string, want string, known array<string>")
    for r in df.select("want", restore_tokens(F.col("t"), F.col("known")).alias("got")).collect():
        assert r["got"] == r["want"]
    df = spark.createDataFrame([("[PERSONNE_999]", KNOWN, KNOWN), ("rien", KNOWN, KNOWN), ("[SIRET_001]", ["[SIRET_001]"], ["[SIRET_001]"]), ("[EMAIL_10001]", ["[EMAIL_10001]"], ["[EMAIL_10001]"])], "t string, sent array<string>, known array<string>")
    rows = df.select(check(F.col("t"), F.col("sent"), F.col("known")).alias("c"), check(F.col("t"), F.col("sent"), F.col("known"), True).alias("old")).collect()
    assert rows[0]["c"]["unknown"] == ["[PERSONNE_999]"] and rows[0]["c"]["action"] == "review_required"
    assert rows[1]["c"]["ok"] and rows[1]["c"]["missing"] == sorted(KNOWN)
    assert rows[2]["c"]["ok"] and rows[2]["old"]["unknown"] == ["[SIREN_001]"]
    assert rows[3]["c"]["ok"] and not rows[3]["c"]["missing"]
    both = spark.createDataFrame([("SIRET_SUSPECT_001", ["[SIRET_SUSPECT_001]", "[SIREN_SUSPECT_001]"])], "t string, known array<string>")
    assert both.select(restore_tokens(F.col("t"), F.col("known"))).first()[0] == "[SIRET_SUSPECT_001]"


def test_policy_parsing(spark):
    assert policy.parse(" EMAIL = masquer ,, IBAN=revue") == {"EMAIL": "masquer", "IBAN": "revue"}
    for bad in ("EMAIL", "EMIAL=masquer", "EMAIL=cacher"):
        with pytest.raises(ValueError):
            policy.parse(bad)
    bad = spark.createDataFrame([("A", "EMAIL", "cacher")], "dossier_id string, type string, action string")
    with pytest.raises(Exception, match=re.escape("unknown type or action")):
        policy.as_maps(bad).collect()
    maps = spark.createDataFrame([({"EMAIL": "masquer", "IBAN": "revue"}, {"EMAIL": "conserver"})], "a map<string,string>, b map<string,string>")
    assert maps.select(policy.override(F.col("a"), F.col("b"))).first()[0] == {"EMAIL": "conserver", "IBAN": "revue"}


def test_vault_tables(spark):
    key = key_table(spark, "0123456789abcdef")
    table = spark.createDataFrame([("A", "x@y.fr"), ("B", None)], "dossier_id string, surface string")
    closed = sealed(table, ["surface"], key)
    assert closed.where("surface like '%@%'").count() == 0
    assert sorted(map(tuple, opened(closed, ["surface", "alias"], key).select("dossier_id", "surface", "alias").collect()), key=str) == [("A", "x@y.fr", None), ("B", None, None)]
    assert [r["dossier_id"] for r in purge(table, table.where("dossier_id = 'A'")).collect()] == ["B"]
    modes = spark.createDataFrame([("A", "serieux"), ("B", "demo")], "dossier_id string, mode string")
    asked = spark.createDataFrame([("B", "demo"), ("B", "serieux"), ("A", "serieux"), ("Z", "serieux")], "dossier_id string, mode string")
    assert [r["refused"] for r in guard_modes(modes, asked).orderBy("dossier_id", "mode").collect()] == [None, "demo_refused", "conflict", None]


def test_dossiers_share_tasks_and_cross_batches(spark):
    """No Python call for each dossier, and a dossier's people go on where a batch ends."""
    rows = [(f"d{k}", n, 0, ("Jean Dupont", "M. Dupont", "Marie Dupont", "Paul Martin", "J. Martin")[(n + k) % 5]) for k in range(40) for n in range(7)]
    mentions = spark.createDataFrame(rows, "dossier_id string, seq long, start int, surface string")
    whole = resolve_people(mentions)
    assert "FlatMapGroups" not in whole._jdf.queryExecution().toString()
    want = sorted(map(tuple, whole.collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert sorted(map(tuple, resolve_people(mentions).collect())) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k in range(40):  # each dossier alone gives the same
        one = mentions.where(mentions.dossier_id == f"d{k}") if k % 20 == 0 else None
        assert one is None or sorted(map(tuple, resolve_people(one).collect())) == [r for r in want if r[0] == f"d{k}"]
