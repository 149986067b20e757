"""Steps that most queries share, as they have to be on large tables: what they cost shows in their plans."""

import re

from pyspark.sql import functions as F

from huisclos.functions.regex import MARK, matches
from huisclos.operators.detect import LONG, RULES
from huisclos.plans.pseudonymize import pseudonymize
from huisclos.sources.docx import docx_of, docx_paragraphs


def test_a_text_meets_its_spans_once(spark):
    docs = [("A", 1, "a@b.fr, z@b.fr et a@b.fr"), ("A", 2, "rien"), ("A", 3, None), ("B", 1, "AB-123-CD le 02/03/2001, a@b.fr")]
    policies = spark.createDataFrame([("A", "EMAIL", "revue"), ("B", "PLAQUE", "conserver"), ("B", "EMAIL", "masquer")], "dossier_id string, type string, action string")
    texts = pseudonymize(spark.createDataFrame(docs, "dossier_id string, seq long, text string"), policies).texts
    got = {(r["dossier_id"], r["seq"]): (r["protected"], r["counts"], r["in_review"]) for r in texts.collect()}
    assert got["A", 1] == ("[EMAIL_001], [EMAIL_002] et [EMAIL_001]", {"EMAIL": 3}, ["[EMAIL_001]", "[EMAIL_002]"])
    assert got["A", 2] == ("rien", None, None) and got["A", 3] == (None, None, None)
    assert got["B", 1] == ("AB-123-CD le 02/03/2001, [EMAIL]", {"DATE_PROCEDURALE": 1, "EMAIL": 1, "PLAQUE": 1}, [])
    # counts by type take no shuffle of their own
    assert not re.search(r"hashpartitioning\(dossier_id#\d+, seq#\d+L?, type#", texts._jdf.queryExecution().executedPlan().toString())


def test_paragraphs_of_many_files_are_handed_on_together(spark):
    files = [(str(i), 1, docx_of(["un", "deux"], ["trois"], "t")) for i in range(50)] + [("x", 1, b"PK")]
    read = docx_paragraphs(spark.createDataFrame(files, "dossier_id string, seq long, content binary").coalesce(1))
    assert "MapInArrow" in read._jdf.queryExecution().executedPlan().toString()
    rows = read.collect()
    assert [r["text"] for r in rows if r["dossier_id"] == "7"] == ["un", "deux", "trois", "t"] and len(rows) == 201 and rows[-1]["error_kind"] == "FichierIllisible"


def test_matches_in_turn(spark):
    texts = ["", "rien", "1", "é12", "12é", "a1b22c", f"{MARK}", f"a{MARK}1{MARK}22", "1 2 3", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1).select(matches(F.col("text"), r"\d+")).collect()]
    want = [t if t is None else [(m.start(), m.end(), m[0]) for m in re.finditer(r"\d+", t)] for t in texts]
    assert [g if g is None else [tuple(x) for x in g] for g in got] == want


def test_long_rules_need_their_digits(spark):
    held = {"FR_NIR": "1 80 03 2A 118 218 22", "FR_SIRET": "824 750 004 00007", "FR_SIREN": "824 750 004", "RPPS": "10100456789", "TELEPHONE": "06.12-34 56.78", "CARTE_BANCAIRE": "4111-1111 1111-1111"}
    assert set(held) == {r.type for r in RULES if r.long}
    rules = {r.type: r.pattern for r in RULES}
    rows = spark.createDataFrame([(rules[k], v) for k, v in held.items()], "pattern string, text string")
    assert rows.select(F.rlike("text", F.col("pattern")) & F.rlike("text", F.lit(LONG))).distinct().collect() == [(True,)]
