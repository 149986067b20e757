import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from huisclos.operators import judge
from huisclos.operators.evaluate import assign_canaries, canary_match, canary_rate, leaks, recall_precision, truth_spans
from huisclos.operators.surrogates import apply_surrogates, assign_surrogates
from huisclos.plans.conversation import converse
from huisclos.sources import audit, connectors
from huisclos.sources.corpus import read_canaries, read_texts, read_truth, write_baseline
from huisclos.sources.files import extract
from huisclos.streaming.incremental import pseudonymize_stream

ITEM = {"segment": "le maire", "type_candidat": "fonction", "justification": "unique", "score": 0.8}


@pytest.mark.parametrize(
    "raw, n",
    [
        (json.dumps([ITEM]), 1),
        ("[]", 0),
        ("<think>hm</think>\n```json\n" + json.dumps([ITEM]) + "\n```", 1),
        (json.dumps([ITEM | {"score": 0.2}]), 0),
        (json.dumps([ITEM | {"segment": " [EMAIL_001] "}]), 0),
        ("rien", None),
        (None, None),
        (json.dumps(ITEM), None),
        (json.dumps([ITEM | {"score": True}]), None),
        (json.dumps([ITEM | {"score": 1.5}]), None),
        (json.dumps([ITEM | {"score": "0.8"}]), None),
        (json.dumps([ITEM | {"segment": "  "}]), None),
        (json.dumps([ITEM | {"autre": 1}]), None),
        (json.dumps([ITEM, {"segment": "x"}]), None),
    ],
)
def test_judge_is_strict(spark, raw, n):
    row = judge.read_judge(spark.createDataFrame([(raw, "Vu 😀 par le maire")], "raw string, text string"))
    got = judge.locate(row, "text").first()
    assert (got["error_kind"] is not None) == (n is None) and len(got["candidates"]) == (n or 0)
    if n:
        assert (got["located"][0]["start"], got["located"][0]["end"]) == (9, 17) and "segment" not in got["located"][0].asDict()


def test_measures(spark):
    docs = spark.createDataFrame([("d", "Paris, à Paris. (x) Lyon")], "doc_id string, text string")
    truth = truth_spans(docs, spark.createDataFrame([("d", "LIEU", "Paris"), ("d", "LIEU", "(x)"), ("d", "ORGANISATION", "absent")], "doc_id string, type string, value string"))
    assert sorted((r["start"], r["end"]) for r in truth.collect()) == [(0, 5), (9, 14), (16, 19)]
    found = spark.createDataFrame([("d", "LIEU", 0, 6), ("d", "LIEU", 10, 14), ("d", "PERSONNE", 20, 24)], "doc_id string, type string, start int, end int")
    rows = {r["type"]: (r["n_true"], r["n_covered"], r["recall"], r["precision"]) for r in recall_precision(truth, found).collect()}
    assert rows == {"LIEU": (3, 1, 1 / 3, 1.0), "PERSONNE": (0, 0, None, 0.0)}
    sent = spark.createDataFrame([("A", "rien ici"), ("A", "vu Dupont")], "dossier_id string, protected string")
    known = spark.createDataFrame([("A", "Dupont"), ("B", "rien")], "dossier_id string, value string")
    assert [r["value"] for r in leaks(sent, known, ["dossier_id"]).collect()] == ["Dupont"]


def test_canaries_take_one_candidate_each(spark):
    assert assign_canaries([("a", ["le maire du village"]), ("b", ["le maire"])], ["Le  MAIRE"]) == {"a": 0, "b": None}
    assert assign_canaries([("a", ["dans le même temps"])], ["dans le même bureau"]) == {"a": None}
    assert assign_canaries([("a", ["ancien directeur adjoint"])], ["un directeur ancien"]) == {"a": 0}
    left = spark.createDataFrame([("d", 0, "a", ["x y"]), ("d", 1, "b", ["z"]), ("e", 0, "a", ["q"])], "doc_id string, n int, canary string, extracts array<string>")
    right = spark.createDataFrame([("d", 0, "x y z")], "doc_id string, n int, segment string")
    matched = canary_match(left, right)
    assert {(r["doc_id"], r["canary"]): r["signaled"] for r in matched.collect()} == {("d", "a"): True, ("d", "b"): False, ("e", "a"): False}
    assert abs(canary_rate(matched).first()["rate"] - 1 / 3) < 1e-12 and canary_rate(matched.limit(0)).first()["rate"] == 0.0


def test_surrogates(spark):
    people = spark.createDataFrame([("A", "[PERSONNE_001]", "Mme Roux"), ("A", "[PERSONNE_002]", "Luc Petit"), ("B", "[PERSONNE_001]", "M. Roux")], "dossier_id string, placeholder string, surface string")
    first = assign_surrogates(people)
    names = {(r["dossier_id"], r["placeholder"]): r["surrogate"] for r in first.collect()}
    assert len({names["A", "[PERSONNE_001]"], names["A", "[PERSONNE_002]"]}) == 2
    again = {(r["dossier_id"], r["placeholder"]): r["surrogate"] for r in assign_surrogates(people, first).collect()}
    assert again == names
    texts = spark.createDataFrame([("A", 1, "[PERSONNE_001] et [PERSONNE_001]"), ("Z", 1, "[PERSONNE_001]")], "dossier_id string, seq long, protected string")
    assert {r["protected"] for r in apply_surrogates(texts, first).collect()} == {" et ".join([names["A", "[PERSONNE_001]"]] * 2), "[PERSONNE_001]"}


def test_conversation_gate(spark):
    messages = spark.createDataFrame([("A", 0, "user", "Je suis a@b.fr"), ("A", 1, "user", "Répondre à a@b.fr"), ("B", 0, "user", "tél 06 12 34 56 78"), ("C", 0, "user", "rien")], "dossier_id string, seq long, role string, text string")

    def answer(requests):
        said = F.when(F.col("dossier_id") == "A", "Noté : email_001").when(F.col("dossier_id") == "B", "[TELEPHONE_007]").otherwise("ok")
        return requests.withColumn("reply", said).withColumn("error_kind", F.lit(None).cast("string"))

    _, replies = converse(messages, back_end=answer)
    got = {r["dossier_id"]: (r["answer"], r["report"]["ok"]) for r in replies.collect()}
    assert got == {"A": ("Noté : a@b.fr", True), "B": ("[TELEPHONE_007]", False), "C": ("ok", True)}


def test_prompt_only_where_needed_and_failures_without_payload(spark):
    rows = spark.createDataFrame([("A", [("user", "[EMAIL_001]")]), ("B", [("user", "rien")])], "conv_id string, messages array<struct<role:string,content:string>>")
    sent = rows.withColumn("messages", connectors.with_system_prompt(F.col("messages")))
    assert {r["conv_id"]: len(r["messages"]) for r in sent.collect()} == {"A": 2, "B": 1}

    def factory():
        def client(messages):
            if len(messages) > 1:
                raise TimeoutError(messages[-1]["content"])
            return "oui"

        return client

    assert {tuple(r) for r in connectors.complete(sent, factory, calls=connectors.Calls(pause=0.01)).collect()} == {("A", None, "TimeoutError"), ("B", "oui", None)}


def test_options():
    with pytest.raises(ValueError, match="private"):
        connectors.Options(judge_url="http://example.com/v1", judge_model="m", judge_answers="/a")
    with pytest.raises(ValueError):
        connectors.Options(vault_path="/v")
    with pytest.raises(ValueError):
        connectors.Options(engine_threshold=2)
    with pytest.raises(ValueError):
        connectors.Options(judge_url="http://192.168.1.4:11434/v1", judge_model="m")
    assert connectors.Options(judge_url="http://192.168.1.4:11434/v1", judge_model="m", judge_answers="/a").judge_model == "m"
    assert connectors.private_host("http://localhost:1/") and connectors.private_host("http://[::1]:80/") and not connectors.private_host("http://8.8.8.8/")


def docx(paragraphs, cells):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    para = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    table = "<w:tbl><w:tr>" + "".join(f"<w:tc>{para(c)}</w:tc>" for c in cells) + "</w:tr></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{''.join(map(para, paragraphs))}{table}</w:body></w:document>")
    return out.getvalue()


def test_files(spark):
    files = [("/a/x.TXT", "été".encode()), ("/a/y.csv", "é;1".encode("latin-1")), ("/a/z.docx", docx(["un", "deux"], ["c", "d"])), ("/a/bad.docx", b"no"), ("/a/p.pdf", b"no"), ("/a/q.exe", b"x"), ("/a/none", b"x")]
    got = {r["path"]: (r["text"], r["error_kind"]) for r in extract(spark.createDataFrame(files, "path string, content binary")).collect()}
    assert got["/a/x.TXT"] == ("été", None) and got["/a/y.csv"] == ("é;1", None)
    assert got["/a/z.docx"] == ("un\ndeux\nc\td", None) and got["/a/bad.docx"] == (None, "FichierIllisible")
    assert got["/a/q.exe"] == got["/a/none"] == (None, "FormatNonSupporte") and got["/a/p.pdf"][0] is None


def test_corpus(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    for name in ("a.md", "b.md"):
        (tmp_path / "docs" / name).write_text(f"texte {name}\nfin")
    (tmp_path / "t.json").write_text(json.dumps({"_note": "x", "a.md": {"LIEU": ["Paris", "Lyon"]}}))
    (tmp_path / "c.json").write_text(json.dumps({"canaris": [{"id": "k1", "description": "d", "extraits": ["x"], "_c": 1}]}))
    truth = read_truth(spark, str(tmp_path / "t.json"))
    assert sorted(map(tuple, truth.collect())) == [("a.md", "LIEU", "Lyon"), ("a.md", "LIEU", "Paris")]
    assert [tuple(r) for r in read_texts(spark, str(tmp_path / "docs"), truth).collect()] == [("a.md", "texte a.md\nfin")]
    assert tuple(read_canaries(spark, str(tmp_path / "c.json")).first())[:2] == (0, "k1")
    with pytest.raises(ValueError):
        write_baseline(truth, "other", "reference", str(tmp_path / "b"))


def test_audit_has_no_text(spark, tmp_path):
    rows = spark.createDataFrame([("r1", "A", "secret", {"EMAIL": 1})], "request_id string, dossier_id string, text string, counts map<string,int>")
    audit.append(rows, str(tmp_path / "audit"))
    audit.append(rows, str(tmp_path / "audit"))
    assert audit.events(rows).columns == list(audit.FIELDS) and not set(audit.FIELDS) & {"text", "value", "content"}
    lines = spark.read.text(str(tmp_path / "audit")).collect()
    assert len(lines) == 2 and not any("secret" in r["value"] for r in lines)


def test_stream_goes_on_numbering(spark, tmp_path):
    (tmp_path / "in").mkdir()
    got = {}

    def sink(texts, n):
        got.update({(r["dossier_id"], r["seq"]): r["protected"] for r in texts.collect()})

    for n, rows in enumerate([[("A", 1, "a@b.fr")], [("A", 2, "c@b.fr a@b.fr"), ("B", 1, "c@b.fr")]]):
        spark.createDataFrame(rows, "dossier_id string, seq long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("dossier_id string, seq long, text string").parquet(str(tmp_path / "in"))
        query = pseudonymize_stream(stream, str(tmp_path / "vault"), sink, str(tmp_path / "checkpoint"))
        query.awaitTermination(120)
        assert query.exception() is None, n
    assert got == {("A", 1): "[EMAIL_001]", ("A", 2): "[EMAIL_002] [EMAIL_001]", ("B", 1): "[EMAIL_001]"}
