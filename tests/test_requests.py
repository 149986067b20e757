"""Chat requests from documents, and what a page shows."""

import json

import pytest

from huisclos.operators.detect import gazetteer_engine
from huisclos.plans.conversation import answer_view, converse_requests
from huisclos.plans.pseudonymize import pseudonymize
from huisclos.sources.requests import read_requests

GOOD = {"model": "m", "messages": [{"role": "user", "content": "à a@b.fr"}]}


@pytest.mark.parametrize(
    "change, ok",
    [
        ({}, True), ({"stream": True}, True), ({"temperature": 1, "max_tokens": 5}, True), ({"temperature": None, "max_tokens": None}, True), ({"other": [1]}, True), ({"messages": []}, True),
        ({"messages": [{"role": "user", "content": "x", "name": "y"}]}, True), ({"max_tokens": 5.0}, True),
        ({"model": None}, False), ({"model": 3}, False), ({"messages": None}, False), ({"messages": "x"}, False), ({"messages": [1]}, False), ({"messages": [{"role": "user"}]}, False), ({"messages": [{"role": "user", "content": None}]}, False),
        ({"messages": [{"role": "user", "content": ["x"]}]}, False), ({"stream": "true"}, False), ({"stream": None}, False), ({"temperature": "1"}, False), ({"max_tokens": 1.5}, False), ({"max_tokens": 1e12}, False),
    ],
)
def test_request_rules(spark, change, ok):
    row = read_requests(spark.createDataFrame([(json.dumps(GOOD | change),)], "raw string")).first()
    assert (row["request"] is not None) == ok and (row["error_kind"] is None) == ok
    if ok:
        assert row["request"]["stream"] == bool(change.get("stream")) and row["request"]["max_tokens"] in (None, 5)


def test_documents_are_answered_or_refused(spark):
    documents = [("A", json.dumps(GOOD)), ("B", json.dumps(GOOD | {"stream": True, "model": "n"})), ("C", "{"), ("D", None), ("E", json.dumps(GOOD | {"messages": []})), ("F", json.dumps({k: v for k, v in GOOD.items() if k != "model"}))]
    answers, trail = converse_requests(spark.createDataFrame(documents, "dossier_id string, raw string"))
    got = {r["dossier_id"]: (r["error_kind"], r["response"] and (r["response"]["model"], r["response"]["choices"][0]["message"]["content"])) for r in answers.collect()}
    assert got == {"A": (None, ("m", "à a@b.fr")), "B": (None, ("n", "à a@b.fr")), **{d: ("RequeteInvalide", None) for d in "CDEF"}}
    assert sorted((r["dossier_id"], r["status"]) for r in trail.collect()) == [("B", "stream_refused"), ("C", "refused"), ("D", "refused"), ("E", "refused"), ("F", "refused")]


def test_pages_show_values_in_demo_only(spark):
    docs = spark.createDataFrame([("A", 1, "Jean Roux, a@b.fr, IBAN"), ("A", 2, "rien"), ("A", 3, None), ("A", 4, "Luc Roux et M. Roux")], "dossier_id string, seq long, text string")
    done = pseudonymize(docs, engines=[gazetteer_engine({"PERSONNE": ["Jean Roux", "Luc Roux", "M. Roux"]})], coreference=True)
    serious = {r["seq"]: r["view"].asDict(recursive=True) for r in answer_view(done).collect()}
    assert serious[1] == {"mode": "serieux", "text": "[PERSONNE_001], [EMAIL_001], IBAN", "counts": {"PERSONNE": 1, "EMAIL": 1}, "ambiguous": [], "in_review": [], "detections": [{"type": "PERSONNE", "start": 0, "end": 9, "score": 0.9}, {"type": "EMAIL", "start": 11, "end": 17, "score": 0.95}]}
    assert serious[2]["detections"] == [] and serious[3]["text"] is None and serious[4]["ambiguous"] == ["[PERSONNE_003]"]
    demo = {r["seq"]: r["view"] for r in answer_view(done, "demo").collect()}
    assert [d["surface"] for d in demo[1]["detections"]] == ["Jean Roux", "a@b.fr"] and demo[4]["detections"][1]["placeholder"] == "[PERSONNE_003]"
    with pytest.raises(ValueError):
        answer_view(done, "x")
