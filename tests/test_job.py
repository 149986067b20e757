import pytest
from pyspark.sql import functions as F

from huisclos.operators.detect import gazetteer_engine
from huisclos.plans.conversation import chat_response, without_streaming
from huisclos.plans.job import options_from, run_job

DOCS = "dossier_id string, seq long, text string"


def test_options_take_effect_and_the_vault_goes_on(spark, tmp_path):
    made = options_from({"HUISCLOS_POLICIES": "EMAIL=masquer", "HUISCLOS_ENGINE": "names", "HUISCLOS_ENGINE_THRESHOLD": "0.5", "HUISCLOS_VAULT_PATH": str(tmp_path / "vault"), "HUISCLOS_VAULT_KEY": "0123456789abcdef", "HUISCLOS_JUDGE_URL": "", "HOME": "/x"})
    sure, unsure = gazetteer_engine({"PERSONNE": ["Jean"]}, 0.9), gazetteer_engine({"LIEU": ["Paris"]}, 0.4)
    engines = {"names": lambda t: F.concat(sure(t), unsure(t))}
    first = run_job(spark.createDataFrame([("A", 1, "Jean a@b.fr AB-123-CD Paris")], DOCS), made, engines=engines)
    assert first.texts.first()["protected"] == "[PERSONNE_001] [EMAIL] [PLAQUE_001] Paris"
    assert spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "vault" / "data")).where("surface LIKE '%-123-%'").count() == 0
    own = spark.createDataFrame([("A", "EMAIL", "conserver")], "dossier_id string, type string, action string")
    again = run_job(spark.createDataFrame([("A", 2, "c@d.fr XY-123-CD AB-123-CD")], DOCS), made, own, engines)
    assert again.texts.first()["protected"] == "c@d.fr [PLAQUE_002] [PLAQUE_001]"
    with pytest.raises(ValueError):
        run_job(spark.createDataFrame([], DOCS), made, engines={})
    with pytest.raises(ValueError):
        options_from({"HUISCLOS_ENGIN": "x"})


def test_streams_are_refused_and_responses_shaped(spark):
    requests, trail = without_streaming(spark.createDataFrame([("A", True), ("B", False)], "dossier_id string, stream boolean"))
    assert requests.where("stream").count() == 0 and [(r["dossier_id"], r["status"]) for r in trail.collect()] == [("A", "stream_refused")]
    answers = spark.createDataFrame([("A", "oui", None, (True,)), ("B", None, "TimeoutError", None)], "dossier_id string, answer string, error_kind string, report struct<ok:boolean>")
    got = {r["dossier_id"]: r["response"]["choices"][0] for r in chat_response(answers, "m").collect()}
    assert got["A"]["message"]["content"] == "oui" and got["B"]["finish_reason"] == "error"
