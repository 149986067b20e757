"""Streams: people in the state store, the same whatever the batches and after a restart."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from huisclos.operators.coreference import resolve_people
from huisclos.operators.detect import gazetteer_engine
from huisclos.plans.job import options_from, run_job
from huisclos.sources.vault_store import VaultStore, people_store
from huisclos.streaming.incremental import pseudonymize_stream

DOCS = "dossier_id string, seq long, text string"
NAMES = ["Jean Dupont", "M. Dupont", "Marie Dupont", "Mme Dupont", "J. Dupont", "jean dupont", "Paul Martin", "P. Martin", "Mme Martin", "Dupont", "Jean Paul Dupont"]


def run(spark, folder, batches, **options):
    """A query for each batch: every one but the first is a restart from the checkpoint."""
    (folder / "in").mkdir(parents=True)
    got = {}

    def sink(texts, n):
        got.update({(r["dossier_id"], r["seq"]): r["protected"] for r in texts.collect()})

    for rows in batches:
        spark.createDataFrame(rows, DOCS).coalesce(1).write.mode("append").parquet(str(folder / "in"))
        stream = spark.readStream.schema(DOCS).parquet(str(folder / "in"))
        query = pseudonymize_stream(stream, f"file://{folder}/vault", sink, str(folder / "checkpoint"), **options)
        query.awaitTermination(180)
        assert query.exception() is None
    return got


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(21)
    return [(d, i, f"{rng.choice(NAMES)} écrit à {rng.choice('abc')}@b.fr, puis {rng.choice(NAMES)}.") for i in range(14) for d in ("A", "B")]


def test_people_do_not_depend_on_batches(spark, tmp_path, docs):
    engine = gazetteer_engine({"PERSONNE": NAMES})
    policies = spark.createDataFrame([("Z", "PERSONNE", "masquer")], "dossier_id string, type string, action string")
    docs = docs + [("Z", 0, "Jean Dupont et a@b.fr")]
    whole = run(spark, tmp_path / "one", [docs], engines=[engine], coreference=True, policies=policies)
    cuts = [docs[:5], docs[5:17], docs[17:]]
    assert run(spark, tmp_path / "three", cuts, engines=[engine], coreference=True, policies=policies) == whole
    assert whole["Z", 0] == "[PERSONNE] et [EMAIL_001]"
    # the people of one fold over all mentions
    mentions = spark.createDataFrame(docs[:-1], DOCS).select("dossier_id", "seq", F.explode(engine(F.col("text"))).alias("s")).select("dossier_id", "seq", "s.start", F.col("s.value").alias("surface"))
    want = {(r["dossier_id"], r["surface"]): (r["number"], r["canonical"], r["ambiguous"]) for r in resolve_people(mentions).collect()}
    left = {(r["dossier_id"], r["surface"]): (r["number"], r["canonical"], r["ambiguous"]) for r in people_store(spark, f"file://{tmp_path}/three/vault").read().collect()}
    assert {k: v[0] for k, v in left.items()} == {k: v[0] for k, v in want.items()} and len({v[0] for v in want.values()}) > 2
    numbers = {(r["dossier_id"], r["surface"]): r["number"] for r in VaultStore(spark, f"file://{tmp_path}/three/vault").read().collect()}
    assert sorted(itertools.chain.from_iterable([n for (d, _), n in numbers.items() if d == x] for x in "AB")) == [1, 1, 2, 2, 3, 3]


def test_job_with_people_and_fake_names(spark, tmp_path):
    settings = {"HUISCLOS_ENGINE": "names", "HUISCLOS_COREFERENCE": "oui", "HUISCLOS_VAULT_PATH": f"file://{tmp_path}/vault", "HUISCLOS_VAULT_KEY": "0123456789abcdef"}
    engines = {"names": gazetteer_engine({"PERSONNE": NAMES})}
    first = run_job(spark.createDataFrame([("A", 1, "Jean Dupont, a@b.fr, M. Dupont")], DOCS), options_from(settings), engines=engines)
    assert first.texts.first()["protected"] == "[PERSONNE_001], [EMAIL_001], [PERSONNE_001]"
    again = run_job(spark.createDataFrame([("A", 2, "Mme Dupont, M. Dupont")], DOCS), options_from(settings), engines=engines)
    assert again.texts.first()["protected"] == "[PERSONNE_002], [PERSONNE_001]"
    fake = run_job(spark.createDataFrame([("A", 3, "Paul Martin et a@b.fr")], DOCS), options_from(settings | {"HUISCLOS_SURROGATES": "true"}), engines=engines)
    name = {r["placeholder"]: r["surrogate"] for r in fake.surrogates.collect()}["[PERSONNE_003]"]
    assert fake.texts.first()["protected"] == f"{name} et [EMAIL_001]"
    with pytest.raises(ValueError):
        options_from({"HUISCLOS_SURROGATES": "vielleicht"})
