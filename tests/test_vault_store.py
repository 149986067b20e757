"""The vault at rest: buckets, deltas, commits, sealing."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from huisclos.operators.vault import SURFACES, key_table, opened, sealed
from huisclos.plans.job import options_from, run_job, vault_of
from huisclos.plans.pseudonymize import pseudonymize
from huisclos.sources.vault_store import VaultConflict, VaultStore

DOCS = "dossier_id string, seq long, text string"
KEY = "0123456789abcdef"


def plans_of(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString
    return " ".join(df._jdf.queryExecution().explainString(mode(m)) for m in ("extended", "formatted", "codegen"))


def rows(store, *dossiers):
    asked = store.spark.createDataFrame([(d,) for d in dossiers], "dossier_id string") if dossiers else None
    return {(r["dossier_id"], r["surface"]): r["number"] for r in store.read(asked).collect()}


def test_batches_write_only_what_is_new(spark, tmp_path):
    store = VaultStore(spark, f"file://{tmp_path}/vault", key_table(spark, KEY), buckets=16)
    assert store.version() == 0 and rows(store) == {}
    want = {}
    for n, texts in enumerate((["a@b.fr", "c@d.fr"], ["c@d.fr e@f.fr"], ["e@f.fr"])):
        docs = spark.createDataFrame([(d, n * 10 + i, t) for d in "ABCDEFGH" for i, t in enumerate(texts)], DOCS)
        done = pseudonymize(docs, known=store.read(docs))
        version = store.append(done.fresh, store.version())
        assert version == (1, 2, 2)[n]  # the last batch knows everything and commits nothing
        for r in done.surfaces.collect():
            assert want.setdefault((r["dossier_id"], r["surface"]), r["number"]) == r["number"]
    assert rows(store) == want and len(want) == 24
    first, second = (store.path.removeprefix("file://") + "/" + c.folder for c in store.commits())
    count = lambda f: spark.read.parquet(f).count()
    assert (count(first), count(second)) == (16, 8)
    assert store.compact() == 3 and rows(store) == want and len(store.commits()) == 1
    assert store.compact() == 3 and store.clear() == 2 and rows(store) == want


def test_only_own_buckets_are_opened(spark, tmp_path):
    store = VaultStore(spark, f"file://{tmp_path}/vault", buckets=64)
    many = spark.range(3000).select(F.concat(F.lit("d"), F.col("id")).alias("dossier_id"), F.lit("EMAIL").alias("type"), F.lit("x@y.fr").alias("surface"), F.lit("[EMAIL_001]").alias("placeholder"), F.lit(1).cast("long").alias("number"))
    store.append(many, 0)
    one = store.read(spark.createDataFrame([("d7",), (None,)], "dossier_id string"))
    assert one.count() == 1
    opened_files = one.select(F.input_file_name()).distinct().count()
    scanned = [p for p in one.inputFiles() if "bucket=" in p]
    assert opened_files == 1 and "PartitionFilters: [bucket" in plans_of(one) and len({p.split("bucket=")[1].split("/")[0] for p in scanned}) <= 64


def test_a_second_writer_fails(spark, tmp_path):
    path = f"file://{tmp_path}/vault"
    made = options_from({"HUISCLOS_VAULT_PATH": path, "HUISCLOS_VAULT_KEY": KEY})
    one, two = vault_of(spark, made), vault_of(spark, made)
    docs = lambda t: spark.createDataFrame([("A", 1, t)], DOCS)
    left, right = pseudonymize(docs("a@b.fr"), known=one.read(docs(""))), pseudonymize(docs("c@d.fr"), known=two.read(docs("")))
    assert left.texts.first()["protected"] == right.texts.first()["protected"] == "[EMAIL_001]"
    one.append(left.fresh, 0)
    with pytest.raises(VaultConflict):
        two.append(right.fresh, 0)
    # the race after the version was read
    with pytest.raises(VaultConflict):
        two._commit(type(two.commits()[0])(1, two._write(right.fresh, 1)))
    assert rows(one) == {("A", "a@b.fr"): 1}
    assert run_job(docs("c@d.fr a@b.fr"), made).texts.first()["protected"] == "[EMAIL_002] [EMAIL_001]"
    assert len(list(Path(f"{tmp_path}/vault/data").iterdir())) == 2  # the losers' rows are gone
    Path(f"{tmp_path}/vault/commits/{3:020d}").write_text("")
    with pytest.raises(ValueError, match="not finished"):
        one.version()


def test_no_plan_holds_the_key(spark, tmp_path):
    (tmp_path / "key").write_text(KEY + "\n")
    (tmp_path / "k").mkdir()
    table = spark.createDataFrame([("A", "EMAIL", "x@y.fr", "[EMAIL_001]", 1)], SURFACES)
    for key in (key_table(spark, KEY), key_table(spark, path=f"file://{tmp_path}/key")):
        closed = sealed(table, ["surface"], key)
        back = opened(closed, ["surface"], key)
        assert KEY not in plans_of(closed) and KEY not in plans_of(back)
        assert closed.columns == table.columns and back.first()["surface"] == "x@y.fr"
    made = options_from({"HUISCLOS_VAULT_PATH": f"file://{tmp_path}/vault", "HUISCLOS_VAULT_KEY_FILE": f"file://{tmp_path}/key"})
    docs = spark.createDataFrame([("A", 1, "a@b.fr")], DOCS)
    done = run_job(docs, made)
    assert KEY not in plans_of(done.surfaces) and KEY not in plans_of(vault_of(spark, made).read(docs)) and KEY not in repr(made)
    held = "".join(p.read_bytes().decode("latin-1") for p in Path(f"{tmp_path}/vault").rglob("*") if p.is_file())
    assert "a@b.fr" not in held and KEY not in held
    with pytest.raises(ValueError):
        options_from({"HUISCLOS_VAULT_PATH": "x", "HUISCLOS_VAULT_KEY": KEY, "HUISCLOS_VAULT_KEY_FILE": "y"})


def test_later_rows_replace_earlier_ones(spark, tmp_path):
    store = VaultStore(spark, f"file://{tmp_path}/people", schema="dossier_id string, surface string, canonical string", sensitive=("surface", "canonical"), identity=("dossier_id", "surface"), key=key_table(spark, KEY))
    store.append(spark.createDataFrame([("A", "M. Roux", "M. Roux"), ("B", "M. Roux", "M. Roux")], store.schema), 0)
    store.append(spark.createDataFrame([("A", "M. Roux", "Luc Roux")], store.schema), 1)
    assert sorted(map(tuple, store.read().collect())) == [("A", "M. Roux", "Luc Roux"), ("B", "M. Roux", "M. Roux")]
    names = sorted(Path(f"{tmp_path}/people/commits").glob("0*"))
    assert [json.loads(p.read_text())["whole"] for p in names] == [False, False]
    store.compact()
    assert sorted(map(tuple, store.read().collect())) == [("A", "M. Roux", "Luc Roux"), ("B", "M. Roux", "M. Roux")]
