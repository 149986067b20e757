"""Many values in many texts, against the product of both."""

import random

import numpy as np
from pyspark.sql import functions as F

from huisclos.operators.search import anchors, runs_in, values_in_texts


def test_equals_the_product(spark):
    rng = random.Random(6)
    bits = ["é", "😀", "ab", "a", " ", "1", "12", "/", "mail", "@", "Dupont", "œ", "0612"]
    make = lambda n: "".join(rng.choice(bits) for _ in range(n))
    values = [(f"d{i % 3}", make(rng.randint(1, 6))) for i in range(150)] + [("d0", None), ("d0", ""), (None, "a"), ("d1", "é" * 200), ("d1", "a" * 300), ("d0", "ab"), ("d0", "ab"), ("d9", "a")]
    texts = [(f"d{i % 4}", i, make(rng.randint(0, 60))) for i in range(120)] + [("d0", 200, None), ("d0", 201, ""), (None, 202, "a"), ("d1", 203, "x" + "é" * 201), ("d1", 204, "a" * 299), ("d1", 205, "a" * 300), ("d0", 206, "ab"), ("d0", 206, "ab"), ("d0", 207, values[0][1] + "b" * 50_000 + values[3][1])]
    have = spark.createDataFrame(texts, "d string, n long, text string").repartition(3)
    known = spark.createDataFrame(values, "d string, value string")
    got = sorted((r["n"], r["value"]) for r in values_in_texts(have, known, ["d"]).collect())
    want = sorted((n, v) for d, n, t in texts for v in {v for e, v in values if e == d and v and d} if t and v in t)
    assert got == want and len(got) > 500
    assert values_in_texts(have.limit(0), known, ["d"]).count() == 0 and values_in_texts(have, known.limit(0), ["d"]).count() == 0


def test_anchors_are_rare(spark):
    """A value's anchor is not the ending that all values of its dossier share."""
    values = spark.range(500).select(F.lit("d").alias("d"), F.concat(F.format_string("%04d", "id"), F.lit("@mail.fr.example")).alias("value"))
    most = anchors(values, ["d"]).groupBy("size", "run").count().agg(F.max("count")).first()[0]
    assert most == 1
    one = anchors(spark.createDataFrame([("d", "\x00ab"), ("d", "ÿÿÿÿÿÿ")], "d string, value string"), ["d"]).collect()
    assert {r["size"] for r in one} == {2, 8}


def test_a_big_dossier_is_not_a_product(spark):
    """20,000 texts and 20,000 values of one dossier; each text holds two values."""
    n = 20_000
    values = spark.range(n).select(F.lit("d").alias("d"), F.format_string("nom%07d@mail.fr", F.col("id") * 7919).alias("value"))
    texts = spark.range(n).select(F.lit("d").alias("d"), "id", F.concat(F.lit("vu "), F.format_string("nom%07d@mail.fr", F.col("id") * 7919), F.lit(" et "), F.format_string("nom%07d@mail.fr", F.pmod(F.col("id") + 1, F.lit(n)) * 7919)).alias("text"))
    found = values_in_texts(texts, values, ["d"])
    assert "NestedLoop" not in found._jdf.queryExecution().explainString(found.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert found.count() == 2 * n


def test_runs_stay_inside_texts():
    full = np.full((1 << 24) // 8 + 4096, 255, dtype=np.uint8)
    text, run = runs_in(b"abcab", np.array([0, 3, 3, 5]), 2, full, most=2)
    assert list(zip(text.tolist(), run.tolist())) == [(0, 0x6162), (0, 0x6263), (2, 0x6162)]
    assert len(runs_in(b"", np.array([0, 0]), 8, full)[0]) == 0
