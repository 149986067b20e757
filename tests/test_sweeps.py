"""Recall and precision by sweeps, against all pairs of spans."""

import random
import re

import pytest
from pyspark.sql import functions as F

from huisclos.operators import evaluate
from huisclos.operators.evaluate import correct_detections, covered_truth, recall_precision

SPANS = "doc_id string, type string, start int, end int"


@pytest.mark.parametrize("stretch", [1 << 16, 7])
def test_sweeps_equal_all_pairs(spark, monkeypatch, stretch):
    monkeypatch.setattr(evaluate, "STRETCH", stretch)
    rng = random.Random(5)

    def made(n):
        return [(rng.choice("de"), rng.choice(("X", "Y")), a, a + rng.randint(1, 9)) for a in (rng.randrange(90) for _ in range(n))]

    true, found = made(120), made(90) + [("d", "Z", 0, 5)]
    t, f = spark.createDataFrame(true, SPANS), spark.createDataFrame(found, SPANS)
    same = lambda a, b: a[:2] == b[:2]
    want = sorted(a for a in true if any(same(a, b) and b[2] <= a[2] and b[3] >= a[3] for b in found))
    assert sorted(map(tuple, covered_truth(t, f).collect())) == want and 10 < len(want) < 110
    right = sorted(b for b in found if any(same(a, b) and b[2] < a[3] and b[3] > a[2] for a in true))
    assert sorted(map(tuple, correct_detections(f, t).collect())) == right and 10 < len(right) < 91
    assert covered_truth(t, f.limit(0)).count() == correct_detections(f, t.limit(0)).count() == covered_truth(t.limit(0), f).count() == 0


def test_a_document_of_many_spans(spark):
    """100,000 spans of one type in one document; no join of spans with spans."""
    n = 100_000
    true = spark.range(n).selectExpr("'d' AS doc_id", "'X' AS type", "cast(id * 10 AS int) AS start", "cast(id * 10 + 4 AS int) AS end")
    found = spark.range(n).selectExpr("'d' AS doc_id", "'X' AS type", "cast(id * 10 + id % 2 AS int) AS start", "cast(id * 10 + 4 + id % 3 AS int) AS end")
    row = recall_precision(true, found).first()
    assert (row["n_true"], row["n_covered"], row["n_found"], row["n_correct"]) == (n, n // 2, n, n)
    for df in (covered_truth(true, found), correct_detections(found, true)):
        joins = [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
        # with the sums of earlier stretches, one row a stretch, or by a span's own number; never spans with spans
        assert joins and all("stretch" in j or "__n" in j for j in joins)


def test_matches_and_occurrences_against_plain_ones(spark):
    """Also in texts that hold the character that stands for a match, and beyond the basic plane."""
    from huisclos.functions.regex import MARK, matches, occurrences

    value = r"a\Ea"
    texts = [None, "", value, value * 3, f"😀{value}é{value}", f"{MARK}{value}{MARK}{MARK}{value}", MARK, "aa", r"x\Ea\Ea\E", "a" + value + "12 345"]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, text string").withColumn("value", F.lit(value))
    got = rows.select("n", matches(F.col("text"), r"\d+|a\\Ea").alias("m"), occurrences(F.col("text"), F.col("value")).alias("o")).collect()
    for r in got:
        text = texts[r["n"]]
        plain = lambda pattern: None if text is None else [(m.start(), m.end(), m[0]) for m in re.finditer(pattern, text)]
        tell = lambda found: None if found is None else [tuple(m) for m in found]
        assert tell(r["m"]) == plain(r"\d+|a\\Ea") and tell(r["o"]) == plain(re.escape(value))


def test_matches_are_evaluated_once_for_each_text(spark):
    """Rows of matches come from one evaluation, and true values are found without a pattern for each row."""
    from huisclos.operators.evaluate import truth_spans
    from huisclos.operators.rewrite import placeholders_in

    docs = spark.range(3).select(F.col("id").alias("doc_id"), F.concat(F.lit("[EMAIL_001] a"), "id").alias("text"))
    plan = placeholders_in(docs, ["doc_id"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    truth = docs.select("doc_id", F.lit("EMAIL").alias("type"), F.lit("a").alias("value"))
    assert "regexp_extract_all" not in truth_spans(docs, truth)._jdf.queryExecution().optimizedPlan().toString()
