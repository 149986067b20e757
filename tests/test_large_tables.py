"""What only larger tables show: references that repeat, and joins that would gather millions of rows in the driver."""

from datetime import datetime

from pyspark.sql import functions as F

from huisclos.operators.repair import check_replies, restore_replies
from huisclos.plans.materialize import written
from huisclos.plans.queries import protected_texts


def test_each_order_has_its_own_reference(spark, tmp_path):
    keys = [5, 1_000_005, 2_000_005, 54_000_005]
    orders = spark.createDataFrame([(k, 1, datetime(1998, 2, 6)) for k in keys], "o_orderkey long, o_custkey long, o_orderdate timestamp")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1,)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    got = {r["seq"]: r["protected"] for r in protected_texts(spark, str(tmp_path)).collect()}
    assert [got[k].split(" ")[1] for k in keys] == [f"[REFERENCE_{n:03d}]" for n in range(1, 5)]


def test_replies_and_placeholders_are_not_broadcast(spark):
    keys = ["dossier_id", "n"]
    replies = spark.range(200).select(F.col("id").cast("string").alias("dossier_id"), F.col("id").alias("n"), F.lit("Vu [EMAIL 1] et EMAL-1 et [PLAQUE_009]").alias("text"))
    known = written(replies.select("dossier_id", F.explode(F.array(F.lit("[EMAIL_001]"), F.lit("[PLAQUE_001]"))).alias("placeholder")))
    fixed = written(restore_replies(replies, known, keys))
    got = check_replies(fixed, known.withColumn("n", F.col("dossier_id").cast("long")), known, keys)
    assert "BroadcastExchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.select("text", F.concat_ws(",", "report.unknown"), F.concat_ws(",", "report.missing")).distinct().collect() == [("Vu [EMAIL_001] et [EMAIL_001] et [PLAQUE_009]", "[PLAQUE_009]", "[PLAQUE_001]")]
