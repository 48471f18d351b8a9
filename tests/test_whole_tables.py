"""Registered queries read whole tables."""

from pyspark.sql import functions as F

from tideline.plans import function_queries


def test_equal_except_for_compares_all_events(spark, tmp_path):
    """Only events outside event_id % 5 = 1 differ from the zeros they are compared with."""
    spark.range(50).select(F.col("id").alias("event_id"), F.when(F.col("id") % 5 == 1, 0.0).otherwise(1.0).alias("value")).write.parquet(f"{tmp_path}/events.parquet")
    got = function_queries.equal_except_for(spark, str(tmp_path)).collect()
    assert sorted(r["event_id"] for r in got) == list(range(50))
