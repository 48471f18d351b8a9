"""Settings texts are completed row by row."""

from pyspark.sql import functions as F

from tideline.plans.mine import settings_table


def test_settings_of_a_text_need_no_join(spark):
    texts = spark.createDataFrame([(1, "seed: 5\nn: 3\nn_cl: 7\nn_cl: 8\nzzz: 1"), (2, ""), (3, None), (4, "see : 6\nn_clusters: 9"), (5, "n_clusters: 1\ncutoff_v: 2 : 3")], "id long, text string")
    out = settings_table(texts, "text")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Cartesian" not in plan
    got = {(r["id"], r["name"]): r["value"] for r in out.where(F.col("name").isin("seed", "n_clusters", "cutoff_value")).collect()}
    assert [got[i, "n_clusters"] for i in range(1, 6)] == ["8", "16", "16", "9", "1"]
    assert [got[i, "seed"] for i in range(1, 6)] == ["5", "743", "743", "6", "743"]
    assert got[5, "cutoff_value"] == "2 : 3"
