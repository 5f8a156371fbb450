from pyspark.sql import functions as F

from outlay.llm.common import likely_among


def test_keys_are_never_lost(spark):
    df = spark.range(3000).select("id", F.lit("x").alias("bits"), F.lit(1).alias("part_no"))
    df = df.unionByName(spark.createDataFrame([(None, "null", 1)], "id long, bits string, part_no int"))
    keys = spark.range(0, 3000, 3)
    got = {r.id for r in likely_among(df, "id", keys).collect()}
    assert got >= set(range(0, 3000, 3)) and len(got) < 1100
    assert likely_among(df, "id", keys).columns == df.columns
    assert likely_among(df, "id", keys.limit(0)).count() == 0
