"""Tables that grow with the input don't pass through the driver, whatever Spark takes their size to be."""

from pyspark.sql import functions as F

from pathloom.llm import common, simhash


def plan(df):
    return df._jdf.queryExecution().toString()


def test_anchors_are_not_broadcast(spark):
    prints = common.stored(spark.range(500).select(F.xxhash64("id").alias("_fp")), "prints")
    # the counts of anchors, exploded 32 times, are the larger side of a join that Spark takes for a small one
    assert "Broadcast" not in plan(simhash.links(prints))


def test_a_side_over_the_limit_is_shuffled(spark):
    left, right = spark.range(100), common.stored(spark.range(50), "right")
    assert "Broadcast" not in plan(left.join(common.small_side(right, 10), "id"))
    assert "Broadcast" in plan(left.join(common.small_side(right, 50), "id"))
