"""Numbers over all rows, without a window over all rows."""

from pyspark.sql import functions as F

from pathloom.operators.numbering import numbered


def test_numbers_follow_the_order(spark):
    rows = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5003).alias("k"), F.lit(1).alias("x"))
    got = numbered(rows, "n", F.desc("k")).collect()
    assert [r["n"] for r in sorted(got, key=lambda r: -r["k"])] == list(range(1, 5001))


def test_ties_nulls_and_no_rows(spark):
    rows = spark.createDataFrame([(None,), (1,), (1,), (None,)], "k int")
    assert sorted((r["n"], r["k"]) for r in numbered(rows, "n", F.col("k").asc_nulls_first()).collect()) == [(1, None), (2, None), (3, 1), (4, 1)]
    assert numbered(rows.limit(0), "n", "k").count() == 0
