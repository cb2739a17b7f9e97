"""A rank between two values that are both more frequent than a buffer holds."""

from pyspark.sql import functions as F

from tabsmith.operators.quantiles import exact_quantiles


def test_a_rank_between_two_frequent_values_ends(spark):
    df = spark.range(40).select((F.col("id") % 2 * 3 + 1).cast("double").alias("a"), (F.col("id") % 4).alias("b"))
    found = exact_quantiles(df, ["a", "b"], [0.25, 0.5, 0.75], buffer_values=5)
    assert found == {"a": [1.0, 2.5, 4.0], "b": [0.75, 1.5, 2.25]}
