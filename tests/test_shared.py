import os

from pyspark.sql import functions as F

from genosieve.sources import shared


def test_cut_counts_and_clears(spark):
    df, n = shared.cut_counting(spark.range(100).repartition(3), even=F.col("id") % 2 == 0, none=F.col("id") < 0)
    assert n == {"even": 50, "none": 0} and df.count() == 100
    folder = shared._own_folder(spark).removeprefix("file://")
    assert any(x.startswith("cut-") for x in os.listdir(folder))
    shared.clear(spark)
    assert not os.path.exists(folder)
    assert shared.cut(spark.range(3)).count() == 3  # and goes on
