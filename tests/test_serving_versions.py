import pytest
from pyspark.sql import functions as F

from genosieve.sources import io


def test_readers_follow_the_published_version(spark, tmp_path):
    path = f"file://{tmp_path}"
    for version in ("a", "b"):
        t = spark.range(6).select("id", (F.col("id") % 2).alias("cid"), F.lit(version).alias("v"))
        io.write_serving({"points": t, "index": t.drop("cid")}, path, version)
        if version == "a":
            with pytest.raises(Exception, match="PATH_NOT_FOUND"):
                io.current_version(spark, path)
        io.publish(spark, path, version)
        assert io.current_version(spark, path) == version
        assert {r.v for r in io.read_serving(spark, path, "points").collect()} == {version}
    assert {r.v for r in io.read_serving(spark, path, "index", "a").collect()} == {"a"}
    io.publish(spark, path, "a")  # back again
    assert io.current_version(spark, path) == "a" and io.read_serving(spark, path, "points").where("cid = 1").count() == 3
