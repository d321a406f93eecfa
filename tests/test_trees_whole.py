from pyspark.sql import functions as F

from genosieve.operators import aggregates as A
from genosieve.plans import trees as P
from genosieve.plans.filters import encoded


def test_all_variants_and_replicates_enter(spark, sf):
    assert (P.LIMIT, P.REPLICATES) == (5000, 100)
    sizes = {r.lineage: r.n for r in A.variants(encoded(spark, sf)).where("variant_key != ''").groupBy("lineage").agg(F.count("*").alias("n")).collect()}
    assert 30 < max(sizes.values()) <= P.LIMIT
    found = P.dictionary(spark, sf)[0].groupBy("lineage").agg(F.count_distinct("variant_no").alias("n")).collect()
    assert {r.lineage: r.n for r in found} == sizes
    assert P.t01_bootstrap_weights(spark, sf).select("replicate").distinct().count() == P.REPLICATES
