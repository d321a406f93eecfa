"""Merged states against a full recomputation over random increments."""

import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from genosieve.operators import aggregates as A
from genosieve.streaming import states as N

SAMPLES = "accession long, lineage string, coldate date, n_features long, variant_key string, name string, location string, region string, country string"
FEATURES = "accession long, typ string, pos int, alt string"


def world(r, n):
    features = {k: sorted({("~", r.randint(0, 5), r.choice("AC")) for _ in range(r.randint(0, 4))}) for k in range(n)}
    samples = {k: (k, r.choice(["A", "B", "C"]), date(2024, 1, 1) + timedelta(r.randint(0, 9)), len(features[k]), ",".join(map(str, features[k])), f"n{k}", r.choice("xyz"), r.choice("pq"), r.choice("uvw")) for k in range(n)}
    return samples, features


def frames(spark, rows, features):
    return spark.createDataFrame(rows, SAMPLES), spark.createDataFrame([(x[0], *f) for x in rows for f in features[x[0]]], FEATURES)


def test_random_increments_equal_recomputation(spark, tmp_path):
    r, path = random.Random(5), f"file://{tmp_path}/states"
    samples, features = world(r, 60)
    held = {}
    name = F.concat("typ", "pos", "alt")
    for batch in range(4):
        come = [samples[k] for k in range(15 * batch, 15 * batch + 15)]
        go = [held[k] for k in r.sample(sorted(held), min(len(held), 6))]
        moved = [(x[0], r.choice(["A", "B", "D"]), *x[2:]) for x in go[:4]]  # two leave, four move
        for _ in range(r.choice([1, 2])):  # a batch that runs again
            N.add(path, f"b{batch}", frames(spark, come + moved, features), frames(spark, go, features) if go else None, buckets=8)
        held = {k: x for k, x in held.items() if k not in {x[0] for x in go}} | {x[0]: x for x in come + moved}
    N.compact(spark, path, f"{path}-next", buckets=8)
    s, f = frames(spark, list(held.values()), features)
    rows = lambda df: sorted(str(sorted(x.asDict().items())) for x in df.select(*(F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes)).collect())
    want = A.lineage_stats(s, A.lineage_mutations(A.common_features(s, f, min_freq=0.3), name))
    for p in (path, f"{path}-next"):
        assert rows(N.stats(spark, p, name, 0.3, buckets=8)) == rows(want)
        assert rows(N.frequencies(spark, p, buckets=8)) == rows(A.feature_frequencies(s, f))
        assert rows(N.points(spark, p, buckets=8)) == rows(A.points(s))
        assert rows(N.global_stats(spark, p)) == rows(A.global_stats(s))
    one = spark.createDataFrame([("A",)], "lineage string")
    assert rows(N.stats(spark, path, name, 0.3, one, buckets=8)) == rows(want.where("lineage = 'A'"))


def test_other_groups_are_not_read(spark, tmp_path):
    path = f"file://{tmp_path}/states"
    samples, features = world(random.Random(6), 40)
    N.add(path, "a", frames(spark, list(samples.values()), features), buckets=16)
    one = N.totals(spark, path, "features", spark.createDataFrame([("A",)], "lineage string"), buckets=16)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "_bucket" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert {x.lineage for x in one.collect()} == {"A"}
