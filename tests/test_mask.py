"""Masked features against brute force."""

import random

from genosieve.operators import qc


def test_masked_features_are_found_by_base(spark):
    r = random.Random(4)
    pick = lambda *x: r.choice(x)
    features = sorted({(r.randrange(40), pick("~", "-", "+", None), pick(1, 2, 3, 4, None), pick("A", "C", "AC", "N", "GN", "", None)) for _ in range(600)}, key=str)
    mask = [(pick(1, 2, 3, None), pick("AC", "CA", "G", "", None)) for _ in range(12)] * 50
    df = spark.createDataFrame(features, "accession long, typ string, pos int, alt string").repartition(3)
    out = qc.mask_features(df, spark.createDataFrame(mask, "pos int, alt string"))
    hit = lambda typ, pos, alt: typ == "~" and any(None not in (p, t, alt) and p == pos and alt in t for p, t in mask)
    stays = lambda typ, alt: typ == "-" or alt is not None and "N" not in alt  # noqa: E731  # null conditions drop a row
    assert sorted(map(tuple, out.collect()), key=str) == [x for x in features if not hit(*x[1:]) and stays(x[1], x[3])]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    join = next(x for x in plan.splitlines() if "LeftAnti" in x)
    assert "alt" in join.split("=", 1)[1] and "Contains" not in join  # bases are equal there; texts are not searched for every feature
