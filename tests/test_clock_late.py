import math
from datetime import date, timedelta

from genosieve.operators import qc


def limits(mean, cutoff=0.005):
    """(qmin, qmax) by a plain sum over the counts."""
    cdf, low, high = 0.0, 0, 0
    for k in range(1000):
        cdf += math.exp(k * math.log(mean) - mean - math.lgamma(k + 1))
        low, high = low + (cdf <= cutoff), high + (cdf <= 1 - cutoff)
    return low, high


def found(spark, **more):
    days = (10, 1000, 1170, 1500, 2500)
    df = spark.createDataFrame([(110, date(2019, 12, 1) + timedelta(d)) for d in days], "n_features int, coldate date")
    return {r.day: (r.qmin, r.qmax, r.outlier) for r in qc.clock_outliers(df, 0.0655, 0.005, **more).collect()}


def test_limits_grow_beyond_a_hundred(spark):
    for day, (qmin, qmax, outlier) in found(spark, maxtime=None).items():
        assert (qmin, qmax) == limits(day * 0.0655) and outlier == (not qmin < 110 <= qmax)


def test_limits_stay_after_the_last_day(spark):
    by = found(spark)
    assert by[10][:2] == limits(0.655) and all(by[d][:2] == limits(65.5) for d in (1000, 1170, 1500, 2500))
