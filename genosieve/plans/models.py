"""Queries over classification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from genosieve.operators import models as C
from genosieve.plans import mapping as M
from genosieve.plans.registry import register

_SITES = (0, 2, 5)


@register("with s as (select doc_id, translate(text, 'acgtn', 'ACGTN') as t from documents), b as (select doc_id, unnest([0, 1, 2]) as k, unnest([substr(t, 1, 1), substr(t, 3, 1), substr(t, 6, 1)]) as b from s) select doc_id, sum(case when b in ('A', 'C', 'G', 'T', '-') then 1 else 0 end) as known, sum(case when b = 'T' then 1 else 0 end) as n_t, count(*) as n_sites from b group by doc_id")
def m01_site_features(spark: SparkSession, sf: str) -> DataFrame:
    d = C.site_features(M.table(spark, sf, "documents").select("doc_id", F.translate("text", "acgtn", "ACGTN").alias("s")), "s", list(_SITES))

    def total(*positions: int):
        return sum((F.col("onehot")[6 * s + p] for s in range(len(_SITES)) for p in positions), F.lit(0.0)).cast("long")

    return d.select("doc_id", total(0, 1, 2, 3, 5).alias("known"), total(3).alias("n_t"), total(0, 1, 2, 3, 4, 5).alias("n_sites"))


@register()
def m02_classify(spark: SparkSession, sf: str) -> DataFrame:
    """A tree on vectors, trained on the designated (even) ones, scores all."""
    e = M.table(spark, sf, "embeddings")
    return C.classify(e, C.train(e.where("vec_id % 2 = 0"), "embedding", "label"), "embedding", "vec_id")
