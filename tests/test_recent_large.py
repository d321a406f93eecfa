from genosieve.operators import trees as T


def test_tips_are_not_paired(spark):
    tips, branches = 100_000, 50  # 5e9 pairs of recent tips
    n = spark.range(branches + 1).selectExpr("0 as tree", "id as node_id", "if(id > 0, 0L, null) as parent_id", "if(id > 0, 1.0D, null) as length", "false as is_tip")
    t = spark.range(2 * tips).selectExpr("0 as tree", f"id + {branches + 1} as node_id", f"id % {branches} + 1 as parent_id", "2.0D as length", "true as is_tip")
    dates = t.selectExpr("tree", "node_id", f"if(node_id > {tips + branches}, date'2021-01-01', date'2020-01-01') as date")
    found = {r.bin: r.n for r in T.recent_distances(n.unionByName(t), dates, 0.4, 1.0).collect()}
    per = tips // branches
    assert found == {4: branches * per * (per - 1) // 2, 6: tips * (tips - per) // 2}
