import random
from datetime import date, timedelta

from genosieve.operators import aggregates as A
from genosieve.sources import io


def test_a_hot_key_is_folded_as_a_stream(spark):
    r = random.Random(3)
    rows = [(1 if i % 9 else i % 5, i, date(2024, 1, 1) + timedelta(i // 700 + r.randrange(3)), r.choice([None, r.random(), r.random()]), r.choice("ab")) for i in range(9000)]
    rows += [(7, 1, date(2024, 1, 1), 0.5, "a"), (7, 2, date(2024, 1, 2), float("nan"), "b"), (7, 3, date(2024, 1, 3), float("nan"), "c"), (8, 1, None, None, None), (8, 2, date(2024, 1, 1), 1.0, "x")]
    log = spark.createDataFrame(rows, "accession long, entry_id long, version date, probability double, lineage string").repartition(5)
    held = {}
    for key, *x in sorted(rows, key=lambda x: x[:2]):
        h = held.setdefault(key, x)
        if None not in (x[1], x[2], h[1], h[2]) and x[1] >= h[1] and (x[2] > h[2] or x[2] != x[2] and h[2] == h[2]):
            held[key] = x
    df = A.latest_assignment(log)
    assert "collect_list" not in df._jdf.queryExecution().toString()
    assert {r.accession: str(list(r)[1:]) for r in df.collect()} == {k: str(x) for k, x in held.items()}
    assert A.latest_assignment(log.where("false")).count() == 0


def test_no_line_grows_with_a_cluster(spark, tmp_path):
    samples = spark.range(5000).selectExpr("if(id % 10 = 0, 'B', 'A') as lineage", "'v' as variant", "'2024-01-01' as coldate", "cast(id as string) as accession", "'x' as location", "'n' as name")
    edges = spark.range(600).selectExpr("if(id = 0, 'C', 'A') as lineage", "cast(id as int) as pos", "'v' as parent", "'w' as child", "1.0D as dist", "0.5D as support")
    path = f"{tmp_path}/clusters"
    io.write_clusters(samples, edges, path)
    assert spark.read.text(path).selectExpr("max(length(value))").first()[0] < 300
    n, e = io.read_clusters(spark, path)
    assert sorted(map(tuple, n.collect())) == sorted(map(tuple, samples.collect()))
    assert sorted(map(tuple, e.collect())) == sorted(map(tuple, edges.where("lineage = 'A'").collect()))
