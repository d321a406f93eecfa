import random

import corpus_pipeline as C
from genosieve.llm import quality, queries, simhash, toxicity
from tests import oracle
from tests.llm.test_packing_tokens import check_packing


def test_stages(spark, documents, sf):
    docs, names = documents, documents.columns
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = {r.doc_id for r in quality.apply_policy(quality.evaluate(docs)).where("kept").collect()}
    after = C.STAGES[0][1](spark, docs, sf)
    assert after.columns == names and {r.doc_id for r in after.collect()} == kept
    bad = {r.doc_id for r in toxicity.score(after, toxicity.train(after, labels)).where("predicted = 1").collect()}
    after2 = C.STAGES[1][1](spark, after, sf)
    assert after2.columns == names and {r.doc_id for r in after2.collect()} == kept - bad
    heads = {r.component_id for r in simhash.near_duplicates(after2).collect()}
    after3 = C.STAGES[2][1](spark, after2, sf)
    assert after3.columns == names and {r.doc_id for r in after3.collect()} == heads
    rows = C.run(spark, sf).collect()
    check_packing(rows, [(r.doc_id, r.text) for r in after3.collect()])


def test_registered():
    names = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names if n != "pipeline") == list(range(1, 14)) and "pipeline" in names


def test_sql(spark, sf):
    con = oracle.connect(sf)
    for name, sql in queries.oracle_sql().items():
        oracle.check(queries.queries()[name](spark, sf), con, sql)


def _prose(seed, n):
    words = "river stone garden winter letter morning village window teacher market ocean forest kitchen summer bridge".split()
    r = random.Random(seed)
    return " ".join(r.choice(words) for _ in range(n))


def _sf(spark, rows, labels, folder):
    """A folder with these documents, whose extra columns bear names of the operators' own, and these labels."""
    own = ["fp", "root", "score", "t", "#ledger", "#id", "#own", "#rows", "#row", "#root", "component_id"]
    docs = spark.createDataFrame([(i, t, *[k] * len(own)) for k, (i, t) in enumerate(rows)], "doc_id long, text string, " + ", ".join(f"`{c}` int" for c in own))
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, one id with two texts, rows without an id, clashing names."""
    a, b, c, d, long = _prose(1, 60), _prose(2, 60), _prose(3, 60), _prose(4, 60), _prose(5, 40_000)
    rows = [(1, a), (1, a), (2, a), (2, b), (3, None), (4, ""), (None, None), (None, c), (None, c), (6, c), (None, a), (None, d), (None, d), (5, long), (5, long)]
    sf = _sf(spark, rows, [(None, 1), (1, None), (1, 0), (99, 1)], tmp_path)
    docs, want = spark.read.parquet(f"{sf}/documents.parquet"), [(1, a), (2, b), (5, long), (6, c), (None, d)]
    names = docs.columns
    for _, stage in C.STAGES[:3]:
        docs = stage(spark, docs, sf)
        assert docs.columns == names
    assert sorted(((r.doc_id, r.text) for r in docs.collect()), key=str) == sorted(want, key=str)
    found = C.run(spark, sf).collect()
    assert {r.doc_id for r in found} == {i for i, _ in want}
    check_packing(found, want)


def test_empty_table(spark, tmp_path):
    found = C.run(spark, _sf(spark, [], [], tmp_path))
    assert found.columns[0] == "doc_id" and found.count() == 0
