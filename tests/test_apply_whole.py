import re

from genosieve.plans import registry


def test_every_document_whole(spark, tmp_path):
    texts = {1: "ab, c" * 100, 2: "short", 3: None, 4: "", 5: "acgt" * 10}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r.seq for r in registry.queries()["x03_apply_features"](spark, str(tmp_path)).collect()}

    def want(text):
        ref = None if text is None else re.sub("[^A-Za-z]", "", text).upper()
        p = len(ref or "") // 40
        return ref if not p else "N" * 3 * p + ref[3 * p : 5 * p] + "T" + ref[5 * p + 1 : 10 * p] + "-" * 3 * p + ref[13 * p :]

    assert found == {k: want(t) for k, t in texts.items()}
