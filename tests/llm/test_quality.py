import re
from collections import Counter

from hypothesis import given, settings, strategies as st

from genosieve.llm import quality as Q


def brute(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(windows)
    marked = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(8)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(marked)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c", "\n", " ", "#", "é!!", "\x1f", "\x85", "　"]), max_size=120))
def test_measures(parts):
    for text in ("".join(parts), " ".join(parts)):
        assert Q.measure(text)[:5] == brute(text)


def test_whole_table(documents):
    found = {r.doc_id: r for r in Q.apply_policy(Q.evaluate(documents)).collect()}
    for r in documents.collect():
        f, b = found[r.doc_id], brute(r.text)
        assert (f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words) == b
        assert f.base_failed == (b[0] < 20 or 100 * b[4] > 30 * b[0]) and (not f.kept or not f.base_failed)
    assert {r.doc_id for r in Q.keep(documents).collect()} == {i for i, f in found.items() if f.kept}


def test_clean_documents_stay(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    judged = Q.apply_policy(Q.evaluate(documents)).join(labels, "doc_id").where("not base_failed")
    assert judged.where("quality = 1 and not kept").count() <= 0.02 * judged.where("quality = 1").count()


def test_ablation_from_bits(documents):
    ledger = Q.evaluate(documents).persist()
    bits = [r.failure_bits for r in ledger.select("failure_bits").collect()]
    for r in Q.ablation(ledger).collect():
        b = Q.BITS[r.rule]
        assert r.failed == sum(bool(x & b) for x in bits) and r.failed_alone == sum(x == b for x in bits)


def test_odd_rows(odd, none):
    rows = Q.apply_policy(Q.evaluate(odd)).collect()
    assert len(rows) == odd.count() and all(r.base_failed and not r.kept for r in rows if r.n_words < 20)
    assert [r.n_words for r in rows if r.doc_id == 4] == [60_000]
    assert Q.evaluate(none).count() == 0 and Q.keep(none).count() == 0
    assert Q.keep(odd).columns == odd.columns
