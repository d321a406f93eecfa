import base64
import hashlib
import random

import pytest

from genosieve.llm import warc as W

ROWS = [(1, "http://b.example.com/x", "<p>one</p>"), (2, "http://a.example.com/", "<p>one</p>"), (3, None, None), (4, "http://a.example.com/?q= a\nb", ""), (5, "http://a.example.com/", "é" * 50_000), (None, "http://c.org/", "<p>one</p>"), (6, "x", "only once"), (2, "http://a.example.com/", "<p>one</p>"), (7, "http://a.example.com/", "tie"), (7, "http://a.example.com/", "tie")]


def expected(rows):
    top = {}
    for p, _, h in rows:
        top[h or ""] = max((x for x in (top.get(h or ""), p) if x is not None), default=None)
    out, used = [], set()
    for p, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (h or "").encode()
        digest = base64.b32encode(hashlib.sha1(b).digest()).decode()
        first = p == top[h or ""] and digest not in used
        used |= {digest} if first else set()
        out.append((p, len(b), digest, "response" if first else "revisit", None if first else top[h or ""]))
    return sorted(out, key=str)


@pytest.mark.parametrize("entries, fan_in, span", [(100, 64, 100), (2, 2, 3), (1, 2, 1)])
def test_round_trip_and_order(spark, monkeypatch, entries, fan_in, span):
    monkeypatch.setattr(W, "RUN_ENTRIES", entries)
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string").repartition(3)
    index = W.index(W.write(W.captures(df)), fan_in, span).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in index), key=str) == expected(ROWS)
    keys = [W._key(tuple(r)) for r in index]
    assert keys == sorted(keys)
    assert len({(r.archive, r.offset) for r in index}) == len(ROWS)


def test_small_payloads_may_stay_responses(spark):
    df = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "long enough"), (4, "u", "long enough")], "page_id long, url string, html string")
    kinds = {r.page_id: r.record_type for r in W.index(W.write(W.captures(df, min_payload=5))).collect()}
    assert kinds == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert W.index(W.write(W.captures(df))).count() == 0


def test_loser_tree():
    r = random.Random(4)
    for _ in range(200):
        runs = [sorted(((str(r.randint(0, 9)), "1", r.choice([None, 1, 2]), "a", r.randint(0, 9)) for _ in range(r.randint(0, 12))), key=W._key) for _ in range(r.randint(0, 9))]
        assert [W._key(x) for x in W.LoserTree([iter(x) for x in runs])] == sorted(W._key(x) for x in sum(runs, []))


def test_damage_is_found(tmp_path):
    good = W.to_record(1, "http://a/", "payload", hashlib.sha1(b"payload").hexdigest(), 7, "response", None)
    import gzip
    import io

    assert next(W.entries(io.BytesIO(gzip.compress(good)), "x"))[2] == 1
    with pytest.raises(ValueError):
        next(W.entries(io.BytesIO(gzip.compress(good.replace(b"payload\r\n", b"pAyload\r\n"))), "x"))
    with pytest.raises(ValueError):
        list(W.entries(io.BytesIO(gzip.compress(good)[:-9]), "x"))


def test_whole_merges_come_before_ranges(spark, monkeypatch):
    monkeypatch.setattr(W, "WHOLE_TASKS", 2)
    monkeypatch.setattr(W, "RUN_ENTRIES", 3)
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string").repartition(4)
    rows = W.index(W.write(W.captures(df)), 2, 4).collect()
    keys = [W._key(tuple(r)) for r in rows]
    assert keys == sorted(keys) and len({(r.archive, r.offset) for r in rows}) == len(ROWS)


def test_odd_rows_and_clashing_names(spark, odd):
    pages = odd.withColumnsRenamed({"doc_id": "page_id", "text": "html", "fp": "url", "component_id": "sha1", "#ledger": "payload"})
    rows = W.index(W.write(W.captures(pages))).collect()
    assert len(rows) == 10 and sum(r.record_type == "response" for r in rows) == len({r.html or "" for r in pages.collect()})
