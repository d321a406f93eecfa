"""Registered queries on the whole small tables against their contracts, by brute force over single documents."""

import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from genosieve.llm import licenses as L, queries, url_filter as U
from genosieve.llm.bpe import default_path
from genosieve.llm.align import piece_path
from tests.llm.test_packing_tokens import check_packing
from tests.llm.test_urls_licenses import RULES, brute, brute_licenses


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r.text or "" for r in documents.collect()}


@pytest.fixture(scope="module")
def tokens(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path())
    return {k: t.encode(x, add_special_tokens=False).ids for k, x in texts.items()}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op1(spark, sf, texts):
    found, seen = {r.doc_id: r for r in queries.op1_media(spark, sf).collect()}, {}
    for k, t in texts.items():
        data = t.encode()
        payload = data + bytes(-len(data) % 64 if data else 64)
        r = found[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_bytes >= r.payload_bytes and re.fullmatch("[0-9a-f]{64}", r.media_sha256)
        assert seen.setdefault(t, (r.media_bytes, r.media_sha256, r.feature)) == (r.media_bytes, r.media_sha256, r.feature)
    assert len(found) == len(texts)


def fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))))
    parts = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    if not parts:
        return 0
    bits = np.unpackbits(np.array([xxhash.xxh64_intdigest(p, seed=42) for p in parts], ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0)
    return int("".join("1" if 2 * b > len(parts) else "0" for b in bits), 2)


def test_op2(spark, sf, texts):
    own = {k: fingerprint(t) for k, t in texts.items()}
    root = {k: k for k in own}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(own, 2):
        if (own[a] ^ own[b]).bit_count() <= 2 and find(a) != find(b):
            root[max(find(a), find(b))] = min(find(a), find(b))
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op2_simhash(spark, sf).collect()} == {k: (f"{x:016x}", find(k)) for k, x in own.items()}


def test_op3(spark, sf, tokens):
    start, want = 0, {}
    for k in sorted(tokens):
        ids = [*tokens[k], 0]
        want[k] = (start, len(ids), crc(ids))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op3_tokens(spark, sf).collect()} == want


def test_op6(spark, sf, texts):
    import sentencepiece

    s = sentencepiece.SentencePieceProcessor(model_file=piece_path())
    want = {k: (len(ids := s.encode(t)), crc(ids), hashlib.sha256(s.decode(ids).encode()).hexdigest()) for k, t in texts.items()}
    assert {r.doc_id: (r.n_tokens, r.ids_crc32, r.text_sha256) for r in queries.op6_pieces(spark, sf).collect()} == want


def test_op8(spark, sf, odd, texts):
    assert sorted((r.doc_id, r.template) for r in queries.op8_licenses(spark, sf).collect()) == brute_licenses(list(texts.items()))
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    found = Counter((r.doc_id, r.template) for r in L.scan(odd, L.templates_table(spark)).collect())
    assert found == Counter((k, n) for k, t in rows for _, n in brute_licenses([(k, t)]))


def test_op9(spark, sf, documents):
    rows = queries.op9_packing(spark, sf).collect()
    check_packing(rows, [(r.doc_id, r.text) for r in documents.collect()])
    assert all(r.length > 0 for r in rows)


def test_op10(spark, sf, texts):
    rows = queries.op10_toxicity(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


def test_urls_of_many_parts(spark):
    """Thousands of slashes and dots: only as deep as the rules go, and nothing is lost."""
    urls = ["http://" + "a." * 4000 + "example.net/en/" + "x/" * 5000, "http://" + "/" * 9000, "http://" + "." * 9000 + "net/" + "/" * 9000, "http://org/fr/" + "/." * 5000, "http://" + "b." * 9000 + "org/fr"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    found = sorted(map(str, map(tuple, U.judge(df, U.rules_table(spark, tuple(RULES))).collect())))
    assert found == sorted(map(str, ((k, *brute(u, RULES)) for k, u in enumerate(urls))))
