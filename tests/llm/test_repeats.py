import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st

from genosieve.llm import induced, queries, repeats as R


def brute(texts, length):
    """(bytes, removed, runs, what is left) of every text, by counting every window."""
    data = [(t or "").encode() for t in texts]
    digests = [[xxhash.xxh3_128_digest(d[i : i + length]) for i in range(len(d) - length + 1)] for d in data]
    seen = Counter(x for own in digests for x in own)
    out = []
    for d, own in zip(data, digests):
        gone = np.zeros(len(d), bool)
        for i, x in enumerate(own):
            if seen[x] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(d, np.uint8)[~gone])
        out.append((len(d), int(gone.sum()), int(np.sum(gone & ~np.concatenate([[False], gone[:-1]]))) if len(d) else 0, kept))
    return out


def rows(df):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in df.collect())


def want(pairs, length):
    return Counter((k, *v) for (k, _), v in zip(pairs, brute([t for _, t in pairs], length)))


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=80), st.integers(1, 4), st.sampled_from([1, 2, 5]), st.booleans())
def test_induced_order(data, times, length, coarse):
    data = bytes(x % 4 for x in data) if coarse else data
    data = data * times
    x = np.frombuffer(data, np.uint8)
    order = sorted(range(len(data)), key=lambda i: data[i:])
    names = np.unique(x, return_inverse=True)[1].astype(np.int32)
    known, induced.RANGE = induced.RANGE, 5
    try:
        assert induced.suffix_order(x, 256).tolist() == order
        assert induced.suffix_order(names, int(names.max()) + 1).tolist() == order
        seen = Counter(data[i : i + length] for i in range(len(data) - length + 1))
        assert induced.repeated(x, length).tolist() == [i + length <= len(data) and seen[data[i : i + length]] > 1 for i in range(len(data))]
    finally:
        induced.RANGE = known


def test_queues_on_disk(tmp_path, documents):
    """The same marks with blocks of the queue on disk, and the files go."""
    text = "\n".join(r.text or "" for r in documents.limit(60).collect()).encode()
    x = np.frombuffer(text * 2, np.uint8)
    stored = induced.repeated(x, 400, {"folder": f"file://{tmp_path}", "limit": 10_000})
    assert (stored == induced.repeated(x, 400)).all() and stored[: len(text) - 400].all()
    assert not list(tmp_path.iterdir())
    q = induced.Queue(f"file://{tmp_path}", 100)
    for i in range(50):
        q.push(i % 2, np.arange(i, i + 5, dtype=induced.INDEX), np.full(5, i, np.uint16))
    assert q.files and q.pop(1)[0].tolist() == [x for i in range(1, 50, 2) for x in range(i, i + 5)]
    q.close()
    assert not list(tmp_path.iterdir())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"ab", b"abc", b"xyzzy", b"\x00", b"lorem ipsum "]), min_size=4, max_size=60))
def test_contexts_hold_every_window_once(parts):
    text = b"".join(parts)
    c = R.contexts([7], [text], 12, 4)
    starts = [s + i for s, w, t in zip(c["start"], c["windows"], c["times"]) for i in range(w * t)] if c else []
    assert starts == list(range(max(len(text) - 11, 0)))
    by_window = {}
    for s, w, t, q, a in zip(*(c[k] for k in ("start", "windows", "times", "anchor", "a"))) if c else ():
        for k in range(t):
            for i in range(w):  # equal windows have equal anchors at equal places
                at = s + k * w + i
                assert by_window.setdefault(text[at : at + 12], (a, q - i)) == (a, q - i)


def test_chunks_do_not_matter(monkeypatch):
    rng = random.Random(3)
    text = bytes(rng.choice(b"abcd") for _ in range(3000)) * 2
    whole = R.choices(np.frombuffer(text, np.uint8), 40, 8)[0]
    monkeypatch.setattr(R, "CHUNK", 257)
    c = R.contexts([1], [text], 40, 8)
    for s, w, t, q in zip(c["start"], c["windows"], c["times"], c["anchor"]):
        assert all(whole[s + k * w + i] == s + k * w + q for k in range(t) for i in range(w))


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = [bytes(rng.choice(b"abcdefgh ") for _ in range(rng.randint(2, 9))).decode() for _ in range(60)]
    passage = [" ".join(rng.choice(words) for _ in range(12)) for _ in range(4)]
    out = [None, "", "x", "é" * 90, "ab" * 100]
    for _ in range(n):
        t = " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))
        for _ in range(rng.randint(0, 2)):
            p, at = rng.choice(passage), rng.randint(0, len(t))
            t = t[:at] + p[rng.randint(0, 5) :] + t[at:]
        out.append(rng.choice(["", "ü"]) + t if rng.random() < 0.9 else out[-1])
    return out


@pytest.mark.parametrize("shard_bytes", [R.SHARD_BYTES, 600])
def test_small_corpus(spark, shard_bytes):
    """Also with anchors that are too frequent for a shard, and queues on disk."""
    pairs = list(enumerate(corpus(shard_bytes)))
    df = spark.createDataFrame(pairs, "doc_id long, text string").repartition(5)
    found = rows(R.remove(df, 40, 6, shard_bytes, 2000))
    expected = want(pairs, 40)
    assert found == expected and sum(r[2] for r in expected) > 1000 and any(r[3] > 1 for r in expected)


def test_registered_query(spark, sf, documents):
    pairs = [(r.doc_id, r.text) for r in documents.collect()]
    assert rows(R.remove(documents)) == want(pairs, 400)
    found = queries.op13_repeats(spark, sf)
    assert found.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] and found.count() == len(pairs)


@pytest.mark.parametrize("n_bytes", [394, 399, 400])
def test_shared_passages_go_from_400_bytes_on(spark, n_bytes):
    """The limit is in bytes: a passage of over 50 words that documents share is left as long as it has fewer."""
    rng = random.Random(n_bytes)
    passage = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60))[:n_bytes]
    pairs = [(i, f"{i}{passage}{i}") for i in range(3)]
    found = rows(R.remove(spark.createDataFrame(pairs, "doc_id long, text string").repartition(3)))
    assert len(passage) == n_bytes and len(passage.split()) > 50 and found == want(pairs, 400)
    assert {r[2] for r in found} == {n_bytes if n_bytes >= 400 else 0}


def test_odd_rows(odd, none):
    pairs = [(r.doc_id, r.text) for r in odd.collect()]
    assert rows(R.remove(odd)) == want(pairs, 400)
    assert rows(R.remove(odd, 30, 8)) == want(pairs, 30)
    assert R.remove(none).count() == 0
    clash = odd.withColumnRenamed("fp", "row").withColumnRenamed("component_id", "data")
    assert rows(R.remove(clash)) == rows(R.remove(odd))
