import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from genosieve.llm import align as A, queries
from genosieve.llm.bpe import _alphabet, default_path


def tools():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(default_path())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=A.piece_path())


def tokens(a, b, text):
    """(ids, byte ends) of both over the whole text, from decoded bytes alone; None where they differ from space and text."""
    if not text:
        return None
    back = {c: i for i, c in _alphabet().items()}
    whole, out = (" " + text).encode(), []
    e = a.encode(" " + text, add_special_tokens=False)
    ids = b.encode(text)
    parts = [b.id_to_piece(i) for i in ids]
    for own, made in ((e.ids, [bytes(back[c] for c in t) for t in e.tokens]), (ids, [bytes.fromhex(p[3:5]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids, parts)])):
        if b"".join(made) != whole:
            return None
        ends, at = [], 0
        for m in made:
            at += len(m)
            ends.append(at)
        out.append((own, ends))
    return out


def brute(texts):
    a, b = tools()
    links, groups, sizes = [], [], []
    for text in texts:
        found = tokens(a, b, text)
        if found is None:
            links.append([]), groups.append(""), sizes.append((0, 0, 0))
            continue
        (ia, ea), (ib, eb) = found
        sa, sb = [0, *ea[:-1]], [0, *eb[:-1]]
        links.append([(ia[i], ib[j]) for i in range(len(ia)) for j in range(len(ib)) if sa[i] < eb[j] and sb[j] < ea[i]])
        stops = sorted(set(ea) & set(eb))
        parts, i, j = [], 0, 0
        for stop in stops:
            i2, j2 = ea.index(stop) + 1, eb.index(stop) + 1
            parts.append(",".join(map(str, ia[i:i2])) + "|" + ",".join(map(str, ib[j:j2])))
            i, j = i2, j2
        groups.append(";".join(parts))
        sizes.append((len(ia), len(ib), len(stops)))
    counts = Counter(x for own in links for x in own)
    top = Counter()
    for (x, y), n in counts.items():
        top[y] = max(top[y], n)
    return [
        (*s, len(own), sum(counts[x] == top[x[1]] for x in own), sum(counts[x] for x in own), hashlib.sha256(g.encode()).hexdigest() if own else "")
        for s, own, g in zip(sizes, links, groups)
    ]


def values(df):
    return Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


ALPHABET = ["a", "the ", " of", "é", "日本", "😀", "𓀀", " ", "  ", "\n", "\t", "\x1c", " ", "▁", "'s", "1984", "<|endoftext|>", "<s>", "<0x41>", "word", "́"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=30))
def test_chunks_equal_whole_texts(parts):
    text = "".join(parts)
    a, b = TOOLS
    at, ends, good = OWN.column(pa.array([text, None, text]))
    whole = tokens(a, b, text)
    assert good.tolist() == [whole is not None, False, whole is not None]
    if whole:
        found = OWN.chunks.take(at[: ends[0]])
        (ia, ea), (ib, eb) = whole
        assert found.n_a.sum() == len(ia) and found.n_b.sum() == len(ib) and at[ends[1] :].tolist() == at[: ends[0]].tolist()
        sa, sb = [0, *ea[:-1]], [0, *eb[:-1]]
        assert sorted(found.links.tolist()) == sorted(ia[i] << 32 | ib[j] for i in range(len(ia)) for j in range(len(ib)) if sa[i] < eb[j] and sb[j] < ea[i])


TOOLS, OWN = tools(), A.aligner(default_path(), A.piece_path())


def test_spans_are_refined():
    ends = lambda spans, sizes: A.byte_ends(*np.array(spans).T, np.array(sizes)).tolist()
    assert ends([(0, 2), (0, 2), (2, 5)], [1, 1, 3]) == [1, 2, 5]  # two tokens of one character
    assert ends([(1, 4), (4, 6)], [4, 2]) == [4, 6]  # a space trimmed from the span
    assert ends([(0, 1), (1, 1), (1, 1), (1, 5), (5, 6)], [1, 1, 2, 1, 1]) == [1, 2, 4, 5, 6]  # bytes of one character


def test_registered_query(spark, sf, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect() if len(r.text or "") < 3000]
    part = spark.createDataFrame(rows, documents.select("doc_id", "text").schema).repartition(3)
    want = Counter((k, *v) for (k, _), v in zip(rows, brute([t for _, t in rows])))
    assert values(A.align(part)) == want
    assert values(A.align(part, max_pairs=0)) == want  # the joined way
    whole = queries.op12_align(spark, sf)
    assert whole.columns[:8] == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert whole.count() == documents.count()


def test_memory_starts_afresh(monkeypatch):
    own = A.Aligner(default_path(), A.piece_path())
    monkeypatch.setattr(A, "MEMORY", 6000)
    monkeypatch.setattr(A, "JOINED_BYTES", 40)
    for i in range(60):
        text = pa.array([f"word{i} and other{i} words,\nand \u2581 " + "x" * i, f" two  spaces{i}\n", "ends here "])
        a, b = own.column(text), OWN.column(text)
        assert a[1].tolist() == b[1].tolist() and a[2].tolist() == b[2].tolist() == [False, True, True]
        assert own.chunks.groups.take(pa.array(a[0])).to_pylist() == OWN.chunks.groups.take(pa.array(b[0])).to_pylist()
    assert len(own.known) < 100


def test_odd_rows(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    short = [x for x in rows if x[0] != 4]
    found = A.align(odd, with_groups=True)
    a, b = tools()
    long = tokens(a, b, next(t for k, t in rows if k == 4))
    r = [r for r in found.collect() if r.doc_id == 4]
    assert len(r) == 1 and (r[0].n_a, r[0].n_b) == (len(long[0][0]), len(long[1][0])) and r[0].groups.count(";") + 1 == r[0].n_groups
    assert values(A.align(odd.where("doc_id is null or doc_id <> 4"))) == Counter((k, *v) for (k, _), v in zip(short, brute([t for _, t in short])))
    assert values(A.align(odd, max_pairs=0)) == values(found.drop("groups"))
    assert A.align(none).count() == 0
