import hashlib
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings, strategies as st

from genosieve.llm import fim as M, queries
from tests import oracle
from tests.conftest import SF

TEXT = st.lists(st.sampled_from(["a", "é", "日", "😀", "\n", "\r", "line ", "\x85", " "]), max_size=40).map("".join)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_exception_index(text):
    data = np.frombuffer(text.encode(), np.uint8)
    index = M.ExceptionIndex(data)
    chars = np.arange(len(text) + 1)
    places = np.array([len(text[:i].encode()) for i in chars])
    assert (index.to_bytes(chars) == places).all() and (index.to_chars(places) == chars).all()
    assert len(index.byte) == sum(ord(c) > 127 for c in text)


@settings(max_examples=300, deadline=None)
@given(TEXT, st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1), st.sampled_from(["line", "char"]))
def test_cuts(text, h1, h2, unit):
    units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
    n, (a, b), (ca, cb) = M.cut(np.frombuffer(text.encode(), np.uint8), h1, h2, unit)
    i, j = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    assert n == len(units) and text.encode()[:a].decode() == "".join(units[:i]) == text[:ca]
    assert text.encode()[a:b].decode() == "".join(units[i:j]) == text[ca:cb]


def brute(key, text, rate=100, spm=50):
    t = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", t)
    h = hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(lines) + 1), h2 % (len(lines) + 1)))
    if not t or any(m in t for m in M.MARKS) or h3 % 100 >= rate:
        return key, len(lines), "plain", None, None, t
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    return (key, len(lines), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < spm else (key, len(lines), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_registered_query(spark, sf, documents):
    oracle.check(queries.op11_fim(spark, sf), oracle.connect(SF), queries.oracle_sql()["op11_fim"])
    assert rows(M.transform(documents)) == Counter(brute(r.doc_id, r.text) for r in documents.collect())
    part = M.transform(documents, rate=60, spm_rate=20)
    assert rows(part) == Counter(brute(r.doc_id, r.text, 60, 20) for r in documents.collect())


def test_restored(spark):
    texts = ["<P", "<<", "a<S", "<P>x", "x<M>", "ab\ncd\n", "<\nS>\n<P\n>", "P>\nS>\nM>\n", "\n" * 50, None, ""]
    df = spark.createDataFrame([(i, t) for i in range(40) for t in texts], "doc_id long, text string")
    for unit in ("line", "char"):
        back = M.transform(df, unit=unit).select("doc_id", M.restored().alias("text"))
        assert rows(back) == rows(df.na.fill("", ["text"]))
    forms = {r.form for r in M.transform(df).collect()}
    assert forms == {"plain", "psm", "spm"}


def test_odd_rows(odd, none):
    assert rows(M.transform(odd)) == Counter(brute(r.doc_id, r.text) for r in odd.collect())
    assert M.transform(none).count() == 0
    clash = odd.withColumnRenamed("fp", "form").withColumnRenamed("component_id", "output")
    assert rows(M.transform(clash)) == rows(M.transform(odd))
