import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st

from genosieve.llm import simhash as S
from genosieve.llm.components import components


def brute_print(text):
    words = [m.group() for m in re.finditer(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())]
    parts = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    """prints: list of (id, fp) -> id -> least id reachable."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(prints)):
        groups.setdefault(find(i), []).append(prints[i][0])
    least = {g: min((x for x in ids if x is not None), default=None) for g, ids in groups.items()}
    return [least[find(i)] for i in range(len(prints))]


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10**9), st.integers(2, 400), st.sampled_from([2, 5, 8]))
def test_index_finds_every_pair(seed, n, fanout):
    r = np.random.default_rng(seed)
    base = r.integers(0, 2**64, n, dtype=np.uint64)
    near = base[r.integers(0, n, n)] ^ (np.uint64(1) << r.integers(0, 64, n).astype(np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, n).astype(np.uint64))
    codes = np.unique(np.concatenate([base, near]))
    found = {(int(a), int(b)) for q, c in S.GrayIndex(codes, fanout).search(codes) for a, b in zip(q, c)}
    want = {(i, int(j)) for i in range(len(codes)) for j in np.flatnonzero(np.bitwise_count(codes ^ codes[i]) <= 2)}
    assert found == want


@pytest.mark.parametrize("block", [3, 40, 10_000])
def test_blocks_do_not_change_components(spark, block):
    r = np.random.default_rng(5)
    codes = r.integers(0, 2**64, 150, dtype=np.uint64)
    chain = [codes[0]]
    for _ in range(30):  # a chain of links longer than any distance
        chain.append(chain[-1] ^ (np.uint64(1) << np.uint64(r.integers(0, 64))))
    codes = np.unique(np.concatenate([codes, np.array(chain, np.uint64), codes[:50] ^ np.uint64(3)]))
    df = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "fp long")
    root = {r.node: r.root for r in components(S.link_forest(df, block=block)).collect()}
    want = brute_components([(i, int(c)) for i, c in enumerate(codes)])
    signed = codes.view(np.int64).tolist()
    groups, found = {}, {}
    for i, c in enumerate(signed):
        groups.setdefault(want[i], set()).add(c)
        found.setdefault(root.get(c, c), set()).add(c)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, found.values()))


def test_against_brute_force(documents):
    rows = documents.select("doc_id", "text").collect()
    found = {r.doc_id: (r.fp, r.component_id) for r in S.near_duplicates(documents, block=64).collect()}
    prints = [(r.doc_id, brute_print(r.text)) for r in rows]
    for (i, fp), c in zip(prints, brute_components(prints)):
        assert found[i] == (int(np.uint64(fp).astype(np.int64)), c)


def test_odd_rows(odd, none):
    rows = S.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add((r.fp, r.component_id))
    assert by[1] == by[7] and by[1].copy().pop()[1] == 1
    assert by[2] == by[3] == by[5] == {(0, 2)}  # no words
    assert S.near_duplicates(none).count() == 0
    kept = S.keep_first(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect() if r.doc_id) == sorted((r.doc_id, r.text) for r in odd.dropDuplicates(["doc_id"]).collect() if r.doc_id in (1, 2, 4, 6))
    assert [r.text for r in kept.where("doc_id is null").collect()] == ["no id here"]
    assert S.keep_first(none).count() == 0


def test_a_large_group_stays_linear():
    codes = np.unique(np.uint64(12345) ^ np.array([(1 << i) ^ (1 << j) for i in range(64) for j in range(64)], np.uint64))
    u, v = S.links_between(codes, None)
    assert len(u) == len(codes) - 1 and len(set(v.tolist())) == 1


def test_keep_first_on_repeated_ids(spark):
    """One id with two texts, and each text under more ids: what stays is held against a plain walk over the rows."""
    a, b, c = ("alpha beta gamma delta epsilon zeta eta theta", "one two three four five six seven eight nine", "rain on the plain stays in the lane today")
    cases = [[(1, a), (2, a), (2, b)], [(2, a), (2, b), (1, b)], [(5, a), (5, a), (5, b), (5, c), (4, c), (None, a)], [(None, a), (None, a), (3, b), (3, b), (3, b)], [(7, None), (7, ""), (8, None)]]
    for rows in cases:
        df = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(rows)], "doc_id long, text string, n int")
        groups = {}
        for k, t in rows:
            groups.setdefault(S.fingerprint(t), []).append((k, t))
        want = []
        for members in groups.values():
            named = [m for m in members if m[0] is not None]
            want.append(min((k, t or "") for k, t in named) if named else (None, members[0][1] or ""))
        got = [(r.doc_id, r.text or "") for r in S.keep_first(df).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_blocks_of_any_number_give_the_same_links(spark):
    import numpy as np

    r = np.random.default_rng(9)
    base = r.integers(0, 2**63, 60)
    fps = sorted({int(x) ^ (1 << int(i)) ^ (1 << int(j)) for x in base for i, j in r.integers(0, 63, (12, 2))})
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    roots = []
    for block in (8, 64, 1 << 16):
        found = {row.node: row.root for row in S.components(S.link_forest(df, 2, block)).collect()}
        roots.append(found)
    assert roots[0] == roots[1] == roots[2] and roots[0]
