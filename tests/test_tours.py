"""Linear tree operators against walks over small trees, and their rows on deep ones."""

import random

import pytest
from pyspark.sql import functions as F

from genosieve.operators import tours, trees as T
from genosieve.sources import shared

SCHEMA = "tree string, node_id long, parent_id long, name string, length double, is_tip boolean"


def random_forest(seed, trees=25):
    """Trees of every shape: combs, stars, single nodes, chains of single children, two roots; ids in no order."""
    r, rows = random.Random(seed), []
    for t in range(trees):
        n = r.randint(1, 24)
        ids = r.sample(range(100), n)
        parents = [None]
        for k in range(1, n):
            shape = t % 5
            parents.append(ids[k - 1] if shape == 0 else ids[0] if shape == 1 else None if shape == 2 and k == n // 2 else ids[r.randrange(k)])
        kids = {p for p in parents if p is not None}
        rows += [(f"t{t}", i, p, f"n{i}" if i not in kids else None, None if p is None else r.randint(0, 8) / 4, i not in kids) for i, p in zip(ids, parents)]
    return rows


def by_tree(rows):
    out = {}
    for t, i, p, *_ in rows:
        out.setdefault(t, {})[i] = p
    return out


def above(parent, i):
    out = []
    while parent[i] is not None:
        i = parent[i]
        out.append(i)
    return out


@pytest.fixture(scope="module")
def forest(spark):
    rows = random_forest(4)
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_up(forest):
    rows, df = forest
    length, parent = {(t, i): x or 0.0 for t, i, _, _, x, _ in rows}, by_tree(rows)
    for stays, own in ((F.col("node_id") % 3 == 0, lambda i: i % 3 == 0), (F.lit(False), lambda i: False)):
        found = {(r.tree, r.node_id): (r.anc, r.hops, r.dist) for r in tours.up(df, stays).collect()}
        assert set(found) == {(t, i) for t, i, p, *_ in rows if p is not None}
        for (t, i), (anc, hops, dist) in found.items():
            path = above(parent[t], i)
            k = next((k for k, a in enumerate(path) if own(a)), None)
            assert anc == (None if k is None else path[k])
            passed = [i, *path][: len(path) if k is None else k + 1]
            assert hops == len(passed) and dist == sum(length[t, x] for x in passed)


def test_tour(forest):
    rows, df = forest
    parent = by_tree(rows)
    found = {(r.tree, r.node_id): r for r in tours.tour(df, sums={"v": F.col("node_id")}, xors={"x": F.col("node_id")}).collect()}
    assert len(found) == len(rows)
    for t, own in parent.items():
        order, kids = [], {}
        for i in sorted(own):
            kids.setdefault(own[i], []).append(i)

        def walk(i):
            order.append(i)
            for k in kids.get(i, []):
                walk(k)

        for root in kids[None]:
            walk(root)
        for k, i in enumerate(order):
            r = found[t, i]
            below = [j for j in own if j == i or i in above(own, j)]
            x = 0
            for j in below:
                x ^= j
            assert (r.pre, r.size, r.depth, r.v, r.before_v, r.x) == (k, len(below), len(above(own, i)), sum(below), sum(order[:k]), x)


def test_mean_of_children(forest):
    rows, df = forest
    for t, own in by_tree(rows).items():
        kids = {}
        for i, p in own.items():
            kids.setdefault(p, []).append(i)
        mean = lambda i: sum(map(mean, kids[i])) / len(kids[i]) if i in kids else float(i)  # noqa: E731, B023
        found = {r.node_id: r.y for r in tours.mean_of_children(df.where(F.col("tree") == t), F.col("node_id")).collect()} if t in ("t0", "t1", "t2", "t3", "t9") else None
        assert found is None or found == pytest.approx({i: mean(i) for i in own})


def test_clades_and_signatures(forest):
    rows, df = forest
    parent = by_tree(rows)
    name = {(t, i): n for t, i, _, n, _, _ in rows}
    want = {}
    for t, own in parent.items():
        for i in own:
            if name[t, i] is None:
                want[t, i] = sorted(name[t, j] for j in own if name[t, j] and i in above(own, j))
    assert {(r.tree, r.node_id): r.tips for r in T.clades(df).collect()} == want
    sets = {}
    for r in T.clade_signatures(df).collect():
        if (r.tree, r.node_id) in want:
            sets.setdefault((r.sig1, r.sig2, r.n_tips), set()).add(tuple(want[r.tree, r.node_id]))
    assert all(len(x) == 1 for x in sets.values()) and len(sets) == len({tuple(x) for x in want.values()})


def test_rows_stay_linear_on_a_comb(spark, monkeypatch):
    """At most two rows a node in every round, on a comb of 100,000 nodes."""
    depth, sizes, own = 50_000, [], shared.cut

    def counted(df):
        out = own(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(shared, "cut", counted)
    inner = spark.range(depth).selectExpr("'c' as tree", "id as node_id", "if(id > 0, id - 1, null) as parent_id", "cast(null as string) as name", "1.0D as length", "false as is_tip")
    tips = spark.range(depth).selectExpr("'c' as tree", f"id + {depth} as node_id", "id as parent_id", "concat('t', id) as name", "2.0D as length", "true as is_tip")
    comb = inner.unionByName(tips)
    t = tours.tour(comb, sums={"tips": F.col("is_tip").cast("int")})

    got = t.where("node_id in (0, 7, 49999, 50000, 99999)").collect()
    assert {r.node_id: (r.pre, r.size, r.depth, r.tips) for r in got} == {0: (0, 2 * depth, 0, depth), 7: (7, 2 * (depth - 7), 7, depth - 7), 49_999: (49_999, 2, 49_999, 1), 50_000: (2 * depth - 1, 1, 1, 1), 99_999: (50_000, 1, 50_000, 1)}
    far = tours.levels(comb).where("node_id in (0, 99999)").collect()
    assert {(r.node_id, r.depth, r.x) for r in far} == {(0, 0, 0.0), (99_999, 50_000, 50_001.0)}
    y = tours.mean_of_children(comb, F.lit(3.0))
    assert y.where("abs(y - 3) > 1e-9").count() == 0
    assert max(sizes) <= 2 * 2 * depth and len(sizes) < 80


def test_a_cycle_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(tours, "ROUNDS", 4)
    df = spark.createDataFrame([("t", 1, 2, None, 1.0, False), ("t", 2, 1, None, 1.0, False), ("t", 3, 1, "a", 1.0, True)], SCHEMA)
    with pytest.raises(ValueError, match="cycle"):
        tours.up(df)
