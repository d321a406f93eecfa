"""The chain from variants to bead plots, and single operators of it, against brute force."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from genosieve.functions import expressions as X
from genosieve.operators import chain as H, joining as N, joins as J, trees as T
from genosieve.plans import beads as B, trees as P


def random_tree(r, n):
    """(nodes, path distances between tips) of a random binary tree with tips 0 … n-1."""
    roots, rows, new = list(range(n)), {}, n
    while len(roots) > 1:
        a, b = r.sample(roots, 2)
        roots = [x for x in roots if x not in (a, b)] + [new]
        rows[a], rows[b] = (new, r.randint(1, 9) / 2), (new, r.randint(1, 9) / 2)
        new += 1

    def up(x):
        out = {x: 0.0}
        d = 0.0
        while x in rows:
            x, d = rows[x][0], d + rows[x][1]
            out[x] = d
        return out

    ups = [up(i) for i in range(n)]
    d = np.zeros((n, n))
    for i, j in itertools.combinations(range(n), 2):
        d[i, j] = d[j, i] = min(ups[i][a] + ups[j][a] for a in ups[i] if a in ups[j])
    return rows, d


def path_distances(rows):
    parent = {node: (up, length) for node, up, length in rows}
    names = sorted(k for k in parent if k not in {p for p, _ in parent.values()})

    def ups(x):
        out, d = {x: 0.0}, 0.0
        while parent[x][0] is not None:
            x, d = parent[x][0], d + parent[x][1]
            out[x] = d
        return out

    u = {i: ups(i) for i in names}
    return {(i, j): min(u[i][a] + u[j][a] for a in u[i] if a in u[j]) for i, j in itertools.combinations(names, 2)}


def test_neighbour_joining_recovers_additive_trees(spark):
    r, rows, want = random.Random(3), [], {}
    for tree in range(12):
        n = r.randint(2, 9)
        _, d = random_tree(r, n)
        want[tree] = d
        rows += [(tree % 3, tree, i, j, float(d[i, j])) for i, j in itertools.combinations(range(n), 2)]
    df = spark.createDataFrame(rows, "lineage long, replicate int, i int, j int, dist double").repartition(5)
    found = {}
    for x in T.nj_trees(df, ["lineage", "replicate"]).collect():
        found.setdefault(x.replicate, []).append((x.node_id, x.parent_id, x.length))
    for tree, d in want.items():
        for (i, j), v in path_distances(found[tree]).items():
            assert abs(v - d[i, j]) < 1e-9


def plain_joining(d):
    """Neighbour joining with a fresh matrix for every pair: {node: (parent, length)}."""
    n = len(d)
    if n == 1:
        return {0: (1, 0.0), 1: (-1, 0.0)}
    ids, out, new = list(range(n)), {}, n
    while len(ids) > 2:
        m, r = len(ids), d.sum(axis=1)
        q = (m - 2) * d - (r[:, None] + r[None, :])
        np.fill_diagonal(q, np.inf)
        i, j = divmod(int(np.argmin(q)), m)
        li = d[i, j] / 2 + (r[i] - r[j]) / (2 * (m - 2))
        out[ids[i]], out[ids[j]] = (new, max(li, 0.0)), (new, max(d[i, j] - li, 0.0))
        u = (d[i] + d[j] - d[i, j]) / 2
        keep = [k for k in range(m) if k not in (i, j)]
        d = np.block([[d[np.ix_(keep, keep)], u[keep][:, None]], [u[keep][None], np.zeros((1, 1))]])
        ids, new = [ids[k] for k in keep] + [new], new + 1
    return out | {x: (new, max(d[0, 1] / 2, 0.0)) for x in ids} | {new: (-1, 0.0)}


def test_bounded_search_joins_the_same_pairs():
    r = np.random.default_rng(7)
    for top in [2, 5, 40, 10**6] * 25:  # few values: many ties
        n = int(r.integers(1, 50))
        d = np.triu(r.integers(0, top, (n, n)).astype(float), 1)
        d += d.T
        want = plain_joining(d.copy())
        parent, length = N.in_step(np.stack([d, d]))
        ways = [(parent[0], length[0]), (parent[1], length[1]), N.bounded(d.copy())] if n > 1 else [(parent[0], length[0])]
        for parents, lengths in ways:
            assert {k: p for k, (p, _) in want.items()} == dict(enumerate(parents.tolist()))
            assert all(abs(lengths[k] - x) < 1e-6 for k, (_, x) in want.items())


def test_bootstrap_trees_are_those_of_weighted_distances(spark):
    r = random.Random(2)
    long = [(g, v, f) for g, n in (("a", 6), ("b", 70), ("c", 1)) for v in range(n) for f in range(30) if r.random() < 0.3 or f == v % 30]
    df = spark.createDataFrame(long, "lineage string, variant_no int, feature_no int").repartition(4)
    words = spark.createDataFrame([(g, f) for g in "abc" for f in range(30)], "lineage string, feature_no int")
    found = N.bootstrap_trees(df, words, 5).withColumn("tree", F.concat_ws("#", "lineage", "replicate"))
    want = T.nj_trees(T.pairwise_distance(df, T.bootstrap_weights(words, 5)), ["lineage", "replicate"])
    cols = ["lineage", "replicate", "node_id", "parent_id", "name", "is_tip"]
    assert sorted(map(str, found.select(*cols).collect())) == sorted(map(str, want.select(*cols).collect()))
    lengths = {(x.lineage, x.replicate, x.node_id): x.length for x in want.collect()}
    assert all(x.length is None or abs(x.length - lengths[x.lineage, x.replicate, x.node_id]) < 1e-6 for x in found.collect())
    marks = ["tree", "node_id", "pre", "size", "n_tips", "sig1", "sig2"]
    assert sorted(map(tuple, found.select(*marks).collect())) == sorted(map(tuple, T.clade_signatures(found).select(*marks).collect()))


def test_tiles_equal_set_differences(spark):
    """Blocks of every fill, also with weights, and a group whose numbers start late."""
    r = random.Random(4)
    own = {(g, v): {f for f in range(25) if r.random() < 0.3} for g, n in (("a", 23), ("b", 9), (None, 3)) for v in range(n)}
    own |= {("late", 40 + v): {v, v + 1} for v in range(6)}
    df = spark.createDataFrame([(g, v, f) for (g, v), x in own.items() for f in x], "lineage string, variant_no int, feature_no int").repartition(3)
    weights = {(k, f): r.randint(0, 3) for k in range(3) for f in range(46)}
    for edge in (1, 4, 256):
        found = {(x.lineage, x.i, x.j): x.dist for x in T.pairwise_distance(df.where("lineage is not null"), edge=edge).collect()}
        named = [(k, x) for k, x in own.items() if x and k[0] is not None]
        assert found == {(a[0], a[1], b[1]): len(x ^ y) for a, x in named for b, y in named if a[0] == b[0] and a[1] < b[1]}
    w = spark.createDataFrame([("a", k, f, n) for (k, f), n in weights.items() if n], "lineage string, replicate int, feature_no int, weight long")
    found = {(x.replicate, x.i, x.j): x.dist for x in T.pairwise_distance(df, w, edge=5).collect()}
    named = [(v, x) for (g, v), x in own.items() if g == "a" and x]
    assert found == {(k, i, j): sum(weights[k, f] for f in x ^ y) for k in range(3) for i, x in named for j, y in named if i < j}


def random_splits_trees(spark, seed, n_trees, tips):
    r, rows = random.Random(seed), []
    for k in range(n_trees):
        shape, _ = random_tree(random.Random(r.randint(0, 2)), tips)
        top = max(p for p, _ in shape.values())
        rows += [("g", k, x, p, str(x) if x < tips else None, length, x < tips) for x, (p, length) in shape.items()] + [("g", k, top, None, None, None, False)]
    return spark.createDataFrame(rows, "lineage string, replicate int, node_id long, parent_id long, name string, length double, is_tip boolean")


def test_consensus_by_signature_equals_that_by_names(spark):
    """Also with ties of exactly one half, and for trees that are all alike."""
    for seed, n, tips in ((5, 9, 6), (6, 4, 7), (8, 2, 9), (9, 6, 5)):
        trees = random_splits_trees(spark, seed, n, tips)
        named = trees.withColumn("tree", F.concat_ws("#", "lineage", "replicate")).withColumn("name", F.lpad("name", 4, "0")).withColumn("group", F.lit("g"))
        by_name = T.consensus(T.clades(named).withColumn("group", F.lit("g")), named.where("is_tip").select("group", "tree", "name", "length"), named.groupBy("group").agg(F.count_distinct("tree").alias("n")))
        rows = lambda df: {x.key: (x.parent, x.support, round(x.length, 9), x.size) for x in df.collect()}
        found = rows(H.consensus_of(trees))
        assert found == rows(by_name)
        for key, (parent, *_) in found.items():  # the smallest that holds it
            holders = [k for k in found if k != key and set(key.split(",")) < set(k.split(","))]
            assert parent == min(holders, key=lambda k: found[k][3], default=None)


def test_bootstrap_draws_as_many_as_there_are(spark):
    words = spark.createDataFrame([(g, k) for g, n in (("a", 7), ("b", 1), ("c", 40)) for k in range(n)], "lineage string, feature_no int")
    w = T.bootstrap_weights(words, 20)
    sums = {(r.lineage, r.replicate): r.s for r in w.groupBy("lineage", "replicate").agg(F.sum("weight").alias("s")).collect()}
    assert sums == {(g, k): n for g, n in (("a", 7), ("b", 1), ("c", 40)) for k in range(20)}
    assert w.where("lineage = 'c'").groupBy("replicate").count().where("count < 40").count() == 20  # with replacement
    assert sorted(map(tuple, w.collect())) == sorted(map(tuple, T.bootstrap_weights(words, 20).collect()))


def test_consensus_against_counting(spark):
    r, rows = random.Random(5), []
    for k in range(9):
        shape, _ = random_tree(random.Random(r.randint(0, 2)), 6)
        top = max(p for p, _ in shape.values())
        rows += [("g", k, x, p, str(x) if x < 6 else None, length, x < 6) for x, (p, length) in shape.items()] + [("g", k, top, None, None, None, False)]
    trees = spark.createDataFrame(rows, "lineage string, replicate int, node_id long, parent_id long, name string, length double, is_tip boolean")
    below, counts = {}, {}
    for _, k, x, p, name, _, tip in rows:
        up = {a: b for _, kk, a, b, *_ in rows if kk == k}
        if tip:
            at = x
            while up[at] is not None:
                at = up[at]
                below.setdefault((k, at), set()).add(name.rjust(4, "0"))
    for tips in below.values():
        counts[",".join(sorted(tips))] = counts.get(",".join(sorted(tips)), 0) + 1
    got = {x.key: x.support for x in H.consensus_of(trees).where("size > 1").collect()}
    sure = {k: n / 9 for k, n in counts.items() if n / 9 > 0.5}
    assert sure == {k: v for k, v in got.items() if v > 0.5}


def test_bead_plots_place_every_sample_once(spark, sf):
    rows = B.beadplots(spark, sf).collect()
    placed = {}
    for r in rows:
        placed[r.lineage] = placed.get(r.lineage, 0) + r.n
    want = {r.lineage: r["count"] for r in P.families(spark, sf).where("variant_key != ''").groupBy("lineage").count().collect()}
    assert placed == want
    by = {}
    for r in rows:
        by.setdefault(r.lineage, []).append(r)
    for nodes in by.values():
        names = [r.variant for r in nodes]
        assert len(set(names)) == len(names) and sum(r.parent is None for r in nodes) == 1
        assert all(r.parent in set(names) for r in nodes if r.parent is not None)
        assert sorted(r.pos for r in nodes if r.pos is not None) == list(range(len(nodes) - 1))


def test_nearest_hit_in_slices(spark):
    r = random.Random(8)
    ids = sorted({(r.choice(["a", "b", None]), r.randint(0, 300)) for _ in range(200)}, key=str)
    hits = sorted({(r.choice(["a", "b"]), r.randint(0, 300)) for _ in range(25)} | {(None, 7)}, key=str)
    a, b = spark.createDataFrame(ids, "g string, id long"), spark.createDataFrame(hits, "g string, id long")
    for slices in (1, 5, 64):
        for lo, hi in ((None, None), (50, 120)):
            got = {(x.g, x.id): (x.before, x.after, x.nearest) for x in J.nearest_hit(a, b, ["g"], first=lo, last=hi, slices=slices).collect()}
            for g, i in ids:
                own = [h for k, h in hits if k == g and (lo is None or lo <= h <= hi)]
                before, after = max((h for h in own if h <= i), default=None), min((h for h in own if h >= i), default=None)
                near = after if before is None or (after is not None and after - i <= i - before) else before
                assert got[g, i] == (before, after, near)


def test_names_and_supports(spark):
    row = spark.createDataFrame([("hCoV-19/C te d'Or/1",)], "n string").select(X.fasta_name(F.col("n"), F.lit("EPI_ISL_1")).alias("x")).first()
    assert row.x == "hCoV-19/C_te_d''Or/1__accession__EPI_ISL_1"
    rows = [("t", 0, None, None, None, None, False), ("t", 1, 0, None, 0.2, 1.0, False), ("t", 2, 0, None, None, 1.0, False), ("t", 3, 1, "a", None, 1.0, True), ("t", 4, 2, "b", None, 1.0, True)]
    nodes = spark.createDataFrame(rows, "tree string, node_id long, parent_id long, name string, support double, length double, is_tip boolean")
    assert {r.node_id for r in T.collapse_low_support(nodes).collect()} == {0, 2, 3, 4}  # one without a support stays
    named = {r.node_id: (r.name, r.support) for r in T.support_names(nodes).collect()}
    assert named[1] == ("0.2", None) and named[2] == (None, None) and named[3] == ("a", None)


def test_outgroup_is_rooted_on_and_dropped(spark):
    # ((a:1,(b:1,reference:5):2):3,c:4) rooted where the reference joins: b and the rest
    rows = [(0, None, None, None, False), (1, 0, None, 3.0, False), (2, 0, "c", 4.0, True), (3, 1, "a", 1.0, True), (4, 1, None, 2.0, False), (5, 4, "b", 1.0, True), (6, 4, "reference", 5.0, True)]
    nodes = spark.createDataFrame([("t", *r) for r in rows], "tree string, node_id long, parent_id long, name string, length double, is_tip boolean")
    found = {r.node_id: (r.parent_id, r.length) for r in T.drop_outgroup(nodes).collect()}
    assert found == {4: (None, None), 5: (4, 1.0), 1: (4, 2.0), 3: (1, 1.0), 2: (1, 7.0)}


def test_what_is_served_of_bead_plots(spark, sf):
    """Samples, variants, points, edges and summaries of the same plots agree with each other; cluster files give them back."""
    e = P.families(spark, sf).where("cast(lineage as int) % 3 = 0")
    plots = H.bead_plots(e, 5000, 20)
    tables = {k: v.collect() for k, v in H.cluster_tables(plots).items()}
    placed, nodes, edges = plots.samples.collect(), plots.nodes.collect(), plots.edges.collect()
    assert sorted(r.accession for r in placed) == sorted(r.accession for r in e.where("variant_key != ''").collect())
    by_node = {}
    for r in placed:
        by_node.setdefault((r.lineage, r.variant), []).append(r)
    assert {(r.lineage, r.variant): r.n for r in nodes} == {(r.lineage, r.variant): len(by_node.get((r.lineage, r.variant), [])) for r in nodes}
    assert all(r.variant == str(min((x.coldate, x.accession) for x in by_node[r.lineage, r.variant])[1]) if r.n else r.variant.startswith("unsampled") for r in nodes)
    dates = {}
    for r in placed:
        dates.setdefault(r.lineage, []).append(r.coldate)
    for r in tables["variants"]:
        own = [x.coldate for x in by_node.get((r.lineage, r.variant_key), [])]
        assert (r.n, r.unsampled, r.num_beads) == (len(own), not own, len(set(own)))
        assert (r.x1, r.x2) == ((min(own), max(own)) if own else (min(dates[r.lineage]), max(dates[r.lineage])))
    assert {(r.lineage, r.variant_key, r.coldate): r.n for r in tables["points"]} == {(k[0], k[1], d): sum(x.coldate == d for x in v) for k, v in by_node.items() for d in {x.coldate for x in v}}
    first = {(r.lineage, r.variant_key): (r.label, r.x1) for r in tables["variants"]}
    assert sorted((r.lineage, r.parent, r.child, r.parent_label, r.child_label, r.x1) for r in tables["edges"]) == sorted((r.lineage, r.parent, r.child, first[r.lineage, r.parent][0], *first[r.lineage, r.child]) for r in edges)
    for r in tables["clusters"]:
        own = [x for x in placed if x.lineage == r.lineage]
        assert (r.n_samples, r.n_nodes) == (len(own), sum(x.lineage == r.lineage for x in nodes)) and r.regions == {x.region: sum(y.region == x.region for y in own) for x in own}
        assert r.max_dist == max((x.dist for x in edges if x.lineage == r.lineage), default=None)


def test_daily_run_equals_the_whole(spark, sf):
    """Plots of lineages that are computed again are those of the chain on all samples; others stay as they were stored."""
    e = P.families(spark, sf).where("cast(lineage as int) % 5 = 0")
    early, late = e.where("coldate <= '2001-01-01'"), e.where("coldate > '2001-01-01'")
    gone = early.agg(F.min("lineage")).first()[0]  # has left by the second day
    _, first = H.daily_run(None, early, early, 5000, 10)
    now = e.where(F.col("lineage") != gone)
    updated, second = H.daily_run(first, late.where(F.col("lineage") != gone), now, 5000, 10)
    again = {r.lineage for r in updated.collect()}
    assert again == {r.lineage for r in late.where("variant_key != ''").select("lineage").distinct().collect()} - {gone}
    rows = lambda df, keep: sorted(str(r) for r in df.collect() if keep(r.lineage))
    whole, found = H.node_table(H.bead_plots(now, 5000, 10)), H.node_table(second)
    assert rows(found, again.__contains__) == rows(whole, again.__contains__) and again
    assert rows(found, lambda x: x not in again) == rows(H.node_table(first), lambda x: x not in again and x != gone)
    assert {r.lineage for r in found.collect()} == {r.lineage for r in now.where("variant_key != ''").select("lineage").distinct().collect()}
