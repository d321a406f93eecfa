"""Hand-made cases with known results."""

from datetime import date

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from genosieve.functions import expressions as X
from genosieve.operators import aggregates as A, features as O, joins as J, qc, trees as T
from genosieve.plans import registry


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_total_missing(spark):
    v = F.expr("array(named_struct('left', 0, 'right', 6), named_struct('left', 5203, 'right', 5222), named_struct('left', 29844, 'right', 29903))")
    assert one(spark, X.total_missing(v)) == 84


def test_apply_features(spark):
    subs = {5: "T", 7: "T", 9: "T", 11: "T", 25: "T", 27: "T", 29: "T", 31: "G", 35: "A"}
    diffs = F.array(*(F.struct(F.lit("~").alias("typ"), F.lit(p).alias("pos"), F.lit(a).alias("alt")) for p, a in subs.items()))
    missing = F.array(*(F.struct(F.lit(a).alias("left"), F.lit(b).alias("right")) for a, b in ((0, 6), (10, 14), (25, 29))))
    assert one(spark, X.apply_features(diffs, missing, F.lit("ATTAAAGGTTTATACCTTCCCAGGTAACAAACCAACCAAC"))) == "NNNNNTGTTTNTNNCCTTCCCAGGTTNTNTAGCAAACAAC"


def test_clock(spark):
    df = spark.createDataFrame([(n, date(2021, 1, 18)) for n in (30, 42, 14)], "n_features int, coldate date")
    found = {r.n_features: (r.outlier, r.qmin, r.qmax) for r in qc.clock_outliers(df, 0.0655, 0.005).collect()}
    assert found == {30: (False, 15, 41), 42: (True, 15, 41), 14: (True, 15, 41)}
    assert not any(r.outlier for r in qc.clock_outliers(df, 0.0655, 0.0).collect())


def test_predicates(spark):
    assert [one(spark, X.is_accession(F.lit(a))) for a in ("EPI_ISL_545540", "EPI_ISL5455402")] == [True, False]
    assert [one(spark, X.is_iso_date(F.lit(d))) for d in ("2021-14-12", "2021-02-35", "Jul 05 2021", "2021-07-05")] == [False, False, False, True]


def test_window_order(spark):
    with pytest.raises(ValueError):
        qc.in_window(spark.range(1).withColumn("d", F.current_date()), date(2021, 5, 13), date(2021, 5, 10), "d")


def test_keys_round_trip(spark):
    for key in ("-|28|1", "~|30|C,~|32|A", "+|13|A", ""):
        assert one(spark, X.variant_key(X.parse_key(F.lit(key)))) == key


def nodes(spark, newick):
    return T.read_newick(spark.createDataFrame([(0, newick)], "tree int, newick string"))


def test_parents(spark):
    n = nodes(spark, "((A,B)D,C)E;").collect()
    name = {r.node_id: r.name for r in n}
    assert {r.name: name.get(r.parent_id) for r in n} == {"A": "D", "B": "D", "D": "E", "C": "E", "E": None}


@pytest.mark.parametrize("before, after", [
    ("((A:1,B:1):0,C:1):0;", {"A": "", "B": "", "C": ""}),
    ("((A:1,B:1):0,(C:1,D:1):1):0;", {"A": "", "B": "", "C": None, "D": None}),
    ("((A:1,B:1):1,C:0):0;", {"A": None, "B": None, None: "C"}),
    ("((A:1,B:1):1,(C:0,D:0):1):0;", {"A": None, "B": None, "C|D": ""}),
])
def test_contract(spark, before, after):
    """after: tip or node -> its parent's name, '' for an unnamed root, None for an unnamed inner node."""
    out = T.contract(nodes(spark, before)).collect()
    by = {r.node_id: r for r in out}
    root = next(r for r in out if r.parent_id is None)
    label = lambda r: r.name if r.name is not None else ("" if r.node_id == root.node_id else None)
    found = {r.name: label(by[r.parent_id]) for r in out if r.parent_id is not None}
    for child, parent in after.items():
        assert found[child] == parent


def test_consensus_of_two_trees(spark):
    rows = [("g", t, tips.split(","), x) for t, x in ((0, 1.0), (1, 2.0)) for tips in ("A,B", "A,B,C,D")] + [("g", 0, ["C", "D"], 3.0)]
    splits = spark.createDataFrame(rows, "group string, tree int, tips array<string>, length double")
    tips = spark.createDataFrame([("g", t, n, 0.5) for t in (0, 1) for n in "ABCD"], "group string, tree int, name string, length double")
    found = {r.key: (r.parent, r.support, r.length) for r in T.consensus(splits, tips, spark.createDataFrame([("g", 2)], "group string, n long")).collect()}
    assert found["A,B"] == ("A,B,C,D", 1.0, 1.5) and found["C,D"] == ("A,B,C,D", 0.5, 3.0) and found["A,B,C,D"][0] is None
    assert found["A"] == ("A,B", None, 0.5) and found["D"][0] == "C,D"


@settings(max_examples=20, deadline=None)
@given(st.integers(3, 9), st.integers(0, 10**6))
def test_neighbor_joining_recovers_additive_trees(n, seed):
    r = np.random.default_rng(seed)
    parent = {k: None for k in range(n)}
    length, live, new = {}, list(range(n)), n
    while len(live) > 1:  # a random binary tree
        a, b = (live.pop(int(r.integers(len(live)))) for _ in range(2))
        parent[a] = parent[b] = new
        length[a], length[b] = r.integers(1, 10, 2)
        live.append(new)
        parent[new] = None
        new += 1

    def up(x, parent, length):
        out, d = {x: 0.0}, 0.0
        while parent[x] is not None:
            d += float(length[x])
            x = parent[x]
            out[x] = d
        return out

    def matrix(parent, length):
        ups = [up(k, parent, length) for k in range(n)]
        return np.array([[min(a[k] + b[k] for k in a if k in b) for b in ups] for a in ups])

    d = matrix(parent, length)
    rows = T.neighbor_joining(d)
    assert np.allclose(matrix({k: p for k, p, _ in rows}, {k: x for k, _, x in rows}), d)


def test_diversity_equals_pairs(spark):
    r = np.random.default_rng(3)
    has = r.random((40, 8)) < 0.4
    samples = spark.createDataFrame([(i, "x") for i in range(40)], "accession long, lineage string")
    features = spark.createDataFrame([(i, "~", int(f), "A") for i in range(40) for f in range(8) if has[i, f]], "accession long, typ string, pos int, alt string")
    freq = A.feature_frequencies(samples, features)
    pi = A.nucleotide_diversity(freq, samples.groupBy("lineage").agg(F.count("*").alias("n"))).first().pi
    pairs = np.mean([(has[i] != has[j]).sum() for i in range(40) for j in range(40) if i != j])
    assert abs(pi - pairs) < 1e-9


def test_cigar(spark):
    sam = spark.createDataFrame([("r", 6, "2=1X2D1I1=2X", "ACGTCNA")], "qname string, pos int, cigar string, seq string")
    features, missing = O.cigar_features(sam, 20)
    assert {tuple(r)[1:] for r in features.collect()} == {("~", 8, "G"), ("-", 9, "2"), ("+", 11, "T")}
    assert {tuple(r)[1:] for r in missing.collect()} == {(0, 6), (12, 14), (14, 20)}
    assert O.cigar_align(sam, 20).first().aligned == "------ACG--CNA------"


def test_annotate_first_frame_wins(spark):
    orfs = spark.createDataFrame([(1, "a", 0, 6), (2, "b", 3, 9)], "ord int, orf string, l int, r int")
    f = spark.createDataFrame([(0, "~", 4, "C"), (0, "~", 7, "A"), (0, "+", 2, "GG"), (0, "~", 20, "A")], "accession int, typ string, pos int, alt string")
    found = {r.pos: r.name for r in O.annotate(f, orfs, O.codons(spark), "ATGGATAAA").collect()}
    assert found == {4: "aa:a:D2A", 7: None, 2: "ins:3:2", 20: None} or found[4] == "aa:a:D2A"


def test_strict_join_fails(spark):
    left, right = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x")], "k int, v string")
    assert J.attach(left, right, "k").count() == 2
    with pytest.raises(Exception, match="no match for 2"):
        J.attach(left, right, "k", strict=True).collect()


def test_deep_tree(spark):
    chain = spark.createDataFrame([(0, i, i - 1 if i else None, f"n{i}", 1.0, i == 299) for i in range(300)], "tree int, node_id long, parent_id long, name string, length double, is_tip boolean")
    assert T.ancestors(chain).where("node_id = 299").agg(F.max("dist")).first()[0] == 299.0


def test_registry_needs_no_session():
    assert set(registry.oracle_sql()) <= set(registry.queries())
