"""Trees by pointer jumping: rows stay linear in the nodes, whatever a tree's depth.

``up`` follows parents to the nearest ancestor that stays. ``tour`` ranks the Euler tour of every tree: a node is entered
and left, and after ``k`` rounds an entry knows the sums over the next ``2 ** k`` ones. The sum over the entries between a
node's entering and leaving is a difference of two such sums, so sizes, levels, depth-first places and any sum or
exclusive-or over subtrees come from one ranking. ``fold`` evaluates a mean of children from the leaves up, by raking leaves
and shortening chains. All work on many trees at once; every second
jump is a written table, so a lost executor costs two.

Nodes: tree, node_id, parent_id (null at a root), length. A tree may have several roots; a cycle is an error. Null node
ids are not allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from genosieve.sources.shared import cut, cut_counting

#: Doublings after which a tree counts as having a cycle.
ROUNDS = 48


def up(nodes: DataFrame, stays: Column | None = None) -> DataFrame:
    """(tree, node_id, anc, hops, dist): the nearest proper ancestor for which ``stays`` holds, its distance in steps and in
    lengths. Without one ``anc`` is null, and hops and dist reach to the root; by default only roots stay. Roots have no row."""
    stays = F.col("parent_id").isNull() if stays is None else F.coalesce(stays, F.lit(False))
    n = nodes.select("tree", "node_id", "parent_id", F.coalesce("length", F.lit(0.0)).alias("length"), stays.alias("stays"))
    p = n.select("tree", F.col("node_id").alias("parent_id"), F.when(F.col("stays"), 1).when(F.col("parent_id").isNull(), 2).otherwise(0).alias("end"))
    # end: 0 goes on, 1 has arrived, 2 has passed the root
    state = n.where("parent_id is not null").join(p, ["tree", "parent_id"]).select("tree", "node_id", F.col("parent_id").alias("anc"), F.lit(1).cast("long").alias("hops"), F.col("length").alias("dist"), "end")
    state, n = cut_counting(state, going=F.col("end") == 0)

    def jump(state: DataFrame) -> DataFrame:
        nxt = state.select("tree", F.col("node_id").alias("anc"), F.col("anc").alias("anc2"), F.col("hops").alias("h2"), F.col("dist").alias("d2"), F.col("end").alias("end2"))
        moved = state.where("end = 0").join(nxt, ["tree", "anc"]).select("tree", "node_id", F.col("anc2").alias("anc"), (F.col("hops") + F.col("h2")).alias("hops"), (F.col("dist") + F.col("d2")).alias("dist"), F.col("end2").alias("end"))
        return state.where("end > 0").unionByName(moved)

    for _ in range(ROUNDS):
        if not n["going"]:
            return state.select("tree", "node_id", F.when(F.col("end") == 1, F.col("anc")).alias("anc"), "hops", "dist")
        state, n = cut_counting(jump(jump(state)), going=F.col("end") == 0)
    raise ValueError("a tree has a cycle")


def levels(nodes: DataFrame) -> DataFrame:
    """(tree, node_id, depth, x) of every node: steps and lengths from its root."""
    roots = nodes.where("parent_id is null").select("tree", "node_id", F.lit(0).cast("long").alias("depth"), F.lit(0.0).alias("x"))
    return roots.unionByName(up(nodes).select("tree", "node_id", F.col("hops").alias("depth"), F.col("dist").alias("x")))


def entries(nodes: DataFrame, order: list[str]) -> DataFrame:
    """(tree, node_id, side, next_id, next_side): the tour's entries, side 0 enters and 1 leaves a node, with their successors.
    Children follow each other by ``order``; so do roots."""
    w = Window.partitionBy("tree", "parent_id").orderBy(*order)
    n = nodes.select("tree", "node_id", "parent_id", F.lead("node_id").over(w).alias("sibling"), F.row_number().over(w).alias("k"))
    first = n.where("k = 1 and parent_id is not null").select("tree", F.col("parent_id").alias("node_id"), F.col("node_id").alias("child"))
    n = n.join(first, ["tree", "node_id"], "left")
    step = lambda side, to, to_side: F.struct(F.lit(side).alias("side"), to.alias("next_id"), to_side.alias("next_side"))
    child, sibling = F.col("child"), F.col("sibling")
    both = F.array(
        step(0, F.coalesce(child, F.col("node_id")), F.when(child.isNull(), 1).otherwise(0)),
        step(1, F.coalesce(sibling, F.col("parent_id")), F.when(sibling.isNull(), F.when(F.col("parent_id").isNotNull(), 1)).otherwise(0)),
    )
    return n.select("tree", "node_id", F.explode(both).alias("e")).select("tree", "node_id", "e.*")


def tour(nodes: DataFrame, order: list[str] | None = None, sums: dict[str, Column] | None = None, xors: dict[str, Column] | None = None) -> DataFrame:
    """(tree, node_id, pre, size, depth, …) of every node: its place in depth-first order from 0, nodes below it and itself,
    steps from its root, and for every name of ``sums`` and ``xors`` the sum or the exclusive or of a column over the nodes
    below it and itself, and of those before it in the order as ``before_<name>``."""
    sums, xors = dict(sums or {}), dict(xors or {})
    own = nodes.select("*", *(F.coalesce(c, F.lit(0)).cast("long").alias(f"#w{i}") for i, c in enumerate((*sums.values(), *xors.values()))))
    weights = [F.col(f"#w{i}") for i in range(len(sums) + len(xors))]
    e = entries(own, order or ["node_id"]).join(own.select("tree", "node_id", *weights), ["tree", "node_id"])
    enters = F.col("side") == 0
    carried = {"n": F.when(enters, 1).otherwise(0), "d": F.when(enters, 1).otherwise(-1)} | {f"v{i}": F.when(enters, c).otherwise(0) for i, c in enumerate(weights)}
    going = F.col("next_id").isNotNull()
    state, n = cut_counting(e.select("tree", "node_id", "side", "next_id", "next_side", *(c.cast("long").alias(k) for k, c in carried.items())), going=going)
    exclusive = {f"v{i}" for i in range(len(sums), len(weights))}

    def jump(state: DataFrame) -> DataFrame:
        nxt = state.select("tree", F.col("node_id").alias("next_id"), F.col("side").alias("next_side"), F.col("next_id").alias("id2"), F.col("next_side").alias("side2"), *(F.col(c).alias(f"{c}_2") for c in carried))
        moved = state.where(going).join(nxt, ["tree", "next_id", "next_side"]).select(
            "tree", "node_id", "side", F.col("id2").alias("next_id"), F.col("side2").alias("next_side"),
            *((F.col(c).bitwiseXOR(F.col(f"{c}_2")) if c in exclusive else F.col(c) + F.col(f"{c}_2")).alias(c) for c in carried),
        )
        return state.where(~going).unionByName(moved)

    for _ in range(ROUNDS):
        if not n["going"]:
            break
        state, n = cut_counting(jump(jump(state)), going=going)
    else:
        raise ValueError("a tree has a cycle")
    # each entry now has the sums from itself to the end of its tree's tour
    a, b = (state.where(F.col("side") == s) for s in (0, 1))
    b = b.select("tree", "node_id", *(F.col(c).alias(f"{c}_2") for c in carried))
    values = [f"v{i}" for i in range(len(weights))]
    whole = a.groupBy("tree").agg(F.max("n").alias("all"), *(F.max_by(v, "n").alias(f"all_{v}") for v in values))
    out = [(F.col("all") - F.col("n")).alias("pre"), (F.col("n") - F.col("n_2")).alias("size"), (-F.col("d")).alias("depth")]
    for v, k in zip(values, (*sums, *xors)):
        less = (lambda x, y: x - y) if k in sums else (lambda x, y: x.bitwiseXOR(y))
        out += [less(F.col(v), F.col(f"{v}_2")).alias(k), less(F.col(f"all_{v}"), F.col(v)).alias(f"before_{k}")]
    return a.join(b, ["tree", "node_id"]).join(whole, "tree").select("tree", "node_id", *out)


def mean_of_children(nodes: DataFrame, leaf: Column) -> DataFrame:
    """(tree, node_id, y): leaves have the value ``leaf``, other nodes the mean of their children.

    Leaves are raked into their parents; a node that waits for one child is an affine function of it, and chains of such
    nodes are shortened by jumping, so a comb takes as many rounds as the logarithm of its depth."""
    kids = nodes.where("parent_id is not null").groupBy("tree", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("kids"))
    state = nodes.select("tree", "node_id", "parent_id", leaf.cast("double").alias("leaf")).join(kids, ["tree", "node_id"], "left")
    # y = acc + scale * sum of the children that are not known yet, whose number is ``left``
    waits = F.col("left") > 0
    state, n = cut_counting(state.select("tree", "node_id", "parent_id", F.when(F.col("kids").isNull(), F.col("leaf")).otherwise(0.0).alias("acc"), (1 / F.coalesce("kids", F.lit(1))).alias("scale"), F.coalesce("kids", F.lit(0)).alias("left"), F.lit(False).alias("told")), waits=waits)
    for _ in range(2 * ROUNDS):
        if not n["waits"]:
            return state.select("tree", "node_id", F.col("acc").alias("y"))
        # rake: values that no parent was told of go to the parents that still wait
        news = state.where("left = 0 and not told and parent_id is not null").groupBy("tree", F.col("parent_id").alias("node_id")).agg(F.sum("acc").alias("more"), F.count("*").alias("number"))
        acc = F.col("acc") + F.when(waits, F.col("scale") * F.coalesce("more", F.lit(0.0))).otherwise(0.0)
        left = F.when(waits, F.col("left") - F.coalesce("number", F.lit(0))).otherwise(0)
        state = state.withColumn("told", F.col("left") == 0).join(news, ["tree", "node_id"], "left").select("tree", "node_id", "parent_id", acc.alias("acc"), "scale", left.alias("left"), "told")
        before = n["waits"]
        state, n = cut_counting(state, waits=waits, one=F.col("left") == 1)
        if n["one"] and 2 * n["waits"] > before:  # raking alone is slow
            state, n = _along(state)
    raise ValueError("a tree has a cycle")


def _along(state: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """The state with those nodes known that wait for one child each, down to a child that is known: y = acc + scale * y(on)."""
    untold = state.where("not told").select("tree", F.col("parent_id").alias("node_id"), F.col("node_id").alias("on"), (F.col("left") == 1).alias("open"))
    chain, n = cut_counting(state.where("left = 1").select("tree", "node_id", "acc", "scale").join(untold, ["tree", "node_id"]), open=F.col("open"))
    for _ in range(ROUNDS):
        if not n["open"]:
            break
        nxt = chain.select("tree", F.col("node_id").alias("on"), F.col("acc").alias("a2"), F.col("scale").alias("s2"), F.col("on").alias("on2"), F.col("open").alias("open2"))
        moved = chain.where("open").join(nxt, ["tree", "on"]).select("tree", "node_id", (F.col("acc") + F.col("scale") * F.col("a2")).alias("acc"), (F.col("scale") * F.col("s2")).alias("scale"), F.col("on2").alias("on"), F.col("open2").alias("open"))
        chain, n = cut_counting(chain.where("not open").unionByName(moved), open=F.col("open"))
    ended = state.where("left = 0").select("tree", F.col("node_id").alias("on"), F.col("acc").alias("value"))
    found = chain.join(ended, ["tree", "on"]).select("tree", "node_id", (F.col("acc") + F.col("scale") * F.col("value")).alias("found"))
    known = F.col("found").isNotNull()
    state = state.join(found, ["tree", "node_id"], "left").select("tree", "node_id", "parent_id", F.coalesce("found", "acc").alias("acc"), "scale", F.when(known, 0).otherwise(F.col("left")).alias("left"), "told")
    return cut_counting(state, waits=F.col("left") > 0)
