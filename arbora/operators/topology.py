"""Topology of trees in a node table.

Recursion along parent pointers is pointer doubling: after round k every node knows the fold of a
value over 2**k steps towards its root. Trees of up to ``folds.GROUP`` nodes are folded where they lie, many
in one task. A larger tree of depth d needs about log2(d) equi-joins on (tree_id, id), and no task ever holds
it as a whole, so one tree may hold a third of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vector as V
from ..runtime import Rounds, cut, unbroadcast
from . import folds

#: Rounds before the largest tree is measured, which bounds the number of rounds.
FREE_ROUNDS = 6

#: How a fold joins the value nearer to the node (a) with the one further up (b).
_JOIN = {
    "sum": lambda a, b: a + b,
    "max": lambda a, b: F.greatest(a, b),
    "min": lambda a, b: F.least(a, b),
    "or": lambda a, b: a | b,
    "and": lambda a, b: a & b,
    "first": lambda a, b: F.coalesce(a, b),
    "last": lambda a, b: F.coalesce(b, a),
    "concat": lambda a, b: F.concat(a, b),
}
_AGG = {"sum": F.sum, "max": F.max, "min": F.min, "or": F.bool_or, "and": F.bool_and}


def is_root() -> Column:
    return F.col("pid") == -1


def edges(nodes: DataFrame) -> DataFrame:
    """(tree_id, id, pid, c_*, p_*, length) of every parent and child: the compartments of the trees."""
    c = nodes.where(~is_root()).select("tree_id", "id", "pid", *(F.col(k).alias(f"c_{k}") for k in ("x", "y", "z", "r", "type")))
    p = nodes.select("tree_id", F.col("id").alias("pid"), *(F.col(k).alias(f"p_{k}") for k in ("x", "y", "z", "r", "type")))
    e = c.join(unbroadcast(p), ["tree_id", "pid"])
    return e.withColumn("length", V.distance(V.vec("c_"), V.vec("p_")))


def adjacency(nodes: DataFrame) -> DataFrame:
    """(tree_id, i, j, v): v is 1 from parent i to child j."""
    return nodes.where(~is_root()).select("tree_id", F.col("pid").alias("i"), F.col("id").alias("j"), F.lit(1).alias("v"))


def child_counts(nodes: DataFrame) -> DataFrame:
    """nodes with n_children (long)."""
    n = nodes.where(~is_root()).groupBy("tree_id", F.col("pid").alias("id")).agg(F.count("*").alias("n_children"))
    return nodes.drop("n_children").join(unbroadcast(n), ["tree_id", "id"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))


def with_parent(nodes: DataFrame, *columns: str) -> DataFrame:
    """nodes with p_<column> of the parent, null at roots."""
    p = nodes.select("tree_id", F.col("id").alias("pid"), *(F.col(c).alias(f"p_{c}") for c in columns))
    return nodes.join(unbroadcast(p), ["tree_id", "pid"], "left").select(*nodes.columns, *(f"p_{c}" for c in columns))


def children(nodes: DataFrame) -> DataFrame:
    """(tree_id, id, children): ids of the children in order of id."""
    return nodes.where(~is_root()).groupBy("tree_id", F.col("pid").alias("id")).agg(F.array_sort(F.collect_list(F.col("id"))).alias("children"))


def roots(nodes: DataFrame) -> DataFrame:
    return nodes.where(is_root())


def soma(nodes: DataFrame, type_check: bool = True) -> DataFrame:
    """The root of every tree; with ``type_check`` one that is not a soma raises."""
    r = roots(nodes)
    if not type_check:
        return r
    ok = F.assert_true(F.col("type") == 1, F.lit("a root is not of type soma"))
    return r.where(ok.isNull())


def tips(nodes: DataFrame) -> DataFrame:
    """Nodes without children."""
    p = nodes.where(~is_root()).select("tree_id", F.col("pid").alias("id"))
    return nodes.join(unbroadcast(p), ["tree_id", "id"], "left_anti").select(*nodes.columns)


def furcations(nodes: DataFrame) -> DataFrame:
    """Nodes with more than one child."""
    return child_counts(nodes).where("n_children > 1").select(*nodes.columns)


#: The same by its older name.
bifurcations = furcations


def climb(nodes: DataFrame, values: dict[str, tuple[Column, str]], stop: Column | None = None, carry: list[str] | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """Folds over the way from every node to its root.

    (tree_id, id, top, <names>): ``values`` maps a name to (value of a node, join); the fold covers the
    node itself and the root. Nodes where ``stop`` holds end the way like roots; so does a node whose
    parent is missing. ``top`` is the node where the way ends, null on a cycle. The columns of
    nodes named by ``carry`` come along. ``sizes``: nodes, or a cheaper table with as many rows a tree or more.
    """
    anc = F.when(is_root() | (F.coalesce(stop, F.lit(False)) if stop is not None else F.lit(False)), F.lit(None)).otherwise(F.col("pid"))
    return _folded(nodes, anc, values, _climb_by_rounds, carry, sizes)


def _folded(nodes: DataFrame, anc: Column, values: dict[str, tuple[Column, str]], by_rounds, carry: list[str] | None, sizes: DataFrame | None) -> DataFrame:
    """A fold within tasks for the trees that fit, by rounds for the others."""
    extra = [c for c in carry or [] if c not in ("tree_id", "id", *values)]
    state = nodes.select("tree_id", "id", anc.cast(dict(nodes.dtypes)["pid"]).alias("_anc"), *(v.alias(n) for n, (v, _) in values.items()), *extra)
    bare = state.drop(*extra)
    hows = {n: how for n, (_, how) in values.items()}
    if folds.can(bare, values):
        large = folds.large_trees(nodes if sizes is None else sizes)
        few = folds.fold(state if large is None else state.join(large, "tree_id", "left_anti"), hows, by_rounds is _climb_by_rounds)
        if carry is None:
            few = cut(few)  # it may be read more than once
        if large is None:
            return unbroadcast(few)
        bare = bare.join(large, "tree_id", "left_semi")
    else:
        few = None
    many = by_rounds(bare, hows)
    if extra:
        many = nodes.select("tree_id", "id", *extra).join(unbroadcast(many), ["tree_id", "id"])
    return unbroadcast(many if few is None else few.unionByName(many))


def _climb_by_rounds(state: DataFrame, values: dict[str, str]) -> DataFrame:
    live = F.col("_anc").isNotNull().alias("_live")
    s = Rounds(state.select("tree_id", "id", "_anc", F.col("id").alias("top"), *values, live), "_live")
    rounds = 0
    while not s.over and not _all_on_cycles(s, rounds):
        both = s.done.unionByName(s.live)
        up = both.select("tree_id", F.col("id").alias("_anc"), F.col("_anc").alias("_up"), F.col("top").alias("_top"), *(F.col(n).alias(f"_{n}") for n in values))
        step = s.live.join(unbroadcast(up), ["tree_id", "_anc"], "left")
        met = F.col("_top").isNotNull()
        step = step.select(
            "tree_id", "id", F.col("_up").alias("_anc"), F.coalesce("_top", "top").alias("top"),
            *(F.when(met, _JOIN[how](F.col(n), F.col(f"_{n}"))).otherwise(F.col(n)).alias(n) for n, how in values.items()),
        )
        s.next(step.select("*", live))
        rounds += 1
    s = s.done.unionByName(s.live)
    return s.withColumn("top", F.when(F.col("_anc").isNull(), F.col("top"))).drop("_anc")


def _all_on_cycles(s: Rounds, rounds: int) -> bool:
    """Whether what is live after so many rounds lies on a cycle or hangs below one.

    After ``rounds`` a node has gone 2**rounds steps, and a way without a cycle has fewer than its tree has nodes.
    """
    if rounds == FREE_ROUNDS:
        most = s.done.unionByName(s.live).groupBy("tree_id").count().agg(F.max("count")).first()[0]
        s.limit = int(most - 1).bit_length()
    return rounds >= FREE_ROUNDS and rounds >= s.limit


def gather(nodes: DataFrame, values: dict[str, tuple[Column, str]], carry: list[str] | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """Folds over the subtree under every node, itself included: (tree_id, id, <names>).

    Joins are sum, max, min, or, and. Nodes that lie on a cycle or below one have no defined fold. ``carry``
    and ``sizes`` as in ``climb``.
    """
    return _folded(nodes, F.when(is_root(), None).otherwise(F.col("pid")), values, _gather_by_rounds, carry, sizes)


def _gather_by_rounds(state: DataFrame, values: dict[str, str]) -> DataFrame:
    """After round k a node holds its descendants nearer than 2**k; those of the node 2**k further down are added next, each once."""
    # a node that has met its root still takes what comes from below, so all rows stay live until the end
    s = Rounds(state.select("*", F.lit(True).alias("_live")), "_live")
    rounds = 0
    while not s.over and not s.live.where("_anc IS NOT NULL").isEmpty() and not _all_on_cycles(s, rounds):
        below = s.live.where("_anc IS NOT NULL").groupBy("tree_id", F.col("_anc").alias("id")).agg(*(_AGG[how](n).alias(f"_{n}") for n, how in values.items()))
        up = s.live.select("tree_id", F.col("id").alias("_anc"), F.col("_anc").alias("_up"))
        new = s.live.join(unbroadcast(up), ["tree_id", "_anc"], "left").join(unbroadcast(below), ["tree_id", "id"], "left")
        s.next(
            new.select(
                "tree_id", "id", F.col("_up").alias("_anc"),
                *(F.when(F.col(f"_{n}").isNull(), F.col(n)).otherwise(_JOIN[how](F.col(n), F.col(f"_{n}"))).alias(n) for n, how in values.items()),
                F.lit(True).alias("_live"),
            )
        )
        rounds += 1
    return s.live.drop("_anc")


def root_walk(nodes: DataFrame) -> DataFrame:
    """nodes with n_children, root, depth (edges), path_length, branch_order and furcation_level.

    branch_order counts the furcations from the node to the root, both included; furcation_level does
    not count the root.
    """
    n = child_counts(with_parent(nodes, "x", "y", "z"))
    step = F.coalesce(V.distance(V.vec(), V.vec("p_")), F.lit(0.0))
    fork = (F.col("n_children") > 1).cast("long")
    n = n.withColumn("_step", step).withColumn("_fork", fork)
    w = climb(n, {
        "depth": (F.when(is_root(), 0).otherwise(1).cast("long"), "sum"),
        "path_length": (F.col("_step"), "sum"),
        "branch_order": (F.col("_fork"), "sum"),
        "furcation_level": (F.when(is_root(), 0).otherwise(F.col("_fork")).cast("long"), "sum"),
    }, carry=[*(c for c in nodes.columns if c != "n_children"), "n_children"], sizes=nodes)
    return w.withColumnRenamed("top", "root").select(*nodes.drop("n_children").columns, "n_children", "root", "depth", "path_length", "branch_order", "furcation_level")


def components(nodes: DataFrame) -> DataFrame:
    """nodes with component_id (0, 1, ... in order of the roots' ids) and root, by tree_id.

    A node whose parent is missing raises, as a file with such a node is damaged.
    """
    p = nodes.select("tree_id", F.col("id").alias("pid"), F.lit(True).alias("_there"))
    ok = F.assert_true(is_root() | F.col("_there").isNotNull(), F.lit("a node's parent is missing"))
    sound = nodes.join(p, ["tree_id", "pid"], "left").where(ok.isNull()).select(*nodes.columns)
    top = climb(sound, {}).withColumnRenamed("top", "root")
    ids = roots(nodes).groupBy("tree_id").agg(F.array_sort(F.collect_list("id")).alias("_roots"))
    out = nodes.join(top, ["tree_id", "id"]).join(ids, "tree_id")
    return out.withColumn("component_id", F.array_position("_roots", F.col("root")).cast("int") - 1).drop("_roots")


def checks(nodes: DataFrame) -> DataFrame:
    """One row a tree: n_components, single_root, bifurcate, bifurcate_with_root, sorted, cyclic.

    bifurcate: no node but the root has more than two children. sorted: every parent's id is smaller.
    cyclic: some way to the root never ends.
    """
    n = child_counts(nodes)
    top = climb(nodes, {})
    cyc = top.groupBy("tree_id").agg(F.bool_or(F.col("top").isNull()).alias("cyclic"))
    c = n.groupBy("tree_id").agg(
        F.sum(is_root().cast("long")).alias("n_components"),
        F.bool_and((F.col("n_children") <= 2) | is_root()).alias("bifurcate"),
        F.bool_and(F.col("n_children") <= 2).alias("bifurcate_with_root"),
        F.bool_and(is_root() | (F.col("id") > F.col("pid"))).alias("sorted"),
    )
    return c.join(cyc, "tree_id").withColumn("single_root", (F.col("n_components") == 1) & ~F.col("cyclic"))


def check_single_root(nodes: DataFrame) -> DataFrame:
    """nodes, but a tree that has not exactly one root raises."""
    n = nodes.groupBy("tree_id").agg(F.sum(is_root().cast("long")).alias("_n"))
    ok = F.assert_true(F.col("_n") == 1, F.concat(F.lit("a tree must have one root: "), F.col("tree_id").cast("string")))
    return nodes.join(n, "tree_id").where(ok.isNull()).select(*nodes.columns)


def neurites(nodes: DataFrame, types: tuple[int, ...] | None = None) -> DataFrame:
    """nodes but the root with neurite_id, the child of the root they descend from.

    With ``types`` only neurites whose first node has one of these types (dendrites: 3, 4).
    """
    n = with_parent(nodes, "pid", "type")
    first = F.when(F.col("p_pid") == -1, F.col("id"))
    w = climb(n, {"neurite_id": (first, "last")}, stop=F.col("p_pid") == -1, sizes=nodes)
    out = nodes.where(~is_root()).join(w.select("tree_id", "id", "neurite_id"), ["tree_id", "id"])
    if types is not None:
        heads = nodes.where(F.col("type").isin(*types)).select("tree_id", F.col("id").alias("neurite_id"))
        out = out.join(heads, ["tree_id", "neurite_id"], "left_semi")
    return out.select(*nodes.columns, "neurite_id")


def branches(nodes: DataFrame, degenerate: bool = False) -> DataFrame:
    """(tree_id, branch_id, pos, id, type, x, y, z, r): the unary chains between root, furcations and tips.

    A branch is named by its first node after its start; pos 0 is the start itself (the root or a
    furcation). With ``degenerate`` a root that has not exactly one child is a branch of one node, too.
    """
    n = cut(with_parent(child_counts(nodes), "n_children", "pid") if "n_children" in nodes.columns else with_parent(child_counts(nodes), "pid", "n_children"))
    head = ~is_root() & ((F.col("p_pid") == -1) | (F.col("p_n_children") > 1))
    w = climb(n.where(~is_root()).withColumn("_head", head), {"pos": (F.lit(1), "sum")}, stop=F.col("_head"))
    body = w.select("tree_id", F.col("top").alias("branch_id"), "pos", "id")
    start = n.where(head).select("tree_id", F.col("id").alias("branch_id"), F.lit(0).alias("pos"), F.col("pid").alias("id"))
    out = body.unionByName(start)
    if degenerate:
        alone = n.where(is_root() & (F.col("n_children") != 1))
        out = out.unionByName(alone.select("tree_id", F.col("id").alias("branch_id"), F.lit(0).alias("pos"), "id"))
    return out.join(unbroadcast(nodes.select("tree_id", "id", "type", "x", "y", "z", "r")), ["tree_id", "id"]).select("tree_id", "branch_id", "pos", "id", "type", "x", "y", "z", "r")


def ancestors(nodes: DataFrame, seeds: DataFrame) -> DataFrame:
    """(tree_id, id, steps, ancestor) of every node (tree_id, id) of ``seeds`` and every node above it, itself at 0 steps.

    Tables of the nodes 1, 2, 4, ... steps up are made first. From the longest jump down, each row that
    is there gives another one a jump further, so every ancestor is met once and no row holds a way.
    On a cycle the ways are as long as the tree has nodes at least.
    """
    kind = dict(nodes.dtypes)["id"]
    up = cut(nodes.where(~is_root()).select("tree_id", "id", F.col("pid").cast(kind).alias("up")).join(nodes.select("tree_id", F.col("id").alias("up")), ["tree_id", "up"], "left_semi").select("tree_id", "id", "up"))
    jumps, limit = [], None
    while not up.isEmpty():
        jumps.append(up)
        if len(jumps) == FREE_ROUNDS:
            limit = int(nodes.groupBy("tree_id").count().agg(F.max("count")).first()[0]).bit_length()
        if limit is not None and len(jumps) >= limit:
            break
        up = cut(up.join(up.select("tree_id", F.col("id").alias("up"), F.col("up").alias("_far")), ["tree_id", "up"]).select("tree_id", "id", F.col("_far").alias("up")))
    s = seeds.select("tree_id", "id").distinct().join(nodes.select("tree_id", "id"), ["tree_id", "id"], "left_semi")
    s = s.select("tree_id", "id", F.lit(0).cast("long").alias("steps"), F.col("id").alias("ancestor"))
    for k in reversed(range(len(jumps))):
        s = cut(s)
        far = jumps[k].select("tree_id", F.col("id").alias("ancestor"), "up")
        s = s.unionByName(s.join(far, ["tree_id", "ancestor"]).select("tree_id", "id", (F.col("steps") + (1 << k)).alias("steps"), F.col("up").alias("ancestor")))
    return s


def paths(nodes: DataFrame) -> DataFrame:
    """(tree_id, path_id, pos, id): the nodes from the root (pos 0) to every tip; path_id is the tip."""
    a = cut(ancestors(nodes, tips(nodes)))
    top = a.groupBy("tree_id", "id").agg(F.max("steps").alias("_top"))
    return a.join(top, ["tree_id", "id"]).select("tree_id", F.col("id").alias("path_id"), (F.col("_top") - F.col("steps")).cast("int").alias("pos"), F.col("ancestor").alias("id"))


def closure(nodes: DataFrame) -> DataFrame:
    """(tree_id, id, ancestor) of every node and every node above it, itself included."""
    return ancestors(nodes, nodes).select("tree_id", "id", "ancestor")


def subtree(nodes: DataFrame, starts: DataFrame) -> DataFrame:
    """nodes under the nodes (tree_id, id) of ``starts``, these included, with start, the nearest one above."""
    s = starts.select("tree_id", "id").distinct().withColumn("_start", F.lit(True))
    n = nodes.join(s, ["tree_id", "id"], "left")
    w = climb(n.drop("start"), {"start": (F.when(F.col("_start"), F.col("id")), "first")}, stop=F.col("_start"), carry=[c for c in nodes.columns if c != "start"], sizes=nodes)
    return w.where("start IS NOT NULL").select(*(c for c in nodes.columns if c != "start"), "start")


def contracted(nodes: DataFrame) -> DataFrame:
    """(tree_id, id, pid, branch_id, n_edges, length): the tree of root, furcations and tips.

    Every row is a branch: from its start (pid) to its end (id).
    """
    b = branches(nodes)
    ends = b.groupBy("tree_id", "branch_id").agg(F.max_by("id", "pos").alias("id"), F.min_by("id", "pos").alias("pid"), (F.count("*") - 1).alias("n_edges"))
    return ends.join(branch_lengths(b).select("tree_id", "branch_id", "length"), ["tree_id", "branch_id"])


def branch_lengths(branch_rows: DataFrame) -> DataFrame:
    """(tree_id, branch_id, length, straight, n_nodes) of rows of ``branches``.

    Neighbours meet by an equi-join on pos, so a very long branch is not sorted in one task.
    """
    a = branch_rows.select("tree_id", "branch_id", "pos", "x", "y", "z")
    b = a.select("tree_id", "branch_id", (F.col("pos") + 1).alias("pos"), *(F.col(c).alias(f"p_{c}") for c in "xyz"))
    step = a.join(unbroadcast(b), ["tree_id", "branch_id", "pos"], "left").withColumn("_d", F.coalesce(V.distance(V.vec(), V.vec("p_")), F.lit(0.0)))
    at = F.struct("x", "y", "z")
    g = step.groupBy("tree_id", "branch_id").agg(F.sum("_d").alias("length"), F.count("*").alias("n_nodes"), F.min_by(at, "pos").alias("_a"), F.max_by(at, "pos").alias("_b"))
    return g.select("tree_id", "branch_id", "length", V.distance(V.of(F.col("_a")), V.of(F.col("_b"))).alias("straight"), "n_nodes")


def tortuosity(straight: Column, length: Column) -> Column:
    """Straight distance over length; 1 where the length is 0."""
    return F.when(length == 0, 1.0).otherwise(F.try_divide(straight, length))
