"""Trees as edge and closure tables: nodes (sample_id, node_id, parent_id, ...), root: parent_id null.

All pairwise operators join within a sample, so their shuffles are on sample_id and a pair never crosses samples.
Distances are sparse: a pair that can't be reached has no row.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicket.schema import SPAN, UNREACHABLE
from thicket.session import grouped, written

S = "sample_id"
#: Pairs of nodes that a task makes.
PAIRS = 1 << 20


def preorder(rows: DataFrame, sample: str, path: list[str]) -> DataFrame:
    """rows with node_id: dense pre-order numbers of a sample by the columns of its path (nulls first: inner nodes)."""
    w = Window.partitionBy(sample).orderBy(*(F.col(c).asc_nulls_first() for c in path))
    return rows.withColumn("node_id", (F.row_number().over(w) - 1).cast("int"))


def closure(nodes: DataFrame, max_depth: int = 64) -> DataFrame:
    """(sample_id, ancestor, node, height) for each node and itself (0) and each of its ancestors.

    Path doubling: step k joins the ancestors known so far with themselves, so log2(max_depth) joins do. A tree with a node as many or more
    edges below its root raises an error: nothing is left out.
    """
    up = nodes.where("parent_id is not null").select(S, F.col("parent_id").alias("ancestor"), F.col("node_id").alias("node"), F.lit(1).alias("height"))
    known, reach = up, 1
    while reach < max_depth:
        low = known.select(S, F.col("ancestor").alias("mid"), "node", F.col("height").alias("h1"))
        high = known.select(S, F.col("ancestor"), F.col("node").alias("mid"), F.col("height").alias("h2"))
        longer = low.where(f"h1 = {reach}").join(high, [S, "mid"]).select(S, "ancestor", "node", (F.col("h1") + F.col("h2")).alias("height"))
        known, reach = known.unionByName(longer), reach * 2
    known = known.withColumn("height", F.when(F.col("height") < reach, F.col("height")).otherwise(F.raise_error(F.lit(f"a tree is {reach} or more edges deep: raise max_depth")).cast("int")))
    own = nodes.select(S, F.col("node_id").alias("ancestor"), F.col("node_id").alias("node"), F.lit(0).alias("height"))
    return own.unionByName(known)


def _no_row_limit(rows: DataFrame) -> None:
    """Recursive queries stop at a million rows unless told otherwise; here they end with the depth of the trees."""
    rows.sparkSession.conf.set("spark.sql.cteRecursionRowLimit", "-1")


def closure_recursive(nodes: DataFrame, max_depth: int = 100) -> DataFrame:
    """The same as a recursive query, for trees of unknown depth."""
    _no_row_limit(nodes)
    return nodes.sparkSession.sql(
        f"""with recursive up(sample_id, ancestor, node, height) max recursion level {max_depth} as (
        select sample_id, node_id, node_id, 0 from {{nodes}} union all
        select u.sample_id, n.parent_id, u.node, u.height + 1 from up u join {{nodes}} n on n.sample_id = u.sample_id and n.node_id = u.ancestor where n.parent_id is not null)
        select * from up""",
        nodes=nodes,
    )


def shortest_paths(up: DataFrame, threshold: int | None = None) -> DataFrame:
    """(sample_id, i, j, value): edges between two nodes of a tree, by their closest common ancestor: one row a pair, whose root
    paths are compared. Nodes whose depths differ by more than the threshold aren't compared."""
    paths = root_paths(up)
    a, b = paths.select(S, F.col("node").alias("i"), F.col("path").alias("a")), paths.select(S, F.col("node").alias("j"), F.col("path").alias("b"))
    both = a.join(b, S)
    if threshold is not None:
        both = both.where(F.abs(F.size("a") - F.size("b")) <= threshold)
    out = both.select(S, "i", "j", (F.size("a") + F.size("b") - 2 * common_prefix(F.col("a"), F.col("b"))).alias("value"))
    return out if threshold is None else out.where(F.col("value") <= threshold)


def directed(dist: DataFrame, forward: bool = True, backward: bool = True, threshold: int | None = None) -> DataFrame:
    """From one-way distances (i, j, value > 0): both ways antisymmetric, or one way; 0 on the diagonal is kept."""
    if threshold is not None:
        dist = dist.where(F.col("value") <= threshold)
    back = dist.where("value > 0").select(S, F.col("j").alias("i"), F.col("i").alias("j"), "value")
    if forward and backward:
        return dist.unionByName(back.withColumn("value", -F.col("value")))
    return dist if forward else dist.where("value = 0").unionByName(back)


def ancestor_distances(up: DataFrame, forward: bool = True, backward: bool = True, threshold: int | None = None) -> DataFrame:
    """+k where i is j's k-th ancestor, -k the other way."""
    return directed(up.select(S, F.col("ancestor").alias("i"), F.col("node").alias("j"), F.col("height").alias("value")), forward, backward, threshold)


def next_siblings(nodes: DataFrame) -> DataFrame:
    """(sample_id, node, next_node)."""
    w = Window.partitionBy(S, "parent_id").orderBy("node_id")
    out = nodes.where("parent_id is not null").select(S, F.col("node_id").alias("node"), F.lead("node_id").over(w).alias("next_node"))
    return out.where("next_node is not null")


def sibling_distances(nodes: DataFrame, forward: bool = True, backward: bool = True, threshold: int | None = None) -> DataFrame:
    """Difference of the ordinals of two children of one parent; 0 for every node and itself."""
    w = Window.partitionBy(S, "parent_id").orderBy("node_id")
    kids = nodes.where("parent_id is not null").select(S, "parent_id", "node_id", F.row_number().over(w).alias("k"))
    a, b = kids.select(S, "parent_id", F.col("node_id").alias("i"), F.col("k").alias("ki")), kids.select(S, "parent_id", F.col("node_id").alias("j"), F.col("k").alias("kj"))
    ahead = a.join(b, [S, "parent_id"]).where("kj > ki").select(S, "i", "j", (F.col("kj") - F.col("ki")).alias("value"))
    own = nodes.select(S, F.col("node_id").alias("i"), F.col("node_id").alias("j"), F.lit(0).alias("value"))
    return directed(own.unionByName(ahead), forward, backward, threshold)


def sequence_distances(tokens: DataFrame, pos: str = "pos") -> DataFrame:
    """j - i of all positions of a sample."""
    a, b = tokens.select(S, F.col(pos).alias("i")), tokens.select(S, F.col(pos).alias("j"))
    return a.join(b, S).select(S, "i", "j", (F.col("j") - F.col("i")).alias("value"))


def degrees(nodes: DataFrame) -> DataFrame:
    """Children of each node, 0 for leaves."""
    kids = nodes.where("parent_id is not null").groupBy(S, F.col("parent_id").alias("node_id")).agg(F.count("*").alias("n_children"))
    return nodes.select(S, "node_id").join(kids, [S, "node_id"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))


def normalized_adjacency(nodes: DataFrame) -> DataFrame:
    """D^-1/2 (A + I) D^-1/2 of the undirected tree with loops, as (sample_id, i, j, value)."""
    edges = nodes.where("parent_id is not null").select(S, F.col("parent_id").alias("i"), F.col("node_id").alias("j"))
    both = edges.unionByName(edges.select(S, F.col("j").alias("i"), F.col("i").alias("j"))).unionByName(nodes.select(S, F.col("node_id").alias("i"), F.col("node_id").alias("j")))
    deg = both.groupBy(S, "i").agg(F.count("*").alias("d"))
    out = both.join(deg, [S, "i"]).join(deg.select(S, F.col("i").alias("j"), F.col("d").alias("dj")), [S, "j"])
    return out.select(S, "i", "j", (1 / F.sqrt(F.col("d") * F.col("dj"))).alias("value"))


def prune(nodes: DataFrame, empty: str = "Empty") -> DataFrame:
    """Without childless nodes of the empty type; ids are dense again, parents follow."""
    kids = nodes.where("parent_id is not null").select(S, F.col("parent_id").alias("node_id")).distinct()
    leaves = nodes.where(F.col("node_type") == empty).join(kids, [S, "node_id"], "left_anti").where("parent_id is not null").select(S, "node_id")
    left = nodes.join(leaves, [S, "node_id"], "left_anti")
    ids = left.withColumn("new_id", (F.row_number().over(Window.partitionBy(S).orderBy("node_id")) - 1).cast("int"))
    parent = ids.select(S, F.col("node_id").alias("parent_id"), F.col("new_id").alias("new_parent"))
    return ids.join(parent, [S, "parent_id"], "left").select(S, F.col("new_id").alias("node_id"), F.col("new_parent").alias("parent_id"), "node_type")


def held_tokens(tokens: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs of tokens and the nodes whose span holds theirs, the root apart: (sample_id, token_idx, node_id, parent_id, size, place).

    tokens: token_idx, start, stop; nodes: node_id, parent_id, lo, hi, any positions that compare, and optionally size and child_idx. Tokens have ranks by where
    they start, and a running count over the ends of nodes and the starts of tokens tells each node the ranks that lie in it. So only pairs that overlap are
    made, from one sort of a sample, and never the product of its tokens and nodes.
    """
    size = F.col("size") if "size" in nodes.columns else F.col("hi") - F.col("lo")
    place = F.coalesce("child_idx", "node_id") if "child_idx" in nodes.columns else F.col("node_id")
    inner = nodes.where("parent_id is not null").select(S, "node_id", "parent_id", "lo", "hi", size.alias("size"), place.alias("place"))
    ranked = tokens.select(S, "token_idx", "start", "stop", F.row_number().over(Window.partitionBy(S).orderBy("start", "token_idx")).alias("rank"))
    none = F.lit(None).cast("int")
    marks = tokens.select(S, F.col("start").alias("at"), F.lit(1).alias("kind"), none.alias("node_id"))
    marks = marks.union(inner.select(S, "lo", F.lit(0), "node_id")).union(inner.select(S, "hi", F.lit(2), "node_id"))
    running = Window.partitionBy(S).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = marks.withColumn("seen", F.count_if(F.col("kind") == 1).over(running)).where("kind <> 1")
    ranges = seen.groupBy(S, "node_id").agg(F.min("seen").alias("before"), F.max("seen").alias("upto")).where("upto > before")
    ranges = ranges.select(S, "node_id", F.explode(F.sequence((F.col("before") + 1).cast("int"), F.col("upto").cast("int"))).alias("rank"))
    pairs = ranges.join(inner, [S, "node_id"]).join(ranked, [S, "rank"])
    return pairs.where("lo <= start and hi >= stop").select(S, "token_idx", "node_id", "parent_id", "size", "place")


def tightest_node(tokens: DataFrame, nodes: DataFrame) -> DataFrame:
    """(sample_id, token_idx, node_id): from the root downwards, always into the smallest child whose span holds the token's, the first one on ties,
    until none does. Where the spans of siblings are disjoint that is the smallest node of all.

    A token's winners among the children of each node are found first, apart from each other; the way down through
    them is a fold over the few nodes that hold the token.
    """
    held = held_tokens(tokens, nodes)
    winners = held.groupBy(S, "token_idx", "parent_id").agg(F.min_by("node_id", F.struct("size", "place")).alias("node_id"))
    ways = winners.groupBy(S, "token_idx").agg(F.map_from_entries(F.collect_list(F.struct("parent_id", "node_id"))).alias("into"))
    root = nodes.where("parent_id is null").groupBy(S).agg(F.min("node_id").alias("root"))
    rows = tokens.select(S, "token_idx").join(root, S).join(ways, [S, "token_idx"], "left")
    down = F.aggregate(F.sequence(F.lit(1), F.size("into")), F.col("root"), lambda at, _: F.coalesce(F.try_element_at("into", at), at))
    return rows.select(S, "token_idx", F.when(F.col("into").isNull(), F.col("root")).otherwise(down).alias("node_id"))


def descents(samples: DataFrame) -> DataFrame:
    """(sample_id, token_idx, node_id) as of `tightest_node`, for whole samples: a row each, with tokens (array of token_idx, start, stop) and nodes (array of node_id, parent_id, place,
    lo, hi, lines, cols), whose positions are whole numbers. A row holds all that the way down needs, so no pair of a token and a node is a row."""

    def run(batches):
        for batch in batches:
            out = []
            for sample, tokens, nodes in zip(*(batch.column(c) for c in (S, "tokens", "nodes")), strict=True):
                roots = [n["node_id"] for n in nodes.as_py() if n["parent_id"] is None]
                if not roots or not len(tokens.values):
                    continue
                token_idx = tokens.values.field("token_idx")
                start, stop = (np.asarray(tokens.values.field(c).fill_null(NOWHERE)) for c in ("start", "stop"))
                found = _descent(start, stop, nodes.as_py(), min(roots))
                out.append(pa.RecordBatch.from_arrays([pa.array(np.full(len(found), sample.as_py(), np.int64)), token_idx.cast(pa.int32()), pa.array(found, pa.int32())], names=[S, "token_idx", "node_id"]))
            if out:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    return samples.mapInArrow(run, f"{S} bigint, token_idx int, node_id int")


#: A position that no span holds.
NOWHERE = np.iinfo(np.int64).min


def _descent(start: np.ndarray, stop: np.ndarray, nodes: list[dict], root: int) -> np.ndarray:
    """The node in which the way down ends for each token: from node to node, always the smallest child that holds the token, the first one on ties."""
    kids: dict[int, list[dict]] = {}
    for n in nodes:
        if None not in (n["parent_id"], n["lo"], n["hi"]):
            kids.setdefault(n["parent_id"], []).append(n)
    out, left = np.full(len(start), root, np.int64), [(root, np.flatnonzero(np.minimum(start, stop) > NOWHERE))]
    for _ in range(len(nodes)):
        deeper = []
        for node, at in left:
            if len(at) and node in kids:
                deeper += _into(start[at], stop[at], kids[node], at)
        for node, at in deeper:
            out[at] = node
        left = deeper
        if not left:
            break
    return out


def _into(start: np.ndarray, stop: np.ndarray, kids: list[dict], at: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """The child that each token goes into, if one holds it: (node, places of tokens)."""
    kids = sorted(kids, key=lambda n: (n["lo"], n["hi"]))
    lo, hi = (np.array([n[c] for n in kids], np.int64) for c in ("lo", "hi"))
    if (hi[:-1] < lo[1:]).all():  # apart from each other: the last that begins before the token
        k = np.searchsorted(lo, start, "right") - 1
        k = np.where((k >= 0) & (hi[k] >= stop), k, -1)
    else:
        k = np.full(len(start), -1)
        for best in sorted(range(len(kids)), key=lambda x: (kids[x]["lines"], kids[x]["cols"], kids[x]["place"]), reverse=True):
            k[(lo[best] <= start) & (hi[best] >= stop)] = best
    return [(kids[x]["node_id"], at[k == x]) for x in np.unique(k) if x >= 0]


def best_tokens(tokens: DataFrame, token_map: DataFrame) -> DataFrame:
    """For each node, of the tokens mapped to it: one that isn't special, with most sub-tokens, the longest first sub-token, then the first."""
    rank = F.row_number().over(Window.partitionBy(S, "node_id").orderBy("special", F.size("sub_tokens").desc(), F.length(F.element_at("sub_tokens", 1)).desc(), "token_idx"))
    return token_map.join(tokens, [S, "token_idx"]).withColumn("rank", rank).where("rank = 1").drop("rank")


def tokens_of_nodes(token_map: DataFrame) -> DataFrame:
    """The inverse of a token map: the tokens of each node, in order."""
    return token_map.groupBy(S, "node_id").agg(F.array_sort(F.collect_list("token_idx")).alias("tokens"))


def reindexed(matrix: DataFrame, token_map: DataFrame) -> DataFrame:
    """Rows and columns of a node matrix repeated for the tokens that are mapped to them."""
    i, j = token_map.select(S, F.col("node_id").alias("i"), F.col("token_idx").alias("ti")), token_map.select(S, F.col("node_id").alias("j"), F.col("token_idx").alias("tj"))
    return matrix.join(i, [S, "i"]).join(j, [S, "j"]).select(S, F.col("ti").alias("i"), F.col("tj").alias("j"), "value")


def submatrix(matrix: DataFrame, kept: DataFrame, pos: str = "pos") -> DataFrame:
    """The kept positions of a matrix, numbered anew in their order."""
    ids = kept.select(S, F.col(pos), (F.row_number().over(Window.partitionBy(S).orderBy(pos)) - 1).cast("int").alias("new"))
    out = matrix.join(ids.select(S, F.col(pos).alias("i"), F.col("new").alias("ni")), [S, "i"]).join(ids.select(S, F.col(pos).alias("j"), F.col("new").alias("nj")), [S, "j"])
    return out.select(S, F.col("ni").alias("i"), F.col("nj").alias("j"), "value")


def edge_types(dist: DataFrame) -> DataFrame:
    """Typed edges from distances (metric, i, j, value): parents, children, next and previous siblings, neighbours."""
    kind = (
        F.when((F.col("metric") == "ancestor_sp") & (F.col("value") == 1), "child")
        .when((F.col("metric") == "ancestor_sp") & (F.col("value") == -1), "parent")
        .when((F.col("metric") == "sibling_sp") & (F.col("value") == 1), "next_sibling")
        .when((F.col("metric") == "sibling_sp") & (F.col("value") == -1), "previous_sibling")
        .when((F.col("metric") == "shortest_paths") & (F.col("value") == 1), "neighbour")
    )
    return dist.select(S, kind.alias("edge_type"), F.col("i").alias("src"), F.col("j").alias("dst")).where("edge_type is not null")


def too_far(dist: DataFrame, limits: dict[str, int], every: bool = False) -> DataFrame:
    """(sample_id, i, j, masked): whether any (or every) limited metric is above its limit; -1 leaves a metric out."""
    limit = F.create_map(*(x for m, v in limits.items() for x in (F.lit(m), F.lit(v))))
    flags = dist.withColumn("limit", F.try_element_at(limit, F.col("metric"))).where("limit >= 0").withColumn("far", F.abs("value") > F.col("limit"))
    return flags.groupBy(S, "i", "j").agg((F.bool_and("far") if every else F.bool_or("far")).alias("masked"))


def far_pairs(nodes: DataFrame, limits: dict[str, int], every: bool = False, max_depth: int = 64) -> DataFrame:
    """`too_far` of the ancestor_sp, sibling_sp and shortest_paths of trees, without a table of distances: a pair of nodes is made once, where its root paths and
    places among siblings tell every metric, so pairs are neither shuffled nor grouped, and there are as many tasks as they want."""
    n = written(nodes.select(S, "node_id", "parent_id"), "tree-nodes")
    pairs = n.groupBy(S).agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0
    paths = root_paths(closure(n, max_depth)).withColumnRenamed("node", "node_id").join(child_number(n, 2**31 - 1), [S, "node_id"], "left").repartition(max(1, -(-pairs // PAIRS)), S)
    a, b = (paths.select(S, F.col("node_id").alias(c), F.struct("path", "child_no").alias(f"of_{c}")) for c in "ij")
    (pa, pb), (ka, kb) = ((F.col("of_i")[c], F.col("of_j")[c]) for c in ("path", "child_no"))
    common, longest = common_prefix(pa, pb), F.greatest(F.size(pa), F.size(pb))
    edges = F.size(pa) + F.size(pb) - 2 * common
    siblings = (F.size(pa) == F.size(pb)) & (common >= F.size(pa) - 1)
    values = {
        "ancestor_sp": F.when(common == F.least(F.size(pa), F.size(pb)), longest - common),
        "sibling_sp": F.when(F.col("i") == F.col("j"), 0).when(siblings, F.abs(ka - kb)),
        "shortest_paths": edges,
    }
    far = [values[m] > limit for m, limit in limits.items() if limit >= 0]
    told = reduce(or_, (x.isNotNull() for x in far), F.lit(False))
    masked = reduce(and_, (F.coalesce(x, F.lit(True)) for x in far), F.lit(True)) if every else reduce(or_, (F.coalesce(x, F.lit(False)) for x in far), F.lit(False))
    return a.hint("merge").join(b, S).where(told).select(S, "i", "j", masked.alias("masked"))


def hop_distances(edges: DataFrame, cutoff: int) -> DataFrame:
    """All-pairs shortest paths of a graph with unit weights up to a cutoff: (sample_id, i, j, value)."""
    nodes = edges.select(S, F.explode(F.array("i", "j")).alias("i")).distinct()
    best = nodes.select(S, "i", F.col("i").alias("j"), F.lit(0).alias("value"))
    front = best
    step = edges.select(S, F.col("i").alias("j"), F.col("j").alias("k"))
    for k in range(1, cutoff + 1):
        front = front.join(step, [S, "j"]).select(S, "i", F.col("k").alias("j"), F.lit(k).alias("value")).distinct()
        best = best.unionByName(front).groupBy(S, "i", "j").agg(F.min("value").alias("value"))
    return best


def pagerank_matrix(adjacency: np.ndarray, alpha: float = 0.15, log: bool = True, threshold: float | None = None) -> np.ndarray:
    """Personalised PageRank of every seed (a column each), or its negative logarithm; weak ones are unreachable."""
    degree = adjacency.sum(axis=1)
    walk = adjacency.T * np.divide(1.0, degree, out=np.zeros(len(degree)), where=degree > 0)
    p = alpha * np.linalg.inv(np.eye(len(degree)) - (1 - alpha) * walk)
    if not log:
        return p if threshold is None else np.where(p < threshold, 0, p)
    d = -np.log(p + 1e-9)
    return d if threshold is None else np.where(d > -np.log(threshold), UNREACHABLE, d)


def pagerank_distances(nodes: DataFrame, alpha: float = 0.15, log: bool = True, threshold: float | None = None, parts: int | None = None) -> DataFrame:
    """(sample_id, i, j, value). A sample's tree is one small matrix, so each is solved on its own in numpy. parts: tasks, where the caller knows
    what they have to do."""

    def run(table: pa.Table) -> pa.Table:
        found = sorted(zip(table["node_id"].to_pylist(), table["parent_id"].to_pylist(), strict=True), key=lambda x: x[0])
        at = {n: k for k, (n, _) in enumerate(found)}
        a = np.zeros((len(at), len(at)))
        for node, parent in found:
            if parent is not None:
                a[at[node], at[parent]] = a[at[parent], at[node]] = 1
        p = pagerank_matrix(a, alpha, log, threshold)
        ids = np.array([n for n, _ in found], np.int32)
        sample = pa.array(np.full(p.size, table[S][0].as_py(), np.int64))
        return pa.table({S: sample, "i": np.repeat(ids, len(ids)), "j": np.tile(ids, len(ids)), "value": p.ravel()})

    rows = nodes.select(F.col(S).cast("bigint").alias(S), "node_id", "parent_id")
    return grouped(rows, [S], run, f"{S} bigint, i int, j int, value double", parts)


def child_number(nodes: DataFrame, most: int = 3) -> DataFrame:
    """Ordinal among its siblings from 0, saturated at `most`."""
    k = F.row_number().over(Window.partitionBy(S, "parent_id").orderBy("node_id")) - 1
    return nodes.where("parent_id is not null").select(S, "node_id", F.least(k, F.lit(most)).cast("int").alias("child_no"))


def root_paths(up: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(sample_id, node, path): the nodes from the root to each node; with nodes, also their types, in the same order."""
    if nodes is None:
        return up.groupBy(S, "node").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("height")).alias("h"), "ancestor"))), lambda x: x["ancestor"]).alias("path"))
    typed = up.join(nodes.select(S, F.col("node_id").alias("ancestor"), "node_type"), [S, "ancestor"])
    steps = typed.groupBy(S, "node").agg(F.array_sort(F.collect_list(F.struct((-F.col("height")).alias("h"), "ancestor", "node_type"))).alias("x"))
    return steps.select(S, "node", F.col("x.ancestor").alias("path"), F.col("x.node_type").alias("types"))


def surroundings(up: DataFrame, nodes: DataFrame) -> DataFrame:
    """(sample_id, node, n_ancestors, n_descendants, n_leaves): how many nodes are above and below a node, and leaves below it
    (itself, if it is one)."""
    leaf = degrees(nodes).select(S, F.col("node_id").alias("node"), (F.col("n_children") == 0).alias("leaf"))
    known = up.join(leaf, [S, "node"])
    below = known.groupBy(S, F.col("ancestor").alias("node")).agg((F.count("*") - 1).alias("n_descendants"), F.count_if("leaf").alias("n_leaves"))
    above = up.groupBy(S, "node").agg((F.count("*") - 1).alias("n_ancestors"))
    return above.join(below, [S, "node"]).select(S, "node", "n_ancestors", "n_descendants", "n_leaves")


def dot(nodes: DataFrame) -> DataFrame:
    """(sample_id, dot): each tree as a graph in the DOT language, for viewing; one text a tree, whose size the token limit bounds."""
    line = F.concat(F.lit("  n"), F.col("node_id"), F.lit(' [label="'), F.replace("node_type", F.lit('"'), F.lit("'")), F.lit('"];'))
    edge = F.when(F.col("parent_id").isNotNull(), F.concat(F.lit("\n  n"), F.col("parent_id"), F.lit(" -> n"), F.col("node_id"), F.lit(";"))).otherwise("")
    rows = nodes.groupBy(S).agg(F.array_sort(F.collect_list(F.struct("node_id", F.concat(line, edge).alias("text")))).alias("x"))
    return rows.select(S, F.concat(F.lit("digraph {\n"), F.array_join("x.text", "\n"), F.lit("\n}")).alias("dot"))


#: Distance metrics by name: functions of nodes that give (sample_id, i, j, value). Further ones can be added.
DISTANCES: dict = {
    "ancestor_sp": lambda nodes: ancestor_distances(closure(nodes, 64)),
    "sibling_sp": lambda nodes: sibling_distances(nodes),
    "shortest_paths": lambda nodes: shortest_paths(closure(nodes, 64)),
    "ppr": lambda nodes: pagerank_distances(nodes, threshold=2.718281828459045**-5),
}


def distance(name: str):
    """Registers a distance metric under a name."""

    def add(f):
        if name in DISTANCES:
            raise ValueError(f"two distances are named {name}")
        DISTANCES[name] = f
        return f

    return add


def distances_of(nodes: DataFrame, *names: str) -> DataFrame:
    """(sample_id, metric, i, j, value) of the named metrics."""
    out = None
    for name in names:
        rows = DISTANCES[name](nodes).select(S, F.lit(name).alias("metric"), "i", "j", F.col("value").cast("double").alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out


def common_prefix(v: Column, u: Column) -> Column:
    """Length of the common prefix of two root paths."""
    same = F.zip_with(v, u, lambda a, b: F.coalesce(a == b, F.lit(False)))
    return F.coalesce(F.nullif(F.array_position(same, F.lit(False)), F.lit(0)) - 1, F.size(same)).cast("int")


def from_vertices(files: DataFrame, json: str = "ast") -> DataFrame:
    """Nodes of the vertex/edge dialect: node ids are vertex numbers; children follow from the edges."""
    schema = (
        "files array<struct<path: string, vertices: array<struct<vertexId: bigint, term: string, span: struct<start: struct<line: int, column: int>, end: struct<line: int, column: int>>>>,"
        " edges: array<struct<source: bigint, target: bigint>>, errors: array<struct<error: string>>>>"
    )
    file = F.from_json(json, schema)["files"][0]
    good = files.select(S, file.alias("f")).where((F.coalesce(F.size("f.errors"), F.lit(0)) <= 0) & ~F.exists("f.vertices", lambda v: v["term"] == "Error"))
    vertices = good.select(S, F.posexplode("f.vertices").alias("node_id", "v")).select(S, "node_id", "v.vertexId", F.col("v.term").alias("node_type"), F.col("v.span").cast(SPAN).alias("span"))
    edges = good.select(S, F.posexplode("f.edges").alias("k", "e")).select(S, "k", "e.source", "e.target")
    ids = vertices.select(S, F.col("vertexId"), "node_id")
    parents = edges.join(ids.select(S, F.col("vertexId").alias("source"), F.col("node_id").alias("parent_id")), [S, "source"]).join(ids.select(S, F.col("vertexId").alias("target"), "node_id"), [S, "target"])
    order = F.row_number().over(Window.partitionBy(S, "parent_id").orderBy("k")) - 1
    parents = parents.select(S, "node_id", "parent_id", order.cast("int").alias("child_idx"))
    return vertices.join(parents, [S, "node_id"], "left").select(S, "node_id", "parent_id", "child_idx", "node_type", "span")


def from_nested(files: DataFrame, json: str = "ast", max_depth: int = 60) -> DataFrame:
    """Nodes of the recursive dialect (type, childNodes), numbered in pre-order, by a recursive query over variants."""
    _no_row_limit(files)
    out = files.sparkSession.sql(
        f"""with recursive t(sample_id, v, path) max recursion level {max_depth} as (
        select sample_id, parse_json({json}), cast(array() as array<int>) from {{files}} union all
        select t.sample_id, c.value, concat(t.path, array(c.pos)) from t, lateral variant_explode(variant_get(t.v, '$.childNodes', 'variant')) c)
        select sample_id, path, variant_get(v, '$.type', 'string') as node_type from t""",
        files=files,
    )
    ids = out.withColumn("node_id", (F.row_number().over(Window.partitionBy(S).orderBy("path")) - 1).cast("int"))
    parents = ids.select(S, F.col("path").alias("ppath"), F.col("node_id").alias("parent_id"))
    up = ids.withColumn("ppath", F.when(F.size("path") > 0, F.slice("path", F.lit(1), F.size("path") - 1)))
    return up.join(parents, [S, "ppath"], "left").select(S, "node_id", "parent_id", F.try_element_at("path", F.lit(-1)).alias("child_idx"), "node_type")
