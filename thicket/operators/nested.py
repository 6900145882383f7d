"""Nested sets: every node of a tree as an interval of pre-order numbers, and path contexts of all functions by it.

A file's tree is one row, as in files of trees: an array of nodes with the numbers of their children. `index` numbers the nodes of all trees
of a batch at once, level by level, without a shuffle: a node's descendants are the numbers from its own to `last`, so whether one
node is inside another is a comparison. Each node also has the way up as far as a path can reach, and the functions
around it, so that a tree gives a sample for each of its functions, and nodes of inner functions are in several.

Pairs of leaves meet at their closest common ancestor: each leaf goes to its ancestors within reach, and those of different
branches are joined there. So only pairs within reach are ever made, once for all functions around them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicket.functions.text import LEGAL_IDENTIFIER, chunks, path_name, split_name_unless_empty, split_to_subtokens
from thicket.operators.paths import is_identifier, is_number
from thicket.schema import MAX_PATH_LENGTH, MAX_PATH_WIDTH
from thicket.session import ship, written

S = "sample_id"
NODES = "array<struct<type: string, value: string, children: array<int>>>"
# Node types of methods and of their names, by language.
METHOD_TYPES = {
    "python": (("Function", "Method"), "Identifier"),
    "go": (("Function", "Method"), "Identifier"),
    "ruby": (("Function", "Method"), "Identifier"),
    "javascript": (("Function", "Method"), "Identifier"),
    "java-small": (("MethodDeclaration",), "SimpleName"),
}
# Texts that stand for a method's name and for numbers.
METHOD_NAME, NUM = "METHODNAME", "NUM"
# Of the C# flavour, the types whose children show their place, the name that is masked, and the types of leaves, comments and methods.
NUMBERED_CS = ("SimpleAssignmentExpression", "ElementAccessExpression", "SimpleMemberAccessExpression", "InvocationExpression", "BracketedArgumentList", "ArgumentList")
METHOD_NAME_CS, METHOD_CS, COMMENT = "METHOD_NAME", "MethodDeclaration", "Comment"
TOKENS_CS = ("IdentifierToken", "NumericLiteralToken", "StringLiteralToken", "CharacterLiteralToken")


#: Rows of a side of the join of leaves that a task sorts.
PAIRED = 500_000


@dataclass
class Numbers:
    """Of all nodes of a batch: parent (-1: a root), depth, pre-order number within the tree, the last one below it, and place among siblings."""

    parent: np.ndarray
    depth: np.ndarray
    pre: np.ndarray
    last: np.ndarray
    child_no: np.ndarray


def numbers(n: int, owner: np.ndarray, child: np.ndarray) -> Numbers:
    """n nodes; owner[k] has child[k], in the order of children. All of a level at once."""
    parent, child_no = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    parent[child] = owner
    if len(child):
        fresh = np.concatenate([[True], owner[1:] != owner[:-1]])
        begins = np.flatnonzero(fresh)
        child_no[child] = np.arange(len(child)) - begins[np.cumsum(fresh) - 1]
    levels, depth = [np.flatnonzero(parent < 0)], np.zeros(n, np.int64)
    order = np.lexsort((child_no, parent))
    kids = np.bincount(parent[parent >= 0], minlength=n)
    start = np.cumsum(kids) - kids + int((parent < 0).sum())  # where a node's children begin in `order`
    while len(levels[-1]):
        at = levels[-1]
        total = int(kids[at].sum())
        if len(levels) > n:
            raise ValueError("a node is its own ancestor")
        within = np.arange(total) - np.repeat(np.cumsum(kids[at]) - kids[at], kids[at])
        levels.append(order[np.repeat(start[at], kids[at]) + within])
        depth[levels[-1]] = len(levels) - 1
    size = np.ones(n, np.int64)
    for level in reversed(levels[1:]):
        np.add.at(size, parent[level], size[level])
    pre = np.zeros(n, np.int64)
    for level in levels[1:]:
        if len(level):  # siblings stand together: those before a node push it on
            done = np.cumsum(size[level]) - size[level]
            first = np.concatenate([[True], parent[level][1:] != parent[level][:-1]])
            pre[level] = pre[parent[level]] + 1 + done - done[np.flatnonzero(first)][np.cumsum(first) - 1]
    return Numbers(parent, depth, pre, pre + size - 1, child_no)


def places(x: Numbers, token: np.ndarray) -> np.ndarray:
    """The place of each node among its siblings, tokens not counted (a token has that of the next node)."""
    if not token.any():
        return x.child_no
    order = np.lexsort((x.child_no, x.parent))
    counted = np.concatenate([[0], np.cumsum(~token[order])])[:-1]
    first = np.concatenate([[True], x.parent[order][1:] != x.parent[order][:-1]])
    out = np.zeros(len(token), np.int64)
    out[order] = counted - counted[np.flatnonzero(first)][np.cumsum(first) - 1]
    return out


def _lists(columns: list[np.ndarray], values: pa.Array | None = None) -> pa.Array:
    """Lists of the columns' entries (-1: none) of each row, or of the values with these numbers."""
    matrix = np.stack(columns, axis=1)
    there = matrix >= 0
    offsets = pa.array(np.concatenate([[0], np.cumsum(there.sum(axis=1))]), pa.int32())
    flat = matrix[there]
    return pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()) if values is None else values.take(pa.array(flat)))


def index(trees: DataFrame, functions: Sequence[str], reach: int = MAX_PATH_LENGTH, nodes: str = "nodes", leaves: Sequence[str] = (), numbered: Sequence[str] = (), most: int = 3) -> DataFrame:
    """Nodes of (sample_id, nodes): node_id (place in the array), parent_id, pre, last, depth, child_no, node_type, value, `ups` and
    `types` (pre-order numbers and types from the node upwards, `reach` at most), and `fns` (functions around it, innermost first).

    functions: types of function nodes. leaves: types of tokens, which have no place among the children of a node. numbered: types whose children show their
    place, at most `most`, behind their type in `types`. A null or empty array is a tree without nodes; nodes that no other one names are roots. A node
    that two name is the latter's child.
    """

    def run(batches):
        for batch in batches:
            lists = batch.column(1).fill_null([]) if batch.column(1).null_count else batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            n = len(flat)
            tree = np.repeat(np.arange(batch.num_rows), sizes)
            base = np.repeat(np.cumsum(sizes) - sizes, sizes)
            types, values, children = (flat.field(k) for k in ("type", "value", "children"))
            children = children.fill_null([]) if children.null_count else children
            n_kids = np.diff(children.offsets.to_numpy())
            owner = np.repeat(np.arange(n), n_kids)
            child = children.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + base[owner]
            x = numbers(n, owner, child)
            kinds = types.to_numpy(zero_copy_only=False)
            token = np.isin(kinds, leaves)
            place_no = places(x, token)
            labels = types
            if numbered:
                shows = (x.parent >= 0) & np.isin(kinds[x.parent], numbered)
                labels = pa.array([f"{t}{min(k, most)}" if s else t for t, k, s in zip(kinds.tolist(), place_no.tolist(), shows.tolist(), strict=True)], pa.string())
            function = np.isin(kinds, functions)
            ups, at = [], np.arange(n)
            for _ in range(reach):
                ups.append(at)
                at = np.where(at >= 0, x.parent[at], -1)
            # the function around a node: itself, or what is around its parent
            around = np.where(function, np.arange(n), -1)
            for level in range(1, int(x.depth.max(initial=0)) + 1):
                rows = np.flatnonzero((x.depth == level) & ~function)
                around[rows] = around[x.parent[rows]]
            fns, at = [], around
            while True:
                fns.append(at)
                if not (at >= 0).any():
                    break
                above = np.where(at >= 0, x.parent[at], -1)
                at = np.where(above >= 0, around[above], -1)
            shown = lambda columns: [np.where(c >= 0, x.pre[c], -1) for c in columns]
            ints = lambda a: pa.array(a, pa.int32())
            place = np.arange(n) - base
            parent = pa.array(np.where(x.parent >= 0, x.parent - base, 0), pa.int32(), mask=x.parent < 0)
            out = [batch.column(0).take(pa.array(tree)), ints(place), parent, ints(x.pre), ints(x.last), ints(x.depth), ints(place_no), types, values, _lists(shown(ups)), _lists(ups, labels), _lists(shown(fns))]
            for k in range(0, n, 5000):
                yield pa.RecordBatch.from_arrays([c.slice(k, 5000) for c in out], names=[S, "node_id", "parent_id", "pre", "last", "depth", "child_no", "node_type", "value", "ups", "types", "fns"])

    ship(trees.sparkSession)
    rows = trees.select(F.col(S).cast("bigint").alias(S), F.col(nodes).cast(NODES).alias("nodes"))
    return rows.mapInArrow(run, f"{S} bigint, node_id int, parent_id int, pre int, last int, depth int, child_no int, node_type string, value string, ups array<int>, types array<string>, fns array<int>")


def from_json(files: DataFrame, line: str = "value") -> DataFrame:
    """Trees of text lines, each an array of nodes (type, value, children)."""
    return files.withColumn("nodes", F.from_json(line, NODES)).drop(line)


def leaf_pairs(leaves: DataFrame, max_length: int = MAX_PATH_LENGTH, max_width: int = MAX_PATH_WIDTH) -> DataFrame:
    """(sample_id, lca, v, u, start, finish, steps, fns) of the pairs of leaves whose way is short and even enough. leaves: nodes of
    `index` with a column `shown`; steps: the types on the way; fns: the functions that hold the whole way."""
    up = leaves.where(F.col("shown").isNotNull()).select(S, "pre", "shown", "types", "ups", "fns", F.posexplode(F.slice("ups", 1, max_length)).alias("far", "lca"))
    branch = F.when(F.col("far") == 0, F.col("lca")).otherwise(F.element_at("ups", F.greatest(F.col("far"), F.lit(1))))
    up = up.select(S, "lca", "pre", "shown", "types", "fns", "far", branch.alias("branch"))
    # as many tasks as the rows want: a side's rows are wide, and a task sorts both
    n = max(1, -(-leaves.where(F.col("shown").isNotNull()).count() * max_length // PAIRED))
    up = up.repartition(n, S, "lca")
    a = up.select(S, "lca", F.col("pre").alias("v"), F.col("shown").alias("start"), F.col("types").alias("vt"), "fns", F.col("far").alias("vf"), F.col("branch").alias("vb"))
    b = up.select(S, "lca", F.col("pre").alias("u"), F.col("shown").alias("finish"), F.col("types").alias("ut"), F.col("far").alias("uf"), F.col("branch").alias("ub"))
    both = a.join(b, [S, "lca"]).where((F.col("vb") < F.col("ub")) & (F.col("vf") + F.col("uf") + 1 <= max_length) & (F.abs(F.col("vf") - F.col("uf")) <= max_width))
    steps = F.concat(F.slice("vt", F.lit(1), F.col("vf") + 1), F.reverse(F.slice("ut", F.lit(1), F.col("uf"))))
    return both.select(S, "lca", "v", "u", "start", "finish", steps.alias("steps"), F.filter("fns", lambda f: f <= F.col("lca")).alias("fns"))


def name_pairs(leaves: DataFrame, max_length: int = MAX_PATH_LENGTH, max_width: int = MAX_PATH_WIDTH) -> DataFrame:
    """The same for pairs of a function's own node, which shows its name if it has one, and a leaf below it."""
    rows = leaves.where(F.col("shown").isNotNull()).select(S, "pre", "shown", "types", "ups", F.explode("fns").alias("f"))
    rows = rows.join(leaves.where(F.col("value").isNotNull()).select(S, F.col("pre").alias("f")), [S, "f"], "left_semi")
    rows = rows.withColumn("far", F.array_position("ups", F.col("f")).cast("int") - 1).where((F.col("far") > 0) & (F.col("far") < max_length) & (F.col("far") <= max_width))
    return rows.select(S, F.col("f").alias("lca"), F.col("f").alias("v"), F.col("pre").alias("u"), F.lit(METHOD_NAME).alias("start"), F.col("shown").alias("finish"), F.reverse(F.slice("types", F.lit(1), F.col("far") + 1)).alias("steps"), F.array("f").alias("fns"))


def _context() -> Column:
    return F.concat_ws(",", path_name(F.col("start")), F.array_join("steps", "|"), path_name(F.col("finish")))


def _lines(contexts: DataFrame, targets: DataFrame) -> DataFrame:
    """(sample_id, fn, value): the name and all contexts, one line a function; functions without a context have none."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("v", "u", "context"))), lambda x: x["context"]), " ")
    return contexts.groupBy(S, "fn").agg(joined.alias("contexts")).join(targets, [S, "fn"]).select(S, "fn", F.concat_ws(" ", path_name(F.col("target")), "contexts").alias("value"))


def function_contexts(trees: DataFrame, function: str = "FunctionDef", max_length: int = MAX_PATH_LENGTH, max_width: int = MAX_PATH_WIDTH, method_name: bool = True, nums: bool = True) -> DataFrame:
    """(sample_id, fn, context, v, u) of every function of every tree, inner ones too: leaves are the nodes whose type begins with Name, shown by
    their value, and Num; the function's own node shows METHODNAME. fn, v and u are pre-order numbers."""
    nodes = index(trees, [function], max_length)
    shown = F.when(F.col("node_type").startswith("Name"), F.col("value"))
    if nums:
        shown = F.when(F.col("value").isNotNull() & (F.col("node_type") == "Num"), F.lit(NUM)).otherwise(shown)
    # both sides of the pairs, and the names, read the numbered nodes: they are numbered once
    leaves = written(nodes.withColumn("shown", shown).where(F.col("shown").isNotNull() | ((F.col("node_type") == function) & F.col("value").isNotNull())).select(S, "pre", "value", "ups", "types", "fns", "shown"), "leaves")
    pairs = leaf_pairs(leaves, max_length, max_width)
    if method_name:
        pairs = pairs.unionByName(name_pairs(leaves, max_length, max_width))
    return pairs.select(S, F.explode("fns").alias("fn"), _context().alias("context"), "v", "u")


def function_lines(trees: DataFrame, function: str = "FunctionDef", **limits) -> DataFrame:
    """(sample_id, fn, value): one text line for each function with a context."""
    named = index(trees, [function], 1).where(F.col("node_type") == function).select(S, F.col("pre").alias("fn"), F.col("value").alias("target"))
    return _lines(function_contexts(trees, function, **limits), named)


def functions(trees: DataFrame, function: str = "FunctionDef") -> DataFrame:
    """(sample_id, fn, name, n_nodes, inside): every function, the nodes it holds and the functions around it."""
    rows = index(trees, [function], 1).where(F.col("node_type") == function)
    return rows.select(S, F.col("pre").alias("fn"), F.col("value").alias("name"), (F.col("last") - F.col("pre") + 1).alias("n_nodes"), (F.size("fns") - 1).alias("inside"))


def located(nodes: DataFrame, language: str, names: DataFrame | None = None) -> DataFrame:
    """(sample_id, method, last, name_node, target): the first method node of a tree, and the first node with a name at or behind it. names:
    (sample_id, func_name) that the name node has to show; samples with an empty one, without a method or without that node have no row."""
    kinds, name_kind = METHOD_TYPES[language]
    first = nodes.where(F.col("node_type").isin(*kinds)).groupBy(S).agg(F.min(F.struct("pre", "last")).alias("m")).select(S, F.col("m.pre").alias("method"), "m.last")
    called = nodes.where(F.col("node_type") == name_kind).select(S, "pre", "value")
    if names is not None:
        called = called.join(names.where("func_name <> ''"), S).where(F.col("value") == F.col("func_name")).drop("func_name")
    found = first.join(called, S).where("pre >= method").groupBy(S, "method", "last").agg(F.min(F.struct("pre", "value")).alias("n"))
    return found.select(S, "method", "last", F.col("n.pre").alias("name_node"), F.col("n.value").alias("target"))


def method_lines(trees: DataFrame, language: str, names: DataFrame | None = None, max_length: int = MAX_PATH_LENGTH, max_width: int = MAX_PATH_WIDTH) -> DataFrame:
    """(sample_id, fn, value): the contexts of the first method of each tree. The name's node shows METHODNAME, identifiers and numbers
    as the language has them; a sample with an identifier of illegal characters, or without contexts, has no line."""
    nodes = written(index(trees, METHOD_TYPES[language][0], max_length).select(S, "pre", "last", "node_type", "value", "ups", "types", "fns"), "method-nodes")
    inside = nodes.drop("last").join(located(nodes, language, names), S).where("pre between method and last")
    tongue, kind = F.lit(language), F.col("node_type")
    word, is_name = is_identifier(tongue, kind), F.col("pre") == F.col("name_node")
    flagged = inside.withColumns({"shown": F.when(is_name, F.lit(METHOD_NAME)).when(word, F.col("value")).when(is_number(tongue, kind), F.lit(NUM)), "illegal": word & ~is_name & ~F.col("value").rlike(LEGAL_IDENTIFIER)})
    flagged = flagged.where(F.col("shown").isNotNull() | F.col("illegal") | (F.col("pre") == F.col("method")))
    good = flagged.join(flagged.where("illegal").select(S).distinct(), S, "left_anti")
    # a path doesn't leave the method
    held = good.withColumns({"types": F.slice("types", F.lit(1), F.size(F.filter("ups", lambda x: x >= F.col("method")))), "ups": F.filter("ups", lambda x: x >= F.col("method"))})
    held = written(held.select(S, "pre", "shown", "types", "ups", "fns", "method", "target"), "method-leaves")
    # a tree has one method, so its pairs need no more than the tree to find it
    method = held.where(F.col("pre") == F.col("method")).select(S, F.col("method").alias("fn"), "target")
    contexts = leaf_pairs(held, max_length, max_width).join(method.select(S, "fn"), S).select(S, "fn", _context().alias("context"), "v", "u")
    return _lines(contexts, method)


def variables(trees: DataFrame, max_length: int) -> tuple[DataFrame, DataFrame]:
    """Leaf tokens with the methods they are in, and the variables of each method: (sample_id, fn, name, seen), where seen is the first of its leaves. The token that
    is a method's own name, a child of its node, is a variable of a fixed name."""
    nodes = index(trees, [METHOD_CS], max_length, leaves=(*TOKENS_CS, COMMENT), numbered=NUMBERED_CS)
    leaves = nodes.where(F.col("node_type").isin(*TOKENS_CS))
    named = (F.element_at("types", 2) == METHOD_CS) & (F.col("node_type") == "IdentifierToken")
    leaves = leaves.withColumn("shown", F.when(F.coalesce(named, F.lit(False)), F.lit(METHOD_NAME_CS)).otherwise(F.coalesce("value", F.lit(""))))
    return leaves, leaves.select(S, F.explode("fns").alias("fn"), F.col("shown").alias("name"), "pre").groupBy(S, "fn", "name").agg(F.min("pre").alias("seen"))


def variable_pairs(found: DataFrame, most: int, seed: int) -> DataFrame:
    """(sample_id, fn, a, b): pairs of a method's variables in the order they are seen, each with itself too; at most `most` of a method, chosen by
    hash. Each task keeps its best before they meet, so a method of any number of variables is spread."""
    a, b = found.select(S, "fn", F.col("name").alias("a"), F.col("seen").alias("sa")), found.select(S, "fn", F.col("name").alias("b"), F.col("seen").alias("sb"))
    pairs = a.join(b, [S, "fn"]).where("sa <= sb")
    w = Window.partitionBy(S, "fn").orderBy(F.md5(F.concat_ws("\x1f", F.lit(str(seed)), "a", "b")), "sa", "sb")
    return pairs.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def variable_contexts(trees: DataFrame, max_length: int = 9, max_width: int = 2, most: int = 30_000, seed: int = 1) -> DataFrame:
    """(sample_id, fn, a, b, v, u, context): ways between the leaves of two variables of a method, in the order of the variables, and both ways between two
    leaves of one. The leaves themselves count as steps; branches `max_width` or more places apart make no way."""
    leaves, found = variables(trees, max_length)
    up = leaves.select(S, "pre", "shown", "types", "ups", "fns", F.posexplode(F.slice("ups", 2, max_length)).alias("far", "lca"))
    branch = F.when(F.col("far") == 0, F.col("lca")).otherwise(F.element_at("ups", F.col("far") + 1))
    places_of = index(trees, [METHOD_CS], 1, leaves=(*TOKENS_CS, COMMENT)).select(S, F.col("pre").alias("branch"), "child_no")
    up = up.withColumn("branch", branch).join(places_of, [S, "branch"])
    side = lambda x: up.select(S, "lca", *(F.col(c).alias(f"{x}_{c}") for c in ("pre", "shown", "types", "far", "branch", "child_no", "fns")))
    meet = side("l").join(side("r").drop("r_fns"), [S, "lca"]).where(F.col("l_pre") != F.col("r_pre"))
    inner = (F.col("l_far") > 0) & (F.col("r_far") > 0)
    meet = meet.where(((F.col("l_branch") != F.col("r_branch")) | ((F.col("l_far") == 0) & (F.col("r_far") == 0))) & (F.col("l_far") + F.col("r_far") + 2 <= max_length))
    meet = meet.where(~inner | (F.abs(F.col("l_child_no") - F.col("r_child_no")) < max_width))
    steps = F.concat(F.slice("l_types", F.lit(2), F.col("l_far") + 1), F.reverse(F.slice("r_types", F.lit(2), F.col("r_far"))))
    text = F.concat_ws(",", split_name_unless_empty(F.col("l_shown")), F.array_join(steps, "|"), split_name_unless_empty(F.col("r_shown")))
    # the way from one variable to another begins at the one that is seen first
    ways = meet.select(S, F.explode(F.filter("l_fns", lambda f: f <= F.col("lca"))).alias("fn"), F.col("l_shown").alias("a"), F.col("r_shown").alias("b"), F.col("l_pre").alias("v"), F.col("r_pre").alias("u"), text.alias("context"))
    return ways.join(variable_pairs(found, most, seed).select(S, "fn", "a", "b", "sa", "sb"), [S, "fn", "a", "b"])


def comment_contexts(trees: DataFrame, k: int = 5) -> DataFrame:
    """(sample_id, pre, part, context): the parts of a tree's comments, k at a time, at both ends of a way of its own."""
    texts = index(trees, [METHOD_CS], 1).where(F.col("node_type") == COMMENT).select(S, "pre", F.btrim(F.coalesce("value", F.lit("")), F.lit(" /*{}")).alias("text"))
    words = chunks(F.split(split_name_unless_empty(F.col("text")), r"\|"), k)
    rows = texts.select(S, "pre", F.posexplode(words).alias("part", "words"))
    return rows.select(S, "pre", "part", F.concat_ws(",", F.array_join("words", "|"), F.lit("COMMENT"), F.array_join("words", "|")).alias("context"))


def variable_lines(trees: DataFrame, max_length: int = 9, max_width: int = 2, most: int = 30_000, seed: int = 1) -> DataFrame:
    """(sample_id, fn, value): a line for every method of every tree: the parts of its name, the ways between its variables, then
    those of the tree's comments."""
    ways = variable_contexts(trees, max_length, max_width, most, seed)
    ways = ways.groupBy(S, "fn").agg(F.transform(F.array_sort(F.collect_list(F.struct("sa", "sb", "u", "v", "context"))), lambda x: x["context"]).alias("ways"))
    said = comment_contexts(trees).groupBy(S).agg(F.transform(F.array_sort(F.collect_list(F.struct("pre", "part", "context"))), lambda x: x["context"]).alias("said"))
    methods = index(trees, [METHOD_CS], 1).where(F.col("node_type") == METHOD_CS).select(S, F.col("pre").alias("fn"), F.array_join(split_to_subtokens(F.coalesce("value", F.lit(""))), "|").alias("target"))
    none = F.array().cast("array<string>")
    rows = methods.join(ways, [S, "fn"], "left").join(said, S, "left")
    return rows.select(S, "fn", F.concat(F.col("target"), F.lit(" "), F.array_join(F.concat(F.coalesce("ways", none), F.coalesce("said", none)), " ")).alias("value"))
