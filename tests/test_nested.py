"""Nested sets and path contexts against plain walks over each tree."""

from __future__ import annotations

import itertools
import random
import re

import pytest

from thicket.operators import nested as N


def tree(rng, n, kinds, shuffled=False):
    """A random tree as a list of (type, value, children); the numbers of nodes are in the order of making, or shuffled."""
    parent = [None] + [rng.randrange(max(0, k - 6), k) for k in range(1, n)]
    names = list(range(n))
    if shuffled:
        rest = names[1:]
        rng.shuffle(rest)
        names = [0, *rest]
    kids = {k: [] for k in range(n)}
    for k in range(1, n):
        kids[parent[k]].append(k)
    out = [None] * n
    for k in range(n):
        t = kinds(rng)
        out[names[k]] = (t, rng.choice(["getName", "x_y", "HTTPCode", "a1b", "v"]) if rng.random() < 0.9 else None, [names[c] for c in kids[k]] or None)
    return out


def order(nodes, at=0):
    """Nodes in the order of a walk, with their ways from the root."""
    out = []

    def walk(v, way):
        out.append((v, [*way, v]))
        for c in nodes[v][2] or []:
            walk(c, [*way, v])

    walk(at, [])
    return out


def split(name):
    if name in ("METHODNAME", "NUM", "METHOD_NAME"):
        return name
    parts = [p for block in name.split("_") for p in re.split("(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", block) if p]
    return "|".join(p.lower() for p in parts)


def contexts(nodes, fn, number, length=8, width=2):
    """Of one function: every pair of its leaves, whole ways compared."""
    leaves = []
    for v, way in order(nodes, fn):
        kind, value, _ = nodes[v]
        if value is None:
            continue
        if v == fn:
            leaves.append((way, "METHODNAME"))
        elif kind.startswith("Name"):
            leaves.append((way, value))
        elif kind == "Num":
            leaves.append((way, "NUM"))
    out = []
    for (a, x), (b, y) in itertools.combinations(leaves, 2):
        same = next((k for k, (i, j) in enumerate(zip(a, b, strict=False)) if i != j), min(len(a), len(b)))
        if len(a) + len(b) - 2 * same + 1 <= length and abs(len(a) - len(b)) <= width:
            steps = [*reversed(a[same:]), a[same - 1], *b[same:]]
            out.append((number[a[-1]], number[b[-1]], f"{split(x)},{'|'.join(nodes[v][0] for v in steps)},{split(y)}"))
    return out


def frame(spark, trees):
    rows = [(k, None if t is None else [(a, b, c) for a, b, c in t], "extra") for k, t in enumerate(trees)]
    return spark.createDataFrame(rows, f"sample_id bigint, nodes {N.NODES}, pre string")


KINDS = ["FunctionDef", "NameLoad", "NameStore", "Num", "Expr", "Expr", "Str"]


@pytest.fixture(scope="module")
def trees():
    rng = random.Random(5)
    made = [tree(rng, n, lambda r: r.choice(KINDS), shuffled=n % 2 == 0) for n in (1, 2, 3, 10, 41, 60, 60)]
    chain = [("FunctionDef" if k % 7 == 0 else "NameLoad", "v", [k + 1] if k < 89 else None) for k in range(90)]
    return [*made, None, [], chain]


def test_numbers_equal_a_walk(spark, trees):
    got = {(r.sample_id, r.node_id): r for r in N.index(frame(spark, trees), ["FunctionDef"], 8).collect()}
    assert len(got) == sum(len(t or []) for t in trees)
    for k, t in enumerate(trees):
        walk = order(t) if t else []
        number = {v: i for i, (v, _) in enumerate(walk)}
        for v, way in walk:
            r = got[k, v]
            below = [number[u] for u, w in walk if v in w]
            assert (r.pre, r.last, r.depth) == (number[v], max(below), len(way) - 1)
            assert r.parent_id == (way[-2] if len(way) > 1 else None)
            assert r.ups == [number[u] for u in reversed(way)][:8] and r.types == [t[u][0] for u in reversed(way)][:8]
            assert r.fns == [number[u] for u in reversed(way) if t[u][0] == "FunctionDef"]


def test_contexts_of_all_functions(spark, trees):
    got = {}
    for r in N.function_contexts(frame(spark, trees)).collect():
        got.setdefault((r.sample_id, r.fn), []).append((r.v, r.u, r.context))
    want = {}
    for k, t in enumerate(trees):
        walk = order(t) if t else []
        number = {v: i for i, (v, _) in enumerate(walk)}
        for v, _ in walk:
            if t[v][0] == "FunctionDef" and (found := contexts(t, v, number)):
                want[k, number[v]] = found
    assert {key: sorted(x) for key, x in got.items()} == {key: sorted(x) for key, x in want.items()}
    lines = {(r.sample_id, r.fn): r.value for r in N.function_lines(frame(spark, [t for t in trees if t])).collect()}
    assert lines and all(x.count(",") % 2 == 0 and x.count(",") for x in lines.values())


def test_options(spark, trees):
    plain = N.function_contexts(frame(spark, trees), max_length=5, max_width=1, method_name=False, nums=False).collect()
    assert plain and not any("METHODNAME" in r.context or r.context.startswith("NUM,") for r in plain)
    assert all(r.context.split(",")[1].count("|") < 5 for r in plain)


def test_methods_are_found_with_their_names(spark):
    one = [("Module", None, [1, 4]), ("Function", None, [2, 3]), ("Identifier", "getName", None), ("Identifier", "x_y", None), ("Function", None, [5]), ("Identifier", "other", None)]
    unnamed = [("Module", None, [1]), ("Function", None, None)]
    illegal = [("Function", None, [1, 2]), ("Identifier", "f", None), ("Identifier", "no way", None)]
    trees = frame(spark, [one, unnamed, illegal, [], None])
    assert {(r.sample_id, r.fn): r.value for r in N.method_lines(trees, "python").collect()} == {(0, 1): "get|name METHODNAME,Identifier|Function|Identifier,x|y"}
    names = spark.createDataFrame([(0, "x_y"), (1, "f"), (2, "")], "sample_id bigint, func_name string")
    found = {r.sample_id: (r.method, r.name_node, r.target) for r in N.located(N.index(trees, ["Function"]), "python", names).collect()}
    assert found == {0: (1, 3, "x_y")}


def variable_ways(nodes, fn, length, width):
    """The C# flavour, by walks: leaves hang on nodes; children that are tokens have no place."""
    tokens = (*N.TOKENS_CS, N.COMMENT)
    leaves = [(way, "METHOD_NAME" if nodes[way[-2]][0] == N.METHOD_CS and nodes[v][0] == "IdentifierToken" else nodes[v][1] or "") for v, way in order(nodes, fn) if nodes[v][0] in N.TOKENS_CS and len(way) > 1]
    seen = list(dict.fromkeys(x for _, x in leaves))

    def place(v, parent):
        return [c for c in nodes[parent][2] if nodes[c][0] not in tokens].index(v)

    def label(v, parent):
        return nodes[v][0] + (str(min(3, place(v, parent))) if nodes[parent][0] in N.NUMBERED_CS else "")

    out = []
    whole = {v: way for v, way in order(nodes)}
    for (a, x), (b, y) in itertools.permutations(leaves, 2):
        if seen.index(x) > seen.index(y):
            continue
        a, b = whole[a[-1]][:-1], whole[b[-1]][:-1]
        same = next((k for k, (i, j) in enumerate(zip(a, b, strict=False)) if i != j), min(len(a), len(b)))
        left, right, top = a[same:], b[same:], a[same - 1]
        if len(left) + len(right) + 2 > length or (left and right and abs(place(left[0], top) - place(right[0], top)) >= width):
            continue
        up = lambda v: whole[v][-2] if len(whole[v]) > 1 else None
        shown = lambda v: label(v, up(v)) if up(v) is not None else nodes[v][0]
        steps = [*(shown(v) for v in reversed(left)), shown(top), *(shown(v) for v in right)]
        out.append((x, y, "|".join(steps)))
    return sorted(out)


def test_ways_between_variables(spark):
    rng = random.Random(8)
    inner = ["MethodDeclaration", "Block", "SimpleAssignmentExpression", "ArgumentList", "InvocationExpression"]
    trees = []
    for n in (12, 40, 70):
        t = tree(rng, n, lambda r: r.choice(inner))
        t = [(a, b, c) if c else (rng.choice([*N.TOKENS_CS, "IdentifierToken", "Comment"]), rng.choice(["x", "y", "zed", "42"]), None) for a, b, c in t]
        trees.append([("MethodDeclaration", "doThis", t[0][2]), *t[1:]])
    got = {}
    for r in N.variable_contexts(frame(spark, trees), 7, 2).collect():
        got.setdefault((r.sample_id, r.fn), []).append((r.a, r.b, r.context.split(",")[1]))
    want = {}
    for k, t in enumerate(trees):
        for i, (v, _) in enumerate(order(t)):
            if t[v][0] == N.METHOD_CS and (ways := variable_ways(t, v, 7, 2)):
                want[k, i] = ways
    assert {key: sorted(x) for key, x in got.items()} == want
    lines = N.variable_lines(frame(spark, trees), 7, 2).collect()
    assert len(lines) == sum(a == N.METHOD_CS for t in trees for a, *_ in t) and any(",COMMENT," in r.value for r in lines)


def test_pairs_are_sampled(spark):
    found = spark.createDataFrame([(1, 0, f"v{k}", k) for k in range(20)], "sample_id bigint, fn int, name string, seen int")
    every = N.variable_pairs(found, 10_000, 1).collect()
    some = N.variable_pairs(found, 50, 1).collect()
    assert len(every) == 210 and len(some) == 50 and {(r.a, r.b) for r in some} <= {(r.a, r.b) for r in every}


def test_trees_and_leaves_are_made_once(spark, small, monkeypatch):
    """Trees are read from a table, however often a query needs them, and leaves meet in as many tasks as their rows want."""
    from thicket.plans import code

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(code.trees(spark, small)) and "Window" not in plan(code.trees(spark, small))
    want = sorted(map(tuple, N.function_lines(code.trees(spark, small)).collect()))
    monkeypatch.setattr(N, "PAIRED", 5000)
    out = N.function_lines(code.trees(spark, small))
    assert "REPARTITION_BY_NUM" in plan(out)
    assert sorted(map(tuple, out.collect())) == want and want


def test_rows_of_nodes_are_those_of_the_index(spark, tmp_path):
    from thicket.plans import code

    texts = [(1, 0, "user", "Some words here.\nTwo, lines"), (1, 1, "assistant", "a longanswer of Words.\n\nx"), (1, 2, "assistant", ""), (1, 3, "user", "end."), (2, 0, "assistant", "first"), (2, 1, "user", None), (2, 2, "assistant", "y\nz"), (3, 5, "user", "one")]
    spark.createDataFrame(texts, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    for d in (str(tmp_path), "/root/testdata/sf0.001"):
        got = code.nested_rows(spark, d)
        want = N.index(code.trees(spark, d), ["FunctionDef"], 1).select(*got.columns)
        assert got.dtypes == want.dtypes
        rows = sorted(map(str, got.collect()))
        assert rows == sorted(map(str, want.collect())) and len(rows) > 10
