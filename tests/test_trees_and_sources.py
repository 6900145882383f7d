"""Tree invariants, JSON dialects, sources and streams."""

from __future__ import annotations

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from thicket.operators import tree as T
from thicket.operators import vocab as V
from thicket.plans import QUERIES
from thicket.sources import files as S
from thicket.streaming import counts as C

PARENTS = [None, 0, 1, 1, 0, 4, 5]


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame([(1, k, p, "Empty" if k == 3 else "N") for k, p in enumerate(PARENTS)], "sample_id bigint, node_id int, parent_id int, node_type string")


def by_walking(i, j):
    def way(x):
        out = [x]
        while PARENTS[x] is not None:
            x = PARENTS[x]
            out.append(x)
        return out

    a, b = way(i), way(j)
    return min(a.index(x) + b.index(x) for x in a if x in b)


def test_distances(nodes):
    up = T.closure(nodes, 4)
    sp = {(r.i, r.j): r.value for r in T.shortest_paths(up).collect()}
    assert sp == {(i, j): by_walking(i, j) for i in range(7) for j in range(7)}
    anc = {(r.i, r.j): r.value for r in T.ancestor_distances(up).collect()}
    assert all(anc[j, i] == -v for (i, j), v in anc.items()) and anc[0, 6] == 3 and anc[1, 3] == 1 and (2, 3) not in anc
    sib = {(r.i, r.j): r.value for r in T.sibling_distances(nodes).collect()}
    assert sib[1, 4] == 1 and sib[4, 1] == -1 and sib[2, 3] == 1 and (2, 4) not in sib
    deep = {tuple(r) for r in T.closure_recursive(nodes).collect()}
    assert deep == {tuple(r) for r in up.collect()}


def test_prune_renumbers(nodes):
    got = {(r.node_id, r.parent_id) for r in T.prune(nodes).collect()}
    assert got == {(0, None), (1, 0), (2, 1), (3, 0), (4, 3), (5, 4)}


def test_pagerank_columns_sum_to_one(nodes):
    a = np.zeros((7, 7))
    for k, p in enumerate(PARENTS):
        if p is not None:
            a[k, p] = a[p, k] = 1
    p = T.pagerank_matrix(a, log=False)
    assert p.sum(axis=0) == pytest.approx(np.ones(7))
    d = {(r.i, r.j): r.value for r in T.pagerank_distances(nodes).collect()}
    assert d[0, 6] == pytest.approx(-np.log(p[0, 6] + 1e-9))


def test_vertex_dialect(spark):
    span = {"start": {"line": 1, "column": 1}, "end": {"line": 2, "column": 1}}
    good = {"files": [{"path": "a", "vertices": [{"vertexId": v, "term": t, "span": span} for v, t in ((7, "A"), (9, "B"), (8, "C"))], "edges": [{"source": 7, "target": 9}, {"source": 7, "target": 8}], "errors": []}]}
    bad = {"files": [{"path": "b", "vertices": [{"vertexId": 1, "term": "Error", "span": span}], "edges": [], "errors": []}]}
    df = spark.createDataFrame([(1, json.dumps(good)), (2, json.dumps(bad))], "sample_id bigint, ast string")
    assert {(r.sample_id, r.node_id, r.parent_id, r.child_idx, r.node_type) for r in T.from_vertices(df).collect()} == {(1, 0, None, None, "A"), (1, 1, 0, 0, "B"), (1, 2, 0, 1, "C")}


def test_nested_dialect_counts_in_preorder(spark):
    kids = [{"type": f"K{k}", "childNodes": [{"type": "L"}] if k == 2 else []} for k in range(12)]
    df = spark.createDataFrame([(1, json.dumps({"type": "R", "childNodes": kids}))], "sample_id bigint, ast string")
    got = {r.node_id: (r.parent_id, r.node_type) for r in T.from_nested(df).collect()}
    assert got[0] == (None, "R") and got[3] == (0, "K2") and got[4] == (3, "L") and got[13] == (0, "K11")


def test_reindex_example(spark):
    grid = spark.createDataFrame([(1, i, j, "abcdefghi"[3 * i + j]) for i in range(3) for j in range(3)], "sample_id bigint, i int, j int, value string")
    mapping = spark.createDataFrame([(1, t, n) for t, n in enumerate([1, 1, 0, 2, 0])], "sample_id bigint, token_idx int, node_id int")
    got = {(r.i, r.j): r.value for r in T.reindexed(grid, mapping).collect()}
    assert ["".join(got[i, j] for j in range(5)) for i in range(5)] == ["eedfd", "eedfd", "bbaca", "hhgig", "bbaca"]


def test_vocabulary_rules(spark):
    cnt = spark.createDataFrame([("b", 5), ("a", 5), ("c", 1), ("[pad]", 9), ("d", 7)], "word string, cnt bigint")
    got = [(r.id, r.word) for r in V.vocabulary(cnt, 26, 2).orderBy("id").collect()]
    assert got == [(24, "d"), (25, "a")]
    words = spark.createDataFrame([("A ",), ("zz",), ("[PAD]",)], "word string")
    table = V.with_specials(V.vocabulary(cnt, 30, 2))
    assert {r.word: r.id for r in V.encode(words, table).collect()} == {"A ": 25, "zz": 0, "[PAD]": 3}


def test_sources(spark, tmp_path):
    lines = tmp_path / "python" / "train"
    lines.mkdir(parents=True)
    (lines / "a.jsonl").write_text('{"func_name": "f", "docstring": "d", "code": "x", "other": 1}\n{"func_name": "g", "code": "y"}\n')
    got = S.read_json_lines(spark, f"{tmp_path}/*/*/*.jsonl").collect()
    assert {(r.func_name, r.docstring, r.language, r.partition) for r in got} == {("f", "d", "python", "train"), ("g", None, "python", "train")}
    (tmp_path / "m.json").write_text('[{"name": "f", "code": "x"},\n {"name": "g", "doc": "d", "code": "y"}]')
    assert {(r.func_name, r.docstring) for r in S.read_json_arrays(spark, f"{tmp_path}/m.json").collect()} == {("f", None), ("g", "d")}
    src = tmp_path / "src" / "proj"
    src.mkdir(parents=True)
    (src / "A.java").write_bytes("caf\xe9".encode("cp1252"))
    (src / "B.java").write_text("café", encoding="utf-8")
    files = {r.stem: (r.project, r.content) for r in S.read_code_files(spark, f"{tmp_path}/src").collect()}
    assert files == {"A": ("proj", "café"), "B": ("proj", "café")}
    rows = spark.createDataFrame([("python", "train", 1), ("go", "valid", 2)], "language string, partition string, x int")
    S.write_samples(rows, f"{tmp_path}/out")
    assert [r.x for r in S.read_samples(spark, f"{tmp_path}/out", "go").collect()] == [2]
    S.save_config(spark, {"a": [1, None]}, f"{tmp_path}/conf")
    assert S.load_config(spark, f"{tmp_path}/conf") == {"a": [1, None]}
    (tmp_path / "runs").mkdir()
    (tmp_path / "runs" / "CT-7.txt").write_text("x")
    assert S.next_run(spark, f"{tmp_path}/runs", "CT") == 8
    assert S.latest_snapshot(spark, f"{tmp_path}/runs").first().path.endswith("CT-7.txt")


def test_external_parser(spark):
    df = spark.createDataFrame([("b\na\n",)], "code string")
    assert S.external_parser(df, ["sort"]).first().ast == "a\nb\n"
    assert S.external_parser(df, ["no-such-command"]).first().ast is None


def test_foreach_batch_counts_once(spark, tmp_path):
    path = f"{tmp_path}/counts"
    merge = C.merge_counts(spark, path)
    batch = spark.createDataFrame([("a",), ("b",), ("a",)], "word string")
    merge(batch, 0)
    merge(batch, 0)
    merge(batch.limit(1), 1)
    assert {(r.word, r.cnt) for r in C.merged_counts(spark, path).collect()} == {("a", 3), ("b", 1)}


def test_streamed_sessions(spark, small):
    out = C.run_to_end(C.sessions(C.events(spark, f"{small}/events.parquet")), "sessions_test", mode="complete")
    assert out.agg(F.sum("n")).first()[0] == spark.read.parquet(f"{small}/events.parquet").count()


def test_pagerank_queries_take_whole_trees(spark, small):
    from thicket.plans import QUERIES
    from thicket.plans.trees import nodes as every

    rows = every(spark, small).collect()
    sizes = {}
    for r in rows:
        sizes[r.sample_id] = sizes.get(r.sample_id, 0) + 1
    got = {(r.sample_id, r.i, r.j): r.value for r in QUERIES["ppr_distances"](spark, small).collect()}
    assert len(got) == sum(n * n for n in sizes.values()) and max(sizes.values()) > 6
    assert QUERIES["ppr_bins"](spark, small).select("sample_id", "i", "j").distinct().count() == len(got)
    for sample, n in sizes.items():
        walk = np.zeros((n, n))
        for r in rows:
            if r.sample_id == sample and r.parent_id is not None:
                walk[r.node_id, r.parent_id] = walk[r.parent_id, r.node_id] = 1
        walk /= walk.sum(axis=0)
        p = 0.15 * np.eye(n)
        for _ in range(200):
            p = 0.15 * np.eye(n) + 0.85 * walk @ p
        near = p > 2.718281828459045**-4.9
        assert near.sum() > n
        for i, j in np.argwhere(near):
            assert got[sample, i, j] == pytest.approx(-np.log(p[i, j]), abs=1e-6)


def test_far_pairs_are_those_of_the_distances(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(k, n, None if n == 0 else rng.randrange(max(0, n - 5), n) if n % 3 else n // 3) for k in range(4) for n in range([1, 2, 9, 14][k])]
    nodes = spark.createDataFrame(rows, "sample_id bigint, node_id int, parent_id int")
    monkeypatch.setattr(T, "PAIRS", 100)
    up = T.closure(nodes, 8)
    tables = {"ancestor_sp": T.ancestor_distances(up), "sibling_sp": T.sibling_distances(nodes), "shortest_paths": T.shortest_paths(up)}
    dist = [(r.sample_id, m, r.i, r.j, r.value) for m, t in tables.items() for r in t.collect()]
    for limits, every in (({"shortest_paths": 2, "sibling_sp": 1, "ancestor_sp": -1}, False), ({"shortest_paths": 3, "sibling_sp": 1, "ancestor_sp": 1}, True), ({"ancestor_sp": 1, "sibling_sp": 0}, False), ({"sibling_sp": -1}, False)):
        want = {}
        for s, m, i, j, v in dist:
            if limits.get(m, -1) >= 0:
                want.setdefault((s, i, j), []).append(abs(v) > limits[m])
        got = [tuple(r) for r in T.far_pairs(nodes, limits, every, 8).collect()]
        assert sorted(got) == sorted((*k, all(x) if every else any(x)) for k, x in want.items()), limits


def test_masks_of_pairs_are_not_grouped(spark, small):
    plan = QUERIES["max_dist_mask"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not any("Exchange hashpartitioning" in line and "i#" in line.replace("sample_id#", "") and "j#" in line for line in plan.splitlines())
    assert not any("Aggregate" in line and "bool_or" in line for line in plan.splitlines())
