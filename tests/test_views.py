"""Views, order and registries against plain restatements."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from thicket.operators import metrics as M
from thicket.operators import tree as T
from thicket.operators import views as V


@pytest.fixture(scope="module")
def rows(spark):
    """A hot part, a small one and one without a name; equal values of the first order column."""
    rng = random.Random(3)
    data = [("a" if k % 5 else None if k % 10 else "b", rng.randrange(9), k, rng.randrange(1, 7)) for k in range(500)]
    return data, spark.createDataFrame(data, "part string, x int, k int, n int").repartition(5, "k")


@pytest.mark.parametrize("slots", [1, 4, 64])
def test_preceding_sums_don_t_depend_on_the_cuts(rows, slots):
    data, df = rows
    got = {r.k: r["_before"] for r in V.preceding(df, "part", F.col("n"), "x", "k", slots=slots).collect()}
    for part in ("a", "b", None):
        total = 0
        for _, _, k, n in sorted((r for r in data if r[0] == part), key=lambda r: (r[1], r[2])):
            assert got[k] == total
            total += n


def test_batches_windows_and_chunks(rows):
    data, df = rows
    order = {part: sorted((r for r in data if r[0] == part), key=lambda r: (r[1], r[2])) for part in ("a", "b", None)}
    place = {r[2]: i for part in order.values() for i, r in enumerate(part)}
    batch = {r.k: r.batch for r in V.batches(df, "part", 7, "x", "k").collect()}
    assert batch == {k: i // 7 for k, i in place.items()}
    out = V.chunk_shuffled(df, "part", "x", 8, 5, "k").collect()
    by_hash = lambda k: hashlib.md5(f"5:{k}".encode()).hexdigest()[:13]
    sorted_ = {part: sorted((r for r in data if r[0] == part), key=lambda r: (r[1] + int(by_hash(r[2]), 16) / 2**52, r[2])) for part in order}
    among = {r[2]: i for part in sorted_.values() for i, r in enumerate(part)}
    assert all(r.chunk == among[r.k] // 8 for r in out)
    for part in order:
        own = sorted((r for r in out if r.part == part), key=lambda r: r.place)
        assert [r.place for r in own] == list(range(len(own)))
        seen = [r.chunk for r in own]
        runs = [c for i, c in enumerate(seen) if not i or seen[i - 1] != c]
        assert len(runs) == len(set(runs))  # chunks stay whole
        if part == "a":
            assert runs != sorted(runs)
    assert V.preceding(df.limit(0), "part", F.col("n"), "x").count() == 0


def test_reservoir_takes_all_of_small_groups(rows):
    data, df = rows
    out = V.reservoir(df, "x", 20, 1, "k").collect()
    for x in range(9):
        every, own = [r for r in data if r[1] == x], [r for r in out if r.x == x]
        assert len(own) == min(20, len(every)) and len({r.k for r in own}) == len(own)
    assert {r.k for r in out} != {r.k for r in V.reservoir(df, "x", 20, 2, "k").collect()}


def test_attention_view(spark):
    s = spark.createDataFrame([(1, 6, 9, 5), (2, 9, 9, 2)], "sample_id int, n int, width int, at int")
    got = {(r.sample_id, r.kind, r.i) for r in V.attention_view(s).collect()}
    assert got == {(1, "blocked", i) for i in (6, 7, 8)} | {(1, "target", i) for i in range(6)} | {(2, "target", i) for i in range(5)}


@pytest.fixture(scope="module")
def nodes(spark):
    parents = [None, 0, 1, 1, 0]
    return spark.createDataFrame([(1, k, p, f"N{k}") for k, p in enumerate(parents)] + [(2, 0, None, 'a"b')], "sample_id bigint, node_id int, parent_id int, node_type string")


def test_surroundings_sizes_and_dot(nodes):
    got = {(r.sample_id, r.node): (r.n_ancestors, r.n_descendants, r.n_leaves) for r in T.surroundings(T.closure(nodes, 4), nodes).collect()}
    assert got == {(1, 0): (0, 4, 3), (1, 1): (1, 2, 2), (1, 2): (2, 0, 1), (1, 3): (2, 0, 1), (1, 4): (1, 0, 1), (2, 0): (0, 0, 1)}
    assert {r.sample_id for r in V.small_trees(nodes, nodes, 4).collect()} == {2}
    text = {r.sample_id: r.dot for r in T.dot(nodes).collect()}
    assert text[2] == "digraph {\n  n0 [label=\"a'b\"];\n}" and text[1].count(" -> ") == 4 and "  n1 -> n3;" in text[1]


def test_own_distance_metrics_can_be_named(nodes):
    @T.distance("same_parent_test")
    def same_parent(n):
        a, b = n.select("sample_id", "parent_id", F.col("node_id").alias("i")), n.select("sample_id", "parent_id", F.col("node_id").alias("j"))
        return a.join(b, ["sample_id", "parent_id"]).withColumn("value", F.lit(1))

    got = {(r.metric, r.i, r.j) for r in T.distances_of(nodes, "same_parent_test", "sibling_sp").where("sample_id = 1 and i <> j").collect()}
    assert ("same_parent_test", 2, 3) in got and ("sibling_sp", 1, 4) in got
    with pytest.raises(ValueError):
        T.distance("ppr")(same_parent)
    del T.DISTANCES["same_parent_test"]


def test_metrics_by_name(spark):
    df = spark.createDataFrame([(["a", "<unk>"], ["a", "b"], ["a", "b"]), (["c", "[PAD]"], ["c", "[PAD]"], ["c", "[PAD]"])], "pred array<string>, label array<string>, best array<string>")
    p, l, b = F.col("pred"), F.col("label"), F.col("best")  # noqa: E741
    row = df.agg(*(M.metric(n, p, l, "[PAD]", "<unk>", b).alias(n) for n in ("top1_accuracy", "top1_accuracy_no_unk", "micro_recall", "micro_recall_no_unk"))).first()
    assert tuple(row) == (0.5, 1.0, pytest.approx(2 / 3), 1.0)


def test_rouge_of_empty_names(spark):
    df = spark.createDataFrame([([], []), ([], ["x"]), (["EMPTY"], [])], "pred array<string>, label array<string>")
    assert [r.s.f for r in df.select(M.rouge_1(F.col("pred"), F.col("label")).alias("s")).collect()] == [1.0, 0.0, 1.0]
