import random
from collections import Counter

from tests.llm.helpers import edge_rows, lower, prose, table, tokens
from thicket.llm import neardup as N
from thicket.llm.graph import components


def bag(t):
    w = tokens(lower(t))
    return Counter([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)])


def groups(rows, threshold=0.8):
    bags = {d: bag(t) for d, t, *_ in rows if d is not None}
    ids = sorted(bags)
    up = {d: d for d in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            shared = sum((bags[a] & bags[b]).values())
            if shared and shared >= threshold * (sum(bags[a].values()) + sum(bags[b].values()) - shared) - 1e-9:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: root(d) for d in ids}


def family(seed, n, size, edits):
    """Copies of one text, each with some words changed."""
    rng = random.Random(seed)
    base = prose(seed, size).split()
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(size)] = f"new{rng.randrange(10_000)}"
        out.append(" ".join(w))
    return out


def check(spark, rows, p=N.NearDupParams()):
    got = N.clusters(table(spark, rows), p).collect()
    want = groups(rows)
    assert {r.doc_id: r.group_id for r in got if r.doc_id is not None} == want and len(got) == len(rows)
    assert all(r.kept == (r.doc_id == r.group_id) and r.group_id <= r.class_id <= r.doc_id for r in got if r.doc_id is not None)
    return got


def test_edge_cases(spark):
    got = check(spark, edge_rows())
    assert sorted(map(str, (r.doc_id for r in got))) == sorted(str(d) for d, *_ in edge_rows())
    assert all(r.kept and r.class_id is r.group_id is None for r in got if r.doc_id is None)
    assert check(spark, []) == []


def test_rows_that_share_an_id_or_have_none(spark):
    a, b = prose(1, 60), prose(2, 60)
    rows = [(1, a), (1, b), (2, a), (None, b), (None, b + " more"), (None, prose(3, 30)), (None, prose(3, 30)), (3, "")]
    got = sorted((str(r.doc_id), str(r.group_id), r.kept) for r in N.clusters(table(spark, rows)).collect())
    assert got == sorted([("1", "1", True), ("1", "1", True), ("2", "1", False), ("None", "1", False), ("None", "1", False), ("None", "None", True), ("None", "None", True), ("3", "3", True)])
    kept = [(r.doc_id, r.text) for r in N.without_near_duplicates(table(spark, rows)).collect()]
    assert sorted(kept, key=str) == sorted([(1, a), (1, b), (None, prose(3, 30)), (3, "")], key=str)


def test_components_in_one_task_and_by_stars(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)]
    df = spark.createDataFrame(links, "a bigint, b bigint")
    one, stars = ({(r.node, r.label) for r in components(df, most).collect()} for most in (1000, 10))
    assert one == stars and (460, 400) in one


def test_families_of_all_degrees(spark):
    texts = [t for k in range(6) for t in family(k, 25, 120, 3 + k)] + [prose(100 + k, 100) for k in range(40)]
    random.Random(0).shuffle(texts)
    check(spark, list(enumerate(texts)))


def test_large_bands_are_examined_whole(spark):
    texts = family(7, 150, 80, 9) + family(8, 60, 80, 12)
    check(spark, list(enumerate(texts)), N.NearDupParams(block_bytes=16_000))


def test_weights_count(spark):
    check(spark, [(1, "a b c d e " * 10), (2, "a b c d e " * 12), (3, "a b c d e " * 30), (4, "a b c d e")])


def test_signatures_estimate_weighted_similarity():
    import pyarrow as pa

    x, y = "a b c d e f g h i j " * 3 + prose(1, 40), "a b c d e f g h i j " * 5 + prose(1, 30)
    both, weight, n, _ = N.shingle_bags(pa.array([x, y]), 5)
    s = N.signatures(both, weight, 2, 4096)
    a, b = bag(x), bag(y)
    shared = sum((a & b).values())
    assert abs((s[0] == s[1]).mean() - shared / (sum(a.values()) + sum(b.values()) - shared)) < 0.035


def test_one_of_each_group_stays(spark):
    rows = edge_rows() + [(50 + k, t) for k, t in enumerate(family(1, 10, 100, 2))]
    docs = table(spark, rows)
    out = N.without_near_duplicates(docs)
    assert out.columns == docs.columns
    kept = [r.doc_id for r in out.collect()]
    want = groups(rows)
    assert sorted(k for k in kept if k is not None) == sorted({g for g in want.values()})
    assert kept.count(None) == 2
    assert {r["_kept"] for r in out.collect()} == {"k"}


def test_columns_of_any_name_stay(spark):
    rows = spark.createDataFrame([(1, "one two three four five six", "a"), (2, "one two three four five six", "b"), (3, None, "c")], "doc_id bigint, text string, _row string")
    out = N.without_near_duplicates(rows)
    assert out.columns == ["doc_id", "text", "_row"] and {(r.doc_id, r["_row"]) for r in out.collect()} == {(1, "a"), (3, "c")}
