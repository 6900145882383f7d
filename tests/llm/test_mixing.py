import hashlib

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import edge_rows, prose, table, tokens
from thicket.llm import mixing as M


def fill(sizes, share=1.5, most=2.0):
    """Targets by repeated resharing. sizes: by source, in order."""
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sizes)}
    total, target, full = share * sum(sizes.values()), {}, set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        open_ = [s for s in sizes if s not in full]
        level = left / sum(weight[s] for s in open_) if open_ else 0
        target = {s: most * sizes[s] if s in full else weight[s] * level for s in sizes}
        over = {s for s in open_ if target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


def rows_of():
    out = list(edge_rows())
    for k in range(200):
        out.append((1000 + k, prose(k, k % 37), ("a", "b", "c", "d", "é", "e")[k % 6]))
    return out + [(5000, "one source alone here", "z"), (5001, None, "empty")]


@pytest.mark.parametrize("range_words", [250_000, 50])
def test_contract(spark, range_words):
    rows = rows_of()
    docs = table(spark, rows).withColumn("source", F.when(F.col("doc_id") == 1003, F.lit(None)).otherwise(F.col("source")))
    src = {d: (s[0] if s else "s") for d, _, *s in rows} | {1003: None}
    out = M.mixed(docs, M.MixParams(range_words=range_words)).collect()
    assert len(out) == len(rows)
    size = {}
    for d, t, *_ in rows:
        size[src[d]] = size.get(src[d], 0) + len(tokens(t))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    want = fill({s: size[s] for s in order})
    taken, seen = {}, []
    for r in out:
        assert r.source_size == size[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        seen.append((r.doc_id, r.size))
    assert sorted(seen, key=str) == sorted(((d, len(tokens(t))) for d, t, *_ in rows), key=str)
    for s, n in taken.items():
        assert n == round(want[s]) or abs(n - want[s]) <= 1
    again = M.mixed(docs, M.MixParams(range_words=range_words)).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_positions_follow_the_schedule(spark):
    docs = table(spark, [(k, prose(k, 50), "abc"[k % 3]) for k in range(300)])
    out = M.mixed(docs)
    uses = M.curriculum(out).collect()
    assert [u.position for u in uses] == sorted(u.position for u in uses) and all(0 <= u.position <= 1 for u in uses)
    total = {r.doc_id: r.taken for r in out.collect()}
    words = {}
    for u in uses:
        words[u.doc_id] = words.get(u.doc_id, 0) + u.words
    assert words == {d: t for d, t in total.items() if t}
    early = {s: sum(u.words for u in uses if u.source == s and u.position < 0.5) / sum(u.words for u in uses if u.source == s) for s in "abc"}
    # weights that fall from 1.5 to 0.5 give 5/8 of the words in the first half
    assert early["a"] == pytest.approx(0.625, abs=0.02) and early["b"] == pytest.approx(0.375, abs=0.02) and early["c"] == pytest.approx(0.5, abs=0.02)


def test_order_is_that_of_the_digest(spark):
    docs = table(spark, [(k, prose(k, 10), "a") for k in range(40)])
    out = sorted(M.mixed(docs).collect(), key=lambda r: r.before)
    assert [r.doc_id for r in out] == sorted(range(40), key=lambda k: hashlib.md5(str(k).encode()).hexdigest())


def test_empty_and_wordless(spark):
    assert M.mixed(table(spark, [])).count() == 0
    r = M.mixed(table(spark, [(1, None, "a"), (2, "", "a")])).collect()
    assert [(x.size, x.taken, x.target, x.position) for x in r] == [(0, 0, 0.0, None)] * 2
