import hashlib

import numpy as np

from tests.llm.helpers import alnum, edge_rows, prose, table, words_of
from thicket.llm import contamination as D

ITEMS = [(1, prose(500, 14)), (2, "Two words"), (3, prose(501, 30)), (4, None), (None, prose(502, 12)), (5, "!?"), (6, prose(500, 14)), (6, prose(500, 14)), (70, prose(503, 10)), (8, "same text, here FIVE words and more")]


def plain(rows, items, window=10):
    out = []
    for d, t, *_ in rows:
        w = alnum(t)
        hit, found = set(), set()
        for i, x in items:
            if i is None or x is None:
                continue
            y = alnum(x)
            k = min(window, len(y))
            wins = {tuple(y[s : s + k]) for s in range(len(y) - k + 1)} if k else set()
            for s in range(len(w) - k + 1) if k else []:
                if tuple(w[s : s + k]) in wins:
                    hit |= set(range(s, s + k))
                    found.add(str(i))
        ids = ",".join(sorted(found))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return out


def docs_with_passages():
    a, b = words_of(500, 14), words_of(501, 30)
    return edge_rows() + [
        (20, " ".join([*words_of(1, 50), *a, *words_of(2, 50)])),
        (21, " ".join([*words_of(3, 20), *b[5:16], *words_of(4, 3), *b[5:16], *b[20:29]])),
        (22, " ".join(b[:10])),
        (23, " ".join(b[:9])),
        (24, "x two. WORDS y " + prose(503, 10)),
        (25, " ".join([*a[:9], "other", *a[9:]])),
    ]


def test_equals_brute_force_and_blocks_agree(spark):
    rows = docs_with_passages()
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    want = sorted(plain(rows, ITEMS), key=str)
    for p in (D.DecontaminationParams(), D.DecontaminationParams(block_bytes=200), D.DecontaminationParams(shard_bytes=100)):
        got = [tuple(r)[:6] for r in D.contamination(table(spark, rows), bench, p).collect()]
        assert sorted(got, key=str) == want


def test_longest_matches_and_places(spark):
    b = words_of(501, 30)
    doc = [*words_of(3, 7), *b[4:22], "zz"]
    bench = spark.createDataFrame([(3, " ".join(b))], "item_id bigint, text string")
    r = D.contamination(table(spark, [(1, " ".join(doc))]), bench).first()
    found = {(m.item_word, m.doc_word, m.n_words) for m in r.matches}
    assert (4, 7, 18) in found and (12, 15, 10) in found and len(found) == 9


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(0)
    words = rng.integers(1, 4, 200).astype(np.int32)
    ends = np.repeat([80, 81, 200], [80, 1, 119])
    sa = D.suffix_array(words, ends, np.arange(0, 200, 3))
    suffixes = [words[p : ends[p]].tolist() for p in sa]
    assert suffixes == sorted(suffixes) and len(sa) == 67


def test_clean_keeps_the_rest_with_its_columns(spark):
    rows = docs_with_passages()
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    docs = table(spark, rows)
    out = D.clean(docs, bench)
    want = [d for d, *_, bad in plain(rows, ITEMS) if not bad]
    assert out.columns == docs.columns and sorted((r.doc_id for r in out.collect()), key=str) == sorted(want, key=str)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert D.contamination(table(spark, []), none).count() == 0
    assert [r.contaminated for r in D.contamination(table(spark, [(1, "a b")]), none).collect()] == [False]
