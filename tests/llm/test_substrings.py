import functools
import hashlib
import random
from collections import Counter

import pytest

from tests.llm.helpers import edge_rows, prose, table, tokens, words_of
from thicket.llm import _chunks as C
from thicket.llm import substrings as S


def plain(rows, window=35):
    words = [tokens(t) for _, t, *_ in rows]
    n = Counter(tuple(w[s : s + window]) for w in words for s in range(len(w) - window + 1))
    out = []
    for (d, *_), w in zip(rows, words, strict=True):
        gone = {k for s in range(len(w) - window + 1) if n[tuple(w[s : s + window])] > 1 for k in range(s, s + window)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


def passages():
    rng = random.Random(5)
    shared = [words_of(900 + k, n) for k, n in enumerate((34, 35, 36, 52, 53, 90, 200))]
    rows = list(edge_rows())
    for k in range(60):
        w = words_of(k, rng.randrange(0, 300))
        for _ in range(rng.randrange(3)):
            at, p = rng.randrange(len(w) + 1), rng.choice(shared)
            w[at:at] = p
        rows.append((100 + k, rng.choice([" ", "\n", "  "]).join(w)))
    loop = words_of(77, 40)
    rows += [(300, " ".join(loop * 3)), (301, " ".join(["la"] * 36)), (302, " ".join(["la"] * 35)), (303, prose(4, 60_000))]
    return rows


@pytest.mark.parametrize(("chunk", "shard"), [(C.CHUNK_BYTES, C.SHARD_BYTES), (2_000, 20_000)])
def test_equals_brute_force(spark, monkeypatch, chunk, shard):
    monkeypatch.setattr(C, "SHARD_BYTES", shard)
    monkeypatch.setattr(S.C, "chunked", functools.partial(C.chunked, chunk_bytes=chunk))
    rows = passages()
    got = [tuple(r)[:4] for r in S.repeats(table(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted((x[:4] for x in plain(rows)), key=str)


def test_spans_are_maximal(spark):
    p = words_of(1, 50)
    rows = [(1, " ".join([*words_of(2, 9), *p, *words_of(3, 9)])), (2, " ".join([*words_of(4, 3), *p]))]
    assert {r.doc_id: r.spans for r in S.repeats(table(spark, rows)).collect()} == {1: [9, 59], 2: [3, 53]}


def test_texts_without_repeats(spark):
    rows = passages()
    docs = table(spark, rows)
    out = S.without_repeats(docs)
    assert out.columns == docs.columns
    want = sorted(((d, t if not g else kept) for (d, t, *_), (_, _, g, _, kept) in zip(rows, plain(rows), strict=True)), key=str)
    got = out.collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == want
    assert all(r.text is None or r.n_chars == len(r.text) for r in got) and {r.chunk for r in got} == {"c"}


def test_empty_table(spark):
    assert S.repeats(table(spark, [])).count() == 0 and S.without_repeats(table(spark, [])).count() == 0


def test_n_chars_that_is_no_number_stays(spark):
    text = prose(3, 80)
    docs = spark.createDataFrame([(1, text, "many"), (2, text, None)], "doc_id bigint, text string, n_chars string")
    assert {(r.doc_id, r.n_chars, r.text) for r in S.without_repeats(docs).collect()} == {(1, "many", ""), (2, None, "")}
