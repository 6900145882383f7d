import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import edge_rows, lower
from thicket.llm import phrases as P

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, chunk string, words string, pivot int, g int, f int, n int, id int"


def table(spark, rows):
    return spark.createDataFrame([(k, t, x, None, None, "c", "w", 1, 2, 3, 4, 5) for k, (t, x) in enumerate(rows)], SCHEMA)


def plain(rows, least, top, percent=100):
    """Every contiguous run of words, counted as it stands."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, 6):
                f.update((lang, *words[k : k + m]) for k in range(len(words) - m + 1))
    candidates = {g: a for g, a in f.items() if len(g) > 2 and a >= least}
    covered = set()
    for g, a in candidates.items():
        lang, *w = g
        for i in range(len(w)):
            for j in range(i + 2, len(w) + 1):
                inner = (lang, *w[i:j])
                if len(inner) < len(g) and 100 * a >= percent * f[inner]:
                    covered.add(inner)
    out = {}
    for g, a in candidates.items():
        if g in covered:
            continue
        lang, *w = g
        score, k = min((1000 * a * n[lang] // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[(lang, *w[:k])], f[(lang, *w[k:])], n[lang]))
    rows = []
    for lang, found in out.items():
        for rank, (s, a, phrase, left, right, total) in enumerate(sorted(found)[:top], 1):
            rows.append((lang, rank, phrase.decode(), -a, left, right, total, -s))
    return rows


def made(seed, n=150):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(12)] + ["Das", "das", "É", "é", "x-y", "\x0b", "a\x1cb", "~"]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    rows = []
    for _ in range(n):
        words = rng.choices(vocabulary, weights, k=rng.randrange(0, 60))
        if rng.random() < 0.3:
            words[5:5] = ["one", "fixed", "phrase", "of", "seven", "words", "here"]
        if rng.random() < 0.1:
            words += ["la"] * rng.randrange(1, 12)
        rows.append(("".join(w + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", " \r\n"]) for w in words), rng.choice(["en", "en", "de", None, "und"])))
    return rows


def found(spark, rows, p, **sizes):
    out = P.ranked(P.phrases(table(spark, rows), p, **sizes), p.top)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in out.collect())


@pytest.mark.parametrize(("seed", "least", "sizes"), [(1, 8, {}), (2, 3, {"chunk_bytes": 700, "shard_bytes": 1500, "held": 40, "split": 50}), (3, 2, {"chunk_bytes": 3000, "shard_bytes": 900, "held": 7, "most": 5, "split": 3})])
def test_equals_brute_force(spark, seed, least, sizes):
    rows = made(seed) + [(t, "en") for _, t, *_ in edge_rows()]
    assert found(spark, rows, P.PhraseParams(least=least), **sizes) == sorted(plain(rows, least, 2000))


def test_ties_top_and_covering(spark):
    rows = [("b c. a d. c b. a d e", "en")] * 4 + [("a d", "en")]
    assert found(spark, rows, P.PhraseParams(least=3, top=2)) == sorted(plain(rows, 3, 2))
    assert found(spark, rows, P.PhraseParams(least=3, covered_percent=40)) == sorted(plain(rows, 3, 2000, 40))


def test_each_run_of_words_is_in_one_fragment():
    rng = np.random.default_rng(4)
    for _ in range(20):
        s = rng.integers(0, 6, 80).astype(np.int32)
        rows, counts = P.fragments(s, 5)
        t = P.mined(rows, counts, 5)
        got = {tuple(x for x in w if x): f for *w, _, f in zip(*(t.column(c).to_pylist() for c in ("w0", "w1", "w2", "w3", "w4", "pivot", "f")), strict=True)}
        want = Counter(tuple(s[k : k + m].tolist()) for m in range(2, 6) for k in range(len(s) - m + 1) if (s[k : k + m] > 0).all())
        assert got == want
        assert all(max(g) == p for g, p in zip(got, t.column("pivot").to_pylist(), strict=True))


def test_scores_beyond_64_bits(spark):
    """Sums of counts are stated, not made: the arithmetic is that of the query."""
    a, n, left, right = 9_000_000_000_001, 9_100_000_000_000_003, 9_200_000_000_005, 9_300_000_000_007
    row = spark.createDataFrame([(a, n, left, right)], "a bigint, n bigint, l bigint, r bigint")
    big = row.select(((1000 * P._big(row.a)).cast("decimal(38,0)") * P._big(row.n)).cast("decimal(38,0)").alias("t"), (P._big(row.l) * P._big(row.r)).cast("decimal(38,0)").alias("b")).selectExpr("t div b as s").first()
    assert big.s == 1000 * a * n // (left * right)


def test_numbered_rows():
    words, s, totals = P.numbered(pa.array(["en", None, "en"]), pa.array(["B a. b", None, "a"]))
    assert totals == {"en": 4, "und": 0} and sorted((w["word"], w["cnt"]) for w in words.to_pylist()) == [("a", 2), ("b", 2)]
    assert [0 if x == 0 else words[int(x) - 1].as_py()["word"] for x in s] == ["b", "a", 0, "b", 0, "a"]


def test_empty_table_and_query(spark, small):
    assert found(spark, [], P.PhraseParams()) == []
    assert found(spark, [(None, None), ("", "en")], P.PhraseParams(least=1)) == []
    assert P.op12_phrases(spark, small).count() > 0


@pytest.mark.parametrize("packed", [1, 50, 10**6])
def test_numbers_go_back_to_chunks_packed(spark, monkeypatch, packed):
    """Frequent words reach their chunks without a join that makes a row for each word of each chunk."""
    plans, route = [], P._route

    def seen(answered, *rest):
        plans.append(answered._jdf.queryExecution().executedPlan().toString())
        return route(answered, *rest)

    monkeypatch.setattr(P, "_route", seen)
    rows = made(5, 80)
    assert found(spark, rows, P.PhraseParams(least=3), chunk_bytes=900, packed=packed) == sorted(plain(rows, 3, 2000))
    joins = [line for line in plans[0].splitlines() if "Join" in line]
    assert len(joins) == 1 and "chunk" in joins[0] and "word" not in joins[0]
