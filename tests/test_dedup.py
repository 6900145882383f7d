"""Similar files against brute force."""

from __future__ import annotations

import difflib
import random

import numpy as np
import pytest

from thicket.operators import dedup as D
from thicket.plans import QUERIES


def documents():
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6))
    out = []
    for k, n in enumerate([20, 20, 60, 900, 900]):
        words = ["Alpha" if k % 2 else "beta", *(word() for _ in range(n))]
        for copy in range(3):
            changed = list(words)
            for at in rng.integers(len(words) * 4 // 5, len(words), copy * 2):
                changed[at] = word()
            out.append(" ".join(changed))
    return [(k, t, "s", "en", len(t or "")) for k, t in enumerate([*out, "", None])]


def test_similar_files_equal_brute_force(spark, tmp_path):
    rows = documents()
    spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for a, x, *_, m in [r for r in rows if r[1] is not None]:
        for b, y, *_, n in [r for r in rows if r[1] is not None]:
            if a < b and x.split(" ")[0].lower() == y.split(" ")[0].lower() and (0.95 < m / n < 1.05 if n else m == 0):
                s = difflib.SequenceMatcher(None, x, y).ratio()
                if s > 0.7:
                    want[str(a), str(b)] = s
    got = {(r.a, r.b): r.similarity for r in QUERIES["similar_files"](spark, str(tmp_path)).collect()}
    assert got == pytest.approx(want)
    assert any(rows[int(a)][4] >= 4000 for a, _ in got) and any((int(a) - int(b)) % 2 == 0 for a, b in got)


def test_copies_are_told_once_and_lose_no_link(spark, tmp_path):
    """Copies go with the first of their text; of different texts every link is between the first ones, both ways where members alternate."""
    x, y = [r[1] for r in documents()][6:8]
    texts = [x, y, x, y, x, y, y, "beta", "beta"]
    rows = [(k, t, "s", "en", len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.a, r.b): r.similarity for r in QUERIES["similar_files"](spark, str(tmp_path)).collect()}
    ways = {("0", "1"): difflib.SequenceMatcher(None, x, y).ratio(), ("1", "0"): difflib.SequenceMatcher(None, y, x).ratio()}
    copies = {("0", "2"), ("0", "4"), ("1", "3"), ("1", "5"), ("1", "6"), ("7", "8")}
    assert min(ways.values()) > 0.7
    assert got == pytest.approx(ways | dict.fromkeys(copies, 1.0))


def test_two_corpora_give_all_pairs(spark):
    schema = "stem string, path int, size int, content string"
    search = spark.createDataFrame([("s", 1, 9, "same text"), ("s", 2, 9, "same text"), ("t", 3, 9, "same text"), ("s", 4, 9, "otherwise"), (None, 5, 9, "same text")], schema)
    reference = spark.createDataFrame([("s", 1, 9, "same text"), ("s", 7, 9, "same text"), ("s", 8, 9, None)], schema)
    got = {(r.a, r.b, r.similarity) for r in D.similar_files(search, reference, "stem").collect()}
    assert got == {(1, 1, 1.0), (1, 7, 1.0), (2, 1, 1.0), (2, 7, 1.0)}


def test_the_matcher_finds_what_difflib_finds_and_the_bound_rules_out_nothing():
    rng = random.Random(2)
    for _ in range(400):
        letters = [chr(97 + k) for k in range(rng.choice([3, 26, 60]))]
        b = rng.choices(letters, [rng.random() ** 3 for _ in letters], k=rng.choice([0, 5, 199, 200, 250, 900]))
        a = list(b)
        for _ in range(rng.randint(0, len(b) // 3 + 1)):
            at = rng.randint(0, len(a))
            a[at : at + rng.randint(0, 9)] = rng.choices(letters, k=rng.randint(0, 9))
        a, b = "".join(a), "".join(b)
        mine, plain = D.Matcher(b), difflib.SequenceMatcher(None, a, b)
        assert mine.similarity(a, D.places_of(a)) == plain.ratio() and mine.get_matching_blocks() == plain.get_matching_blocks()
        block = D.Block([{"path": 1, "size": len(b), "text": b, "last": 1}])
        found = list(block.similar({"path": 0, "size": len(b), "text": a}, 0.3, 0.1, 9, True))
        assert found == ([(1, plain.ratio())] if plain.ratio() > 0.3 else [])


def test_texts_are_sent_to_blocks_and_not_to_pairs(spark):
    """What is shuffled follows the texts: 150 of 1,500 characters that don't compress meet in 11,175 pairs, which took more than 8 MB."""
    rng = random.Random(4)
    rows = [("s", k, 1500, "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(500))) for k in range(150)]
    files = spark.createDataFrame(rows, "stem string, path int, size int, content string")
    store = spark.sparkContext._jsc.sc().statusStore()

    def shuffled():
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {stages.apply(k).stageId(): stages.apply(k).shuffleWriteBytes() for k in range(stages.size())}

    before = shuffled()
    assert D.similar_files(files, files, "stem", within=True).count() == 0
    assert sum(v for k, v in shuffled().items() if k not in before) < 2_000_000


def test_files_shared_by_projects_equal_all_pairs_without_making_them(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(int(rng.integers(0, 350)), rng.choice(["the x", "The", "of a b", "", " x", "Ä b"]), rng.choice(["p", "q", "r", "s", "t"]), "en", int(rng.integers(0, 400))) for _ in range(400)]
    rows += [(None, "the", "p", "en", 20), (401, "the", None, "en", 20), (402, "the", "q", "en", None), (403, None, "q", "en", 20), (404, "of", "u", "en", 100_000), (405, "of", "v", "en", 105_000), (406, "of", "v", "en", 104_999), (407, "of", "w", "en", 95_000)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    f = [(k, p, t.split(" ")[0].lower(), n) for k, t, p, _, n in rows if t is not None]
    want = {}
    for k, p, stem, n in f:
        for _, q, other, m in f:
            if None not in (k, p, q, n, m) and p != q and stem == other and n * m and 0.95 < n / m < 1.05:
                want.setdefault((p, q), set()).add(k)
    table = spark.createDataFrame(f, "file bigint, project string, stem string, size int")
    got = {(r.project, r.candidate): r.n_shared for r in D.shared_files(table, "stem").collect()}
    assert got == {k: len(v) for k, v in want.items()} and ("u", "v") in got and ("v", "u") in got and ("w", "u") not in got
    total = {p: sum(1 for r in f if r[1] == p) for _, p, *_ in f}
    out = QUERIES["project_overlap"](spark, str(tmp_path))
    assert {(r.project, r.candidate): (r.n_shared, r.n_files) for r in out.collect()} == {(p, q): (len(v), total[p]) for (p, q), v in want.items() if len(v) / total[p] > 0.05 and total[p] > 10}
    plan = out._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert joins and all("stem#" in line or "project#" in line for line in joins)  # none by file
