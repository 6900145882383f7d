import hashlib
import math
import random

import numpy as np
import pytest

from thicket.llm import vectors as V

SCHEMA = "vec_id bigint, embedding array<float>, label int, v string, code string, error int, of int, text string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, x, "a", "b", 1, 2, None) for i, v, x in rows], SCHEMA)


def plain(rows, parts, entries, rounds):
    """Every part against every entry, in Python integers."""
    kept = [(i, [math.floor(4096 * float(np.float32(c))) for c in v], x) for i, v, x in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    width = len(kept[0][1]) // parts
    cut = [[v[k * width : (k + 1) * width] for k in range(parts)] for _, v, _ in kept]
    books = [[c[k] for c in cut[:entries]] for k in range(parts)]

    def best(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), j) for j, e in enumerate(book))

    for _ in range(rounds):
        for k in range(parts):
            near = [best(c[k], books[k])[1] for c in cut]
            for j in range(len(books[k])):
                mine = [c[k] for c, n in zip(cut, near, strict=True) if n == j]
                if mine:
                    books[k][j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    out = []
    for (i, _, x), c in zip(kept, cut, strict=True):
        found = [best(c[k], books[k]) for k in range(parts)]
        out.append((i, x, "".join(f"{j:02x}" for _, j in found), sum(d for d, _ in found)))
    return out, digest


def made(n, dim, seed, values=None):
    rng = random.Random(seed)
    return [(i, [rng.choice(values) if values else rng.gauss(0, 1) for _ in range(dim)], rng.choice([None, 0, 1, 2])) for i in rng.sample(range(10 * n), n)]


CASES = {
    "plain": (made(300, 16, 1), 4, 16, 3),
    "ties": (made(200, 8, 2, [0.0, 0.25, -0.25]), 4, 8, 4),
    "copies": ([(k, [1.0] * 8, 1) for k in range(150)] + made(60, 8, 3), 8, 16, 6),
    "few": (made(5, 8, 4), 4, 16, 2),
    "odd rows": ([(None, [0.5] * 8, None), (1, None, 1), (2, [1.0, None] * 4, 1), (3, [float("nan")] * 8, 1), (4, [float("inf")] * 8, 1), (5, [1.0] * 6, 1), (6, [], 2), (7, [0.1] * 8, 2), (7, [0.1] * 8, 2), *made(40, 8, 5)], 4, 4, 2),
}


@pytest.mark.parametrize("name", CASES)
def test_equals_brute_force(spark, name):
    rows, parts, entries, rounds = CASES[name]
    if name == "odd rows":
        rows = [(None if i is None else i + 1000 if len(v or []) != 8 else i, v, x) for i, v, x in rows]  # a whole vector comes first
    want, digest = plain(rows, parts, entries, rounds)
    packed, books = V.trained(table(spark, rows), V.CodeParams(parts, entries, rounds))
    got = [tuple(r) for r in V.encoded(packed, books).collect()]
    assert books.digest() == digest
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("seed", range(6))
def test_tree_equals_every_entry(seed):
    rng = np.random.default_rng(seed)
    spread = [2, 5, 40, 1000, 10**6, 10**8][seed]
    entries = rng.integers(-spread, spread, (16, 3))
    entries[5] = entries[2]
    points = np.concatenate([rng.integers(-spread, spread, (2000, 3)), entries])
    index, d, computed = V.nearest(points, entries, V.vantage_tree(entries))
    every = ((points[:, None] - entries[None]) ** 2).sum(-1)
    assert (d == every.min(1)).all() and (index == every.argmin(1)).all()
    if spread >= 1000:
        assert computed < 0.9 * every.size  # the bound leaves halves out


def test_query(spark, small):
    out = V.op13_vector_codes(spark, small).toPandas()
    assert list(out.columns) == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert out["codebooks_sha256"].nunique() == 1 and out["code"].str.fullmatch("(0[0-9a-f]){8}").all()


def test_decoded(spark):
    rows = made(100, 8, 9)
    packed, books = V.trained(table(spark, rows), V.CodeParams(4, 16, 4))
    back = {r.vec_id: r.embedding for r in V.decoded(V.encoded(packed, books), books).collect()}
    error = {r.vec_id: r.error for r in V.encoded(packed, books).collect()}
    for i, v, _ in rows:
        ints = [math.floor(4096 * float(np.float32(c))) for c in v]
        assert sum((a - round(4096 * b)) ** 2 for a, b in zip(ints, back[i], strict=True)) == error[i]


def test_empty_and_uneven(spark):
    packed, books = V.trained(table(spark, []))
    assert V.encoded(packed, books).count() == 0
    rows = [(k, [float(k), 1.0, 2.0], 0) for k in range(20)]
    packed, books = V.trained(table(spark, rows), V.CodeParams(2, 4, 1))
    assert books.entries.shape == (2, 4, 2) and V.encoded(packed, books).count() == 20


def test_too_large_components_are_refused(spark):
    with pytest.raises(Exception, match="too large"):
        V.trained(table(spark, [(1, [3e30] * 8, 0)]))
