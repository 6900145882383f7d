import numpy as np
import pytest

from thicket.llm import _chunks as C

U64 = np.uint64


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 70_000])
@pytest.mark.parametrize("high", [2, 1000, 1 << 40, 1 << 52, 1 << 63, (1 << 64) - 1])
def test_order_and_distinct_values_equal_numpy(n, high):
    rng = np.random.default_rng(n)
    v = rng.integers(0, high, n, dtype=U64)
    v[n // 2 :] = v[: n - n // 2][::-1]
    assert np.array_equal(C.places(v), np.argsort(v, kind="stable"))
    key, order, new = C.distinct(v)
    want, where, at = np.unique(v, return_index=True, return_inverse=True)
    assert np.array_equal(key, want) and np.array_equal(order[new], where) and np.array_equal(C.numbered(order, new), at)


def test_order_where_the_bits_that_are_left_out_decide():
    rng = np.random.default_rng(1)
    v = (rng.integers(0, 50, 70_000, dtype=U64) << U64(50)) | rng.integers(0, 4, 70_000, dtype=U64)
    v[0] = (1 << 64) - 1
    assert np.array_equal(C.places(v), np.argsort(v, kind="stable"))


def test_bundles_come_back():
    rng = np.random.default_rng(3)
    arrays = [np.zeros(0), np.zeros(0, np.uint32), np.zeros(5, np.uint8), np.array([1.5, -2.0, np.inf]), np.array([-1, 3, -(1 << 62)]), np.array([True, False])]
    arrays += [rng.integers(0, high, 3000, dtype=U64).astype(kind) for high, kind in ((2, "u1"), (200, "u4"), (70_000, "u4"), (1 << 63, "u8"))]
    got = C.unbundle(C.bundle(*arrays))
    assert len(got) == len(arrays)
    for a, b in zip(arrays, got, strict=True):
        assert a.dtype == b.dtype and np.array_equal(a, b)
    sorted_ = np.sort(rng.integers(0, 1 << 40, 3000, dtype=U64))
    assert np.array_equal(C.unpack(C.pack(sorted_, 5), 5), sorted_) and len(C.unpack(C.pack(sorted_[:0]))) == 0
