import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import alnum, edge_rows, lower, tokens
from thicket.llm import _chunks as C
from thicket.llm import _words as W


@pytest.mark.parametrize("segment", [64, 1 << 20])
def test_words_equal_the_patterns(segment, monkeypatch):
    monkeypatch.setattr(W, "SEGMENT", segment)
    texts = [r[1] for r in edge_rows() if r[1] is None or len(r[1]) < 1000 or segment > 100]
    raw, offs = W.text_bytes(pa.array(texts, pa.string()))
    for rule, lut, plain in ((W.IS_TOKEN, W.AS_IS, tokens), (W.IS_ALNUM, W.LOWER, alnum), (W.IS_TOKEN, W.LOWER, lambda t: tokens(lower(t)))):
        first, h, s, e = W.split_words(raw, offs, rule, lut, spans=True)
        seen = {}
        for k, t in enumerate(texts):
            want = plain(t)
            assert first[k + 1] - first[k] == len(want)
            for j, w in enumerate(want):
                at = first[k] + j
                assert bytes(lut[raw[s[at] : e[at]]]).decode() == w
                assert seen.setdefault(w, h[at]) == h[at]
        assert len(set(seen.values())) == len(seen)


def test_windows_tell_sequences_apart():
    h = W.mix(np.arange(50, dtype=np.uint64) % np.uint64(7))
    w = W.windows(h, 5)
    same = {}
    for k in range(46):
        assert same.setdefault(tuple(h[k : k + 5]), w[k]) == w[k]
    assert len(set(same.values())) == len(same) == 7


def test_packing_round_trips():
    rng = np.random.default_rng(0)
    x = np.sort(rng.integers(0, 1 << 40, 1000, dtype=np.uint64))
    assert (C.unpack(C.pack(x, 5), 5) == x).all() and (C.unpack(C.pack(x[:0])) == x[:0]).all()
    a, b, c = C.unbundle(C.bundle(x, np.arange(3, dtype=np.uint32), np.zeros(0, np.float64)))
    assert (a == x).all() and b.tolist() == [0, 1, 2] and len(c) == 0
