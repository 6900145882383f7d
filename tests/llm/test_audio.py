import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import edge_rows, table
from thicket.llm import audio as A

P = A.AudioParams()


def test_wav_round_trip():
    for n in (0, 1, 575, 576):
        samples = bytes(range(256)) * 3
        back, rate = A.decode_wav(A.encode_wav(samples[:n], 8000))
        assert back == samples[:n] and rate == 8000
    with pytest.raises(ValueError):
        A.decode_wav(b"no audio")


def test_resampling_keeps_a_tone():
    x = np.sin(2 * np.pi * 440 * np.arange(6000) / P.rate).astype(np.float32)
    y = A.resample(x, P)
    assert len(y) == len(x) * P.up // P.down
    middle = y[1000:3000]
    spectrum = np.abs(np.fft.rfft(middle * np.hanning(len(middle))))
    assert abs(spectrum.argmax() * P.out_rate / len(middle) - 440) < 5
    assert 0.9 < np.abs(middle).max() < 1.1


def test_filterbank_against_a_plain_sum():
    y = np.random.default_rng(0).normal(size=700).astype(np.float32)
    mel = A.log_mel(y, P)
    _, window, bank = A._filters(P)
    frame = y[P.hop : P.hop + P.frame] * window
    n = np.arange(P.frame)
    power = np.array([abs((frame * np.exp(-2j * np.pi * k * n / P.frame)).sum()) ** 2 for k in range(P.frame // 2 + 1)])
    assert mel[1] == pytest.approx(10 * np.log10(power @ bank + 1e-6), abs=1e-2)


def test_hysteresis():
    e = np.array([0, 1, 3, 1, 1, 0, 1, 1, 0, 3, 3])
    assert A.active_segments(e, 3, 1) == [(2, 5), (9, 11)]
    assert A.active_segments(np.zeros(4), 3, 1) == []


def test_contract_and_edge_cases(spark):
    rows = edge_rows()
    got = A.media_features(table(spark, rows)).collect()
    assert len(got) == len(rows)
    by_text = {}
    for r, (d, t, *_) in zip(got, rows, strict=True):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        assert (r.doc_id, r.n_bytes, r.payload_bytes) == (d, len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-32:])
        media = A.encode_wav(payload, P.rate)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        assert by_text.setdefault(payload, r.feature) == r.feature
        spans, tensors = A.read_tensors(r.tensors)
        assert len(spans) == r.n_segments and all(0 <= a < b for a, b in spans)
        spans2, tensors2, mel = A.analyse(payload, P)
        assert spans == spans2 and r.feature == A.feature_string(spans2, tensors2, mel)
        assert (tensors is None and not spans) or np.allclose(tensors, tensors2, atol=1e-3)
    assert any(r.n_segments for r in got)


def test_tensors_have_one_shape(spark):
    got = A.media_features(table(spark, [(1, "abc " * 900), (2, None), (3, "some words " * 300)])).collect()
    for r in got:
        if r.tensors is not None:
            kind = pa.ipc.open_stream(bytes(r.tensors)).schema.field("log_mel").type
            assert isinstance(kind, pa.FixedShapeTensorType) and kind.shape == [P.tensor_frames, P.mels]
    assert any(r.tensors is not None for r in got)
    assert A.media_features(table(spark, [])).count() == 0


def test_texts_without_a_segment_have_features_of_their_own(spark):
    rng = np.random.default_rng(0)
    rows = [(k, "".join(rng.choice(list("abcdefghij klmno"), 2304))) for k in range(6)]
    quiet = [r for r in A.media_features(table(spark, rows)).collect() if not r.n_segments]
    assert len(quiet) > 1 and len({r.n_frames for r in quiet}) == 1
    assert len({r.feature for r in quiet}) == len(quiet)
