"""Media columns: audio features of 8-bit PCM samples.

A media row is a WAV file (RIFF, mono, unsigned 8-bit PCM). Its samples are resampled by a
polyphase filter, turned into overlapped log-mel filterbanks and cut into active segments by
energy with hysteresis; every segment is a stack of tensors of one fixed shape with its time
span, which `as_tensors` views as Arrow fixed-shape tensors.

Rows are independent of one another: there is no shuffle, and memory is bounded by one block of
frames beside the row itself.

Defined cases: a null or empty text has an empty payload, padded to one unit; extra columns are
dropped (the result has its own columns only); repeated rows give repeated results; an empty
table gives an empty one; a null doc_id stays null.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.session import ship

UNIT = 576


@dataclass(frozen=True)
class AudioParams:
    rate: int = 12_000  # of the stored samples
    up: int = 2  # resampled to rate * up / down
    down: int = 3
    taps: int = 24  # per phase
    frame: int = 256
    hop: int = 128
    mels: int = 32
    tensor_frames: int = 32  # frames in a tensor
    high_db: float = 3.0  # above the row's median: a segment starts
    low_db: float = 0.0  # below: it ends
    block: int = 4096  # frames at once

    @property
    def out_rate(self) -> float:
        return self.rate * self.up / self.down


def encode_wav(samples: bytes, rate: int) -> bytes:
    """Mono 8-bit PCM in a RIFF container; an odd data chunk gets the pad byte RIFF asks for."""
    pad = b"\0" * (len(samples) % 2)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples + pad


def decode_wav(media: bytes) -> tuple[bytes, int]:
    """Samples and rate of a mono 8-bit PCM WAV file; other chunks are passed over."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        kind, n = struct.unpack_from("<4sI", media, at)
        if kind == b"fmt ":
            tag, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (tag, channels, bits) != (1, 1, 8):
                raise ValueError("only mono 8-bit PCM is read")
        elif kind == b"data":
            return media[at + 8 : at + 8 + n], rate
        at += 8 + n + n % 2
    raise ValueError("no data chunk")


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes, padded with 255 to a positive multiple of UNIT; and the unpadded length."""
    raw = (text or "").encode()
    return raw + b"\xff" * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw)), len(raw)


@lru_cache(8)
def _filters(p: AudioParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Polyphase taps (up, taps), the window, and the mel matrix (frame/2+1, mels)."""
    n = p.taps * p.up
    t = np.arange(n) - (n - 1) / 2
    cut = 1 / max(p.up, p.down)
    h = np.sinc(t * cut) * cut * np.hamming(n) * p.up
    phases = h.reshape(p.taps, p.up).T[:, ::-1].copy()
    hz = np.fft.rfftfreq(p.frame, 1 / p.out_rate)
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(p.out_rate / 2), p.mels + 2) / 2595) - 1)
    lo, mid, hi = edges[:-2], edges[1:-1], edges[2:]
    bank = np.maximum(0, np.minimum((hz[:, None] - lo) / (mid - lo), (hi - hz[:, None]) / (hi - mid)))
    return phases.astype(np.float32), np.hanning(p.frame).astype(np.float32), bank.astype(np.float32)


def resample(x: np.ndarray, p: AudioParams) -> np.ndarray:
    """Rational resampling by up/down: output m is phase (m*down)%up at input (m*down)//up."""
    phases = _filters(p)[0]
    n_out = -(-len(x) * p.up // p.down)
    padded = np.concatenate([np.zeros(p.taps // 2, np.float32), x, np.zeros(p.taps, np.float32)])
    views = np.lib.stride_tricks.sliding_window_view(padded, p.taps)
    out = np.empty(n_out, np.float32)
    for first in range(min(p.up, n_out)):  # outputs first, first+up, ... share one phase
        m = np.arange(first, n_out, p.up)
        at, phase = m * p.down // p.up, (first * p.down) % p.up
        step, base = p.down, at[0]
        acc = np.zeros(len(m), np.float32)
        for k in range(p.taps):
            acc += views[base :: step, k][: len(m)] * phases[phase, k]
        out[first :: p.up] = acc
    return out


def log_mel(y: np.ndarray, p: AudioParams) -> np.ndarray:
    """(frames, mels) in dB; at least one frame, the last one zero-padded."""
    _, window, bank = _filters(p)
    n = max(1, -(-(len(y) - p.frame) // p.hop) + 1)
    y = np.concatenate([y, np.zeros(max(0, (n - 1) * p.hop + p.frame - len(y)), np.float32)])
    views = np.lib.stride_tricks.sliding_window_view(y, p.frame)[:: p.hop][:n]
    out = np.empty((n, p.mels), np.float32)
    for at in range(0, n, p.block):
        power = np.abs(np.fft.rfft(views[at : at + p.block] * window, axis=1)).astype(np.float32) ** 2
        out[at : at + p.block] = 10 * np.log10(power @ bank + 1e-6)
    return out


def active_segments(energy: np.ndarray, high: float, low: float) -> list[tuple[int, int]]:
    """Runs of frames that start where the energy reaches high and last while it stays at low or more.

    A run of frames at low or more that holds a frame at high is cut before its first such frame.
    """
    up = energy >= low
    edge = np.flatnonzero(np.diff(np.concatenate([[False], up, [False]]).astype(np.int8)))
    highs = np.flatnonzero(energy >= high)
    lo, hi = edge[::2], edge[1::2]
    k = np.searchsorted(highs, lo)
    has = k < np.searchsorted(highs, hi)
    return list(zip(highs[k[has]].tolist(), hi[has].tolist(), strict=True))


def analyse(samples: bytes, p: AudioParams) -> tuple[list[tuple[float, float]], np.ndarray, np.ndarray]:
    """Time spans (seconds), tensors (segments, tensor_frames, mels) and the log-mel frames of the whole row.

    A segment longer than one tensor is cut into consecutive ones; a last short one is padded with zeros.
    """
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    mel = log_mel(resample(x, p), p)
    energy = mel.mean(axis=1)
    mid = float(np.median(energy))
    spans, stacks = [], []
    for lo, hi in active_segments(energy, mid + p.high_db, mid + p.low_db):
        for at in range(lo, hi, p.tensor_frames):
            to = min(hi, at + p.tensor_frames)
            t = np.zeros((p.tensor_frames, p.mels), np.float32)
            t[: to - at] = mel[at:to]
            stacks.append(t)
            spans.append((at * p.hop / p.out_rate, ((to - 1) * p.hop + p.frame) / p.out_rate))
    return spans, np.stack(stacks) if stacks else np.zeros((0, p.tensor_frames, p.mels), np.float32), mel


def feature_string(spans: list[tuple[float, float]], tensors: np.ndarray, mel: np.ndarray) -> str:
    """Frames and segments, a digest of the spans and of the tensors, and one of all frames, in tenths of a dB."""
    h = hashlib.sha256(np.round(tensors, 1).astype("<f4").tobytes())
    h.update(np.asarray(spans, "<f8").tobytes())
    every = hashlib.sha256(np.round(mel, 1).astype("<f4").tobytes())
    return f"frames={len(mel)};segments={len(spans)};digest={h.hexdigest()[:32]};all={every.hexdigest()[:32]}"


def tensor_stream(spans: list[tuple[float, float]], tensors: np.ndarray) -> bytes | None:
    """Segments as an Arrow stream (start_s, end_s, log_mel), log_mel a fixed-shape tensor (frame, mel); null without any."""
    if not spans:
        return None
    kind = pa.fixed_shape_tensor(pa.float32(), tensors.shape[1:], dim_names=["frame", "mel"])
    values = pa.FixedSizeListArray.from_arrays(pa.array(tensors.ravel()), tensors.shape[1] * tensors.shape[2])
    start, end = (pa.array([s[k] for s in spans], pa.float64()) for k in (0, 1))
    batch = pa.RecordBatch.from_arrays([start, end, pa.ExtensionArray.from_storage(kind, values)], names=["start_s", "end_s", "log_mel"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def read_tensors(data: bytes | None) -> tuple[list[tuple[float, float]], np.ndarray | None]:
    """Spans and tensors (segments, frames, mels) of a value that tensor_stream gave."""
    if data is None:
        return [], None
    table = pa.ipc.open_stream(data).read_all()
    spans = list(zip(table["start_s"].to_pylist(), table["end_s"].to_pylist(), strict=True))
    return spans, table["log_mel"].combine_chunks().to_numpy_ndarray()


_SCHEMA = (
    "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, "
    "media_sha256 string, feature string, n_frames bigint, n_segments bigint, tensors binary"
)


def media_features(docs: DataFrame, params: AudioParams = AudioParams()) -> DataFrame:
    """Stores each text as a media row, reads it back and computes its features: see the module's notes."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                cols: list[list] = [[] for _ in range(10)]
                for text in part.column(1).to_pylist():
                    payload, n = payload_of(text)
                    media = encode_wav(payload, params.rate)
                    back, _ = decode_wav(media)
                    spans, tensors, mel = analyse(back, params)
                    for c, v in zip(cols, (n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature_string(spans, tensors, mel), len(mel), len(spans), tensor_stream(spans, tensors)), strict=True):
                        c.append(v)
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[x.split()[0] for x in _SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _SCHEMA)


def op1_media_audio(spark, sf_dir: str) -> DataFrame:
    return media_features(spark.read.parquet(f"{sf_dir}/documents.parquet"))
