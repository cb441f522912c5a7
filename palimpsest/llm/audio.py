"""Audio features of media columns: polyphase resampling, overlapped log-mel frames, hysteresis energy segments."""

from __future__ import annotations

import struct
from dataclasses import dataclass
from functools import lru_cache
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from palimpsest.llm.common import release

HEADER = 44  # bytes of the WAV form before the samples


@dataclass(frozen=True)
class AudioParams:
    rate: int = 16_000  # of the stored samples
    target_rate: int = 8_000
    taps: int = 24  # of the low-pass, for each of its phases
    frame: int = 200
    hop: int = 80
    fft: int = 256
    mels: int = 40
    patch: int = 16  # frames in a tensor
    on_db: float = -18.0  # a segment begins above
    off_db: float = -24.0  # and ends below


def wav_bytes(payload: bytes, rate: int) -> bytes:
    """Mono 8-bit PCM: the payload's bytes are the samples."""
    n = len(payload)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", n) + payload


def wav_samples(media: bytes) -> tuple[np.ndarray, int]:
    """(unsigned 8-bit samples, rate) of a mono 8-bit PCM file; walks its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("not mono 8-bit PCM")
        elif name == b"data":
            return np.frombuffer(media, np.uint8, size, at + 8), rate
        at += 8 + size + size % 2
    raise ValueError("no samples")


@lru_cache(maxsize=8)
def _low_pass(up: int, down: int, taps: int) -> np.ndarray:
    n = taps * up - 1 + taps * up % 2  # odd, so its delay is whole samples
    t = np.arange(n) - (n - 1) / 2
    cut = 0.5 / max(up, down)
    h = 2 * cut * np.sinc(2 * cut * t) * np.hamming(n)
    return (h / h.sum() * up).astype(np.float32)


def resample(x: np.ndarray, rate: int, target: int, taps: int = 24) -> np.ndarray:
    """Polyphase: each output reads only the filter phase that meets input samples."""
    g = gcd(rate, target)
    up, down = target // g, rate // g
    if up == down:
        return x.astype(np.float32)
    h = _low_pass(up, down, taps)
    n_out = -(-len(x) * up // down)
    pad = np.zeros(taps, np.float32)
    xp = np.concatenate([pad, x.astype(np.float32), pad, np.zeros(down, np.float32)])
    y = np.zeros(n_out, np.float32)
    delay = (len(h) - 1) // 2
    for r in range(min(up, n_out)):
        at = r * down + delay
        phase, first = at % up, at // up + taps
        count = -(-(n_out - r) // up)
        acc = np.zeros(count, np.float32)
        for k, c in enumerate(h[phase::up]):
            acc += c * xp[first - k : first - k + down * (count - 1) + 1 : down]
        y[r::up] = acc
    return y


@lru_cache(maxsize=8)
def _mel_bank(rate: int, fft: int, mels: int) -> np.ndarray:
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), mels + 2) / 2595) - 1)
    f = np.linspace(0, rate / 2, fft // 2 + 1)
    up = (f[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[2:] - f[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


def log_mel(y: np.ndarray, p: AudioParams) -> tuple[np.ndarray, np.ndarray]:
    """(frames x mels log energies, frame energy in dB); the tail is padded to a whole frame."""
    n = max(1, -(-(len(y) - p.frame) // p.hop) + 1)
    y = np.concatenate([y, np.zeros((n - 1) * p.hop + p.frame - len(y), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(y, p.frame)[:: p.hop]
    window, bank = np.hanning(p.frame).astype(np.float32), _mel_bank(p.target_rate, p.fft, p.mels)
    out, energy = np.empty((n, p.mels), np.float32), np.empty(n, np.float32)
    for i in range(0, n, 2048):  # bounds the memory of very long media
        w = frames[i : i + 2048] * window
        spec = np.fft.rfft(w, p.fft)
        out[i : i + 2048] = np.log((spec.real**2 + spec.imag**2) @ bank + np.float32(1e-6))
        energy[i : i + 2048] = 10 * np.log10((w * w).mean(1) + np.float32(1e-10))
    return out, energy


def hysteresis(energy: np.ndarray, on: float, off: float) -> list[tuple[int, int]]:
    """Frame spans [begin, end) that begin above `on` and last while not below `off`."""
    event = np.where(energy > on, 1, np.where(energy < off, 0, -1))
    known = np.where(event >= 0, np.arange(len(event)), -1)
    known = np.maximum.accumulate(known)
    state = np.where(known >= 0, event[known], 0)
    edge = np.diff(np.r_[0, state, 0])
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))


def tensor_type(p: AudioParams) -> pa.DataType:
    return pa.fixed_shape_tensor(pa.float32(), (p.patch, p.mels), dim_names=("frame", "mel"))


def features(samples: np.ndarray, rate: int, p: AudioParams) -> tuple[bytes, list[tuple[float, float]]]:
    """(Arrow stream of fixed-shape tensors with start_s and end_s, energy segments in seconds)."""
    y = resample((samples.astype(np.float32) - 128) / 128, rate, p.target_rate, p.taps)
    mel, energy = log_mel(y, p)
    n = -(-len(mel) // p.patch)
    padded = np.full((n * p.patch, p.mels), np.float32(np.log(1e-6)), np.float32)
    padded[: len(mel)] = mel
    tensors = pa.ExtensionArray.from_storage(tensor_type(p), pa.FixedSizeListArray.from_arrays(pa.array(padded.reshape(-1)), p.patch * p.mels))
    start = np.arange(n) * p.patch * p.hop / p.target_rate
    end = np.minimum(start + ((p.patch - 1) * p.hop + p.frame) / p.target_rate, len(y) / p.target_rate)
    batch = pa.record_batch({"patch": tensors, "start_s": start, "end_s": end})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    spans = [(a * p.hop / p.target_rate, b * p.hop / p.target_rate) for a, b in hysteresis(energy, p.on_db, p.off_db)]
    return sink.getvalue().to_pybytes(), spans


def read_tensors(stream: bytes) -> pa.Table:
    """Columns patch (fixed-shape tensor), start_s, end_s."""
    return pa.ipc.open_stream(stream).read_all()


def text_payload(text: str | None) -> bytes:
    """UTF-8 of the text with zero bytes up to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % 64 or (0 if raw else 64))


def store_text(docs: DataFrame, params: AudioParams = AudioParams()) -> DataFrame:
    """All columns of `docs` with n_bytes and media: each whole text as a mono 8-bit WAV. Null texts are empty."""
    docs = docs.drop("n_bytes", "media")

    def run(it):
        for batch in it:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                texts = part.column("text").to_pylist()
                n = pa.array([len((t or "").encode("utf-8", "surrogatepass")) for t in texts], pa.int64())
                media = pa.array([wav_bytes(text_payload(t), params.rate) for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, n, media], [*part.schema.names, "n_bytes", "media"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())]))


def audio_features(rows: DataFrame, params: AudioParams = AudioParams()) -> DataFrame:
    """All columns of `rows` with payload, tensors and segments, from a `media` column of mono 8-bit WAV files.

    payload: the samples read back; tensors: an Arrow stream of fixed-shape
    log-mel tensors with time spans (read_tensors); segments: array of (start_s,
    end_s) where the energy is high. Each medium is computed by itself, so equal
    media give equal values. Null media give nulls; columns of those names are
    replaced.
    """
    rows = rows.drop("payload", "tensors", "segments")
    span = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))

    def run(it):
        for batch in it:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                payload, tensors, spans = [], [], []
                for m in part.column("media").to_pylist():
                    if m is None:
                        payload.append(None), tensors.append(None), spans.append(None)
                        continue
                    x, rate = wav_samples(m)
                    t, s = features(x, rate, params)
                    payload.append(x.tobytes()), tensors.append(t)
                    spans.append([{"start_s": a, "end_s": b} for a, b in s])
                cols = [*part.columns, pa.array(payload, pa.binary()), pa.array(tensors, pa.binary()), pa.array(spans, span)]
                yield pa.RecordBatch.from_arrays(cols, [*part.schema.names, "payload", "tensors", "segments"])
        release()

    seg = T.ArrayType(T.StructType([T.StructField("start_s", T.DoubleType()), T.StructField("end_s", T.DoubleType())]))
    schema = [*rows.schema.fields, T.StructField("payload", T.BinaryType()), T.StructField("tensors", T.BinaryType()), T.StructField("segments", seg)]
    return rows.mapInArrow(run, T.StructType(schema))
