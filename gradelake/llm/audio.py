"""Audio columns: 8-bit WAV media, polyphase resampling, log-mel tensors, energy segments.

Features are computed from samples that are read back out of the stored media, a
bounded stretch at a time, so that long recordings need no more memory than short
ones; a recording's features depend on its own samples only.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Samples a second as stored and as analysed (3 : 2), frame and hop in analysed samples, mel bands.
RATE, UP, DOWN = 8000, 2, 3
FRAME, HOP, MELS, BINS = 256, 128, 24, 129
#: Frames in one stored tensor, whose shape is fixed: (FRAMES, MELS); the last one is filled with FLOOR.
FRAMES, FLOOR = 64, -80.0
#: Segments open at ON dB above the quietest tenth of frames and close below OFF dB; shorter ones than LEAST frames go.
ON, OFF, LEAST = 6.0, 3.0, 2
_TAPS = 12  # of each phase
_STRETCH = FRAMES * 64  # frames at a time


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    """A mono 8-bit PCM WAV file of the samples (padded to an even length, as the format asks)."""
    n, pad = len(samples), len(samples) % 2
    u4, u2 = (lambda x: x.to_bytes(4, "little")), (lambda x: x.to_bytes(2, "little"))
    head = b"RIFF" + u4(36 + n + pad) + b"WAVEfmt " + u4(16) + u2(1) + u2(1) + u4(rate) + u4(rate) + u2(1) + u2(8) + b"data" + u4(n)
    return head + samples + b"\0" * pad


def from_wav(media: bytes) -> tuple[int, bytes]:
    """(rate, samples) of a mono 8-bit PCM WAV file; chunks other than ``fmt `` and ``data`` are passed over."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, None
    while at + 8 <= len(media):
        kind, n = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if kind == b"fmt ":
            form, channels = int.from_bytes(media[at + 8 : at + 10], "little"), int.from_bytes(media[at + 10 : at + 12], "little")
            rate, bits = int.from_bytes(media[at + 12 : at + 16], "little"), int.from_bytes(media[at + 22 : at + 24], "little")
            if (form, channels, bits) != (1, 1, 8):
                raise ValueError("only mono 8-bit PCM")
        elif kind == b"data":
            return rate or RATE, media[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no samples")


def _phases(up: int, down: int, taps: int = _TAPS) -> np.ndarray:
    """The phases (up, taps) of a windowed-sinc low-pass at the lower of both Nyquist rates."""
    n = up * taps
    t = np.arange(n) - (n - 1) / 2
    cut = 1.0 / max(up, down)
    h = cut * np.sinc(cut * t) * np.kaiser(n, 7.0)
    return (h / h.sum() * up).reshape(taps, up).T


def resample(x: np.ndarray, up: int = UP, down: int = DOWN, first: int = 0, count: int | None = None) -> np.ndarray:
    """Polyphase resampling by up / down: outputs ``first`` to ``first + count`` of the whole signal.

    Output k is phase (k * down) % up over the inputs that end at (k * down) // up plus
    half the filter; what lies outside the signal counts as zero.
    """
    if first % up:
        raise ValueError("a stretch begins at a multiple of up")
    phases = _PHASES if (up, down) == (UP, DOWN) else _phases(up, down)
    taps = phases.shape[1]
    total = -(-len(x) * up // down)
    count = max(total - first if count is None else min(count, total - first), 0)
    out = np.zeros(count)
    ahead = first // up * down + taps // 2 - taps + 1  # the first input under the filter of output ``first``
    rows = -(-count // up)
    need = (rows - 1) * down + (up - 1) * down // up + taps
    part = np.zeros(max(need, taps))
    lo, hi = max(ahead, 0), min(ahead + need, len(x))
    if hi > lo:
        part[lo - ahead : hi - ahead] = x[lo:hi]
    windows = np.lib.stride_tricks.sliding_window_view(part, taps)
    for r in range(min(up, count)):
        n = len(range(r, count, up))
        out[r::up] = windows[r * down // up :: down][:n] @ phases[r * down % up, ::-1]
    return out


_PHASES = _phases(UP, DOWN)


def _mel_bank(rate: float) -> np.ndarray:
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(40), mel(rate / 2), MELS + 2) / 2595) - 1)
    f = np.linspace(0, rate / 2, BINS)
    up, down = (f - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None], (edges[2:, None] - f) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down))


_BANK = _mel_bank(RATE * UP / DOWN)
_HANN = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(FRAME) / FRAME)


def log_mel(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(frames, MELS) log-mel energies in dB, to 0.01, and each frame's energy in dB."""
    x = np.frombuffer(samples, np.uint8).astype(np.float32) / 128.0 - 1.0
    total = -(-len(x) * UP // DOWN)
    frames = max(1, -(-max(total - FRAME, 0) // HOP) + 1)
    mel, power = np.empty((frames, MELS), np.float32), np.empty(frames, np.float32)
    for lo in range(0, frames, _STRETCH):
        n = min(_STRETCH, frames - lo)
        y = np.zeros((n - 1) * HOP + FRAME)
        part = resample(x, first=lo * HOP, count=len(y))
        y[: len(part)] = part
        view = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
        f = np.fft.rfft(view * _HANN, axis=1)
        spectrum = f.real**2 + f.imag**2
        mel[lo : lo + n] = np.round(np.maximum(10 * np.log10(spectrum @ _BANK.T + 1e-8), FLOOR), 2)
        power[lo : lo + n] = np.round(10 * np.log10((view**2).mean(1) + 1e-8), 2)
    return mel, power


def segments(power: np.ndarray) -> list[tuple[int, int]]:
    """Frame spans by hysteresis: open above the upper level, close below the lower one."""
    floor = np.sort(power)[len(power) // 10]
    loud, quiet = power >= floor + ON, power < floor + OFF
    state = np.where(loud, 1, np.where(quiet, 0, -1))
    known = np.maximum.accumulate(np.where(state >= 0, np.arange(len(state)), -1))
    on = np.where(known >= 0, state[np.maximum(known, 0)], 0) == 1
    edge = np.flatnonzero(np.diff(np.concatenate([[0], on.astype(np.int8), [0]])))
    return [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2], strict=True) if b - a >= LEAST]


def tensors(mel: np.ndarray) -> pa.FixedShapeTensorArray:
    """The frames as Arrow tensors of one shape, (FRAMES, MELS)."""
    n = -(-len(mel) // FRAMES)
    whole = np.full((n * FRAMES, MELS), FLOOR, np.float32)
    whole[: len(mel)] = mel
    return pa.FixedShapeTensorArray.from_numpy_ndarray(whole.reshape(n, FRAMES, MELS))


_SECOND = RATE * UP / DOWN
_SPAN = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))
#: Columns that ``audio_features`` adds; ``tensors`` is an Arrow IPC stream (see ``store``).
ADDED = {"tensors": pa.binary(), "segments": _SPAN, "problem": pa.string()}
SCHEMA = "tensors binary, segments array<struct<start_s:double,end_s:double>>, problem string"


def _spans(pairs) -> list[dict]:
    return [{"start_s": a * HOP / _SECOND, "end_s": ((b - 1) * HOP + FRAME) / _SECOND} for a, b in pairs]


def store(mel: np.ndarray) -> bytes:
    """The frames as an Arrow IPC stream: a column ``tensor`` of fixed shape (FRAMES, MELS) with its time span beside it."""
    t = tensors(mel)
    spans = _spans((i * FRAMES, min((i + 1) * FRAMES, len(mel))) for i in range(len(t)))
    batch = pa.RecordBatch.from_arrays([t, *[pa.array([x[k] for x in spans], pa.float64()) for k in ("start_s", "end_s")]], names=["tensor", "start_s", "end_s"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def load(stored: bytes) -> tuple[np.ndarray, list[tuple[float, float]]]:
    """(tensors (n, FRAMES, MELS), their time spans) out of what ``store`` made; the shape comes from the stored type."""
    table_ = pa.ipc.open_stream(stored).read_all().combine_chunks()
    spans = list(zip(table_["start_s"].to_pylist(), table_["end_s"].to_pylist(), strict=True))
    return table_["tensor"].chunk(0).to_numpy_ndarray(), spans


def featurize(media: bytes) -> tuple[bytes, list[dict]]:
    """Stored tensors and the loud segments' spans of a WAV file."""
    mel, power = log_mel(from_wav(media)[1])
    return store(mel), _spans(segments(power))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 16):
            part, rows = batch.slice(lo, 16), []
            for media in part.column("media").to_pylist():
                try:
                    rows.append((None, None, None) if media is None else (*featurize(media), None))
                except ValueError as e:
                    rows.append((None, None, str(e)))
            yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(x, k) for x, k in zip(zip(*rows, strict=True), ADDED.values(), strict=True)]], names=[*part.schema.names, *ADDED])


def audio_features(audio: DataFrame) -> DataFrame:
    """Adds ``tensors``, ``segments`` and ``problem`` to a table with a column ``media`` of WAV files.

    ``tensors`` holds Arrow IPC bytes: tensors of FRAMES x MELS with their time spans.  Other
    columns and all rows stay; columns with the names of the added ones are replaced.  A null
    file has nulls; a file that is no mono 8-bit PCM WAV has nulls and its ``problem``; a file
    without samples is one frame of silence; an empty table gives an empty result.
    """
    have = {c.lower() for c in ADDED}
    a = audio.drop(*[c for c in audio.columns if c.lower() in have])
    rest = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in a.schema)
    return a.mapInArrow(_features, f"{rest}, {SCHEMA}")


def payload(text: str | None) -> bytes:
    """A text as UTF-8, filled with zeros up to a positive multiple of 64 bytes."""
    raw = (text or "").encode()
    return raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part, rows, known = batch.slice(lo, 256), [], {}
            for text in part.column("text").to_pylist():
                text = text or ""
                if text not in known:
                    media = to_wav(payload(text))
                    back = from_wav(media)[1]
                    stored, loud = featurize(media)
                    t, spans = load(stored)
                    crc = zlib.crc32(t.astype("<f4").tobytes())
                    feature = f"tensors={'x'.join(map(str, t.shape))};mel={crc:08x};end={spans[-1][1]:.4f};segments={len(loud)};loud={sum(s['end_s'] - s['start_s'] for s in loud):.4f}"
                    known[text] = (len(text.encode()), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature)
                rows.append(known[text])
            names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]], names=["doc_id", *names])


def audio_digest(docs: DataFrame) -> DataFrame:
    """Texts as recordings: stored as WAV, read back, and the digests of what was stored and computed.

    ``feature`` is taken from tensors that were stored as Arrow bytes and read back.

    docs: doc_id (long) and text; other columns are not read.  A null text counts as
    empty (64 zero bytes); equal texts give equal rows, whatever batch they are in;
    an empty table gives an empty result.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kind = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return d.mapInArrow(_digest, kind)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio_digest(table(spark, sf_dir, "documents"))
