import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from gradelake.llm import audio as A


def test_wav_is_what_the_standard_library_reads():
    for n in (64, 65, 1000):
        raw = bytes(range(256)) * 4
        media = A.to_wav(raw[:n])
        with wave.open(io.BytesIO(media)) as w:
            assert (w.getnchannels(), w.getsampwidth(), w.getframerate(), w.readframes(n)) == (1, 1, 8000, raw[:n])
        assert A.from_wav(media) == (8000, raw[:n])


def test_resampling_keeps_a_tone():
    t = np.arange(8000) / 8000
    y = A.resample(np.sin(2 * np.pi * 300 * t))
    spectrum = np.abs(np.fft.rfft(y * np.hanning(len(y))))
    assert abs(np.argmax(spectrum) * (8000 * 2 / 3) / len(y) - 300) < 2
    assert abs(np.abs(y[100:-100]).max() - 1) < 0.02
    high = A.resample(np.sin(2 * np.pi * 3600 * t))  # above the new Nyquist rate
    assert np.abs(high[100:-100]).max() < 0.05


def test_resampling_by_definition():
    x = np.random.default_rng(4).standard_normal(97)
    for up, down in ((2, 3), (3, 2), (1, 2), (5, 4)):
        h = A._phases(up, down)
        want = []
        for k in range(-(-len(x) * up // down)):
            last = k * down // up + h.shape[1] // 2
            want.append(sum(h[k * down % up, j] * x[last - j] for j in range(h.shape[1]) if 0 <= last - j < len(x)))
        assert np.allclose(A.resample(x, up, down), want)
        assert np.allclose(A.resample(x, up, down, 2 * up, 21), want[2 * up : 2 * up + 21])


def test_stretches_do_not_show(monkeypatch):
    raw = bytes(np.random.default_rng(1).integers(0, 256, 30_000, dtype=np.uint8))
    whole = A.log_mel(raw)
    monkeypatch.setattr(A, "_STRETCH", 50)
    parts = A.log_mel(raw)
    assert np.allclose(whole[0], parts[0], atol=0.011) and np.allclose(whole[1], parts[1], atol=0.011)


def test_segments_by_hysteresis():
    power = np.array([-60.0] * 10 + [-53.0, -56.0, -56.0, -58.5, -56.0] + [-60.0] * 5 + [-50.0] + [-60.0] * 3)
    assert A.segments(power) == [(10, 13)]


def test_digest(spark):
    rows = [(1, "abc", 1), (2, None, 1), (3, "", 1), (4, "é" * 32, 1), (5, "x" * 70_000, 1), (6, "abc", 1), (None, "q", 1)]
    got = A.audio_digest(spark.createDataFrame(rows, "doc_id long, text string, media int")).collect()
    by = {r.doc_id: r for r in got}
    for i, text, _ in rows:
        raw = (text or "").encode()
        pad = raw + b"\0" * (64 - len(raw) % 64 if len(raw) % 64 or not raw else 0)
        r = by[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]))
        assert r.media_sha256 == hashlib.sha256(A.to_wav(pad)).hexdigest() and r.media_bytes == len(pad) + 44
    assert by[1].feature == by[6].feature and by[2].feature == by[3].feature != by[4].feature
    assert A.audio_digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def plain_log_mel(samples):
    """Log-mel energies and frame energies by their definitions: every frame's Fourier sums and triangles written out."""
    x = np.frombuffer(samples, np.uint8) / 128.0 - 1.0
    h = A._phases(2, 3)
    y = [sum(h[k * 3 % 2, j] * x[k * 3 // 2 + 6 - j] for j in range(12) if 0 <= k * 3 // 2 + 6 - j < len(x)) for k in range(-(-len(x) * 2 // 3))]
    frames = max(1, -(-max(len(y) - 256, 0) // 128) + 1)
    y = np.array([*y, *[0.0] * ((frames - 1) * 128 + 256 - len(y))])
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    rate = 16000 / 3
    edges = [700 * (10 ** (m / 2595) - 1) for m in np.linspace(mel(40), mel(rate / 2), 26)]
    n = np.arange(256)
    waves = np.exp(-2j * np.pi * np.outer(np.arange(129), n) / 256)
    out, power = [], []
    for i in range(frames):
        frame = y[i * 128 : i * 128 + 256]
        spectrum = np.abs(waves @ (frame * (0.5 - 0.5 * np.cos(2 * np.pi * n / 256)))) ** 2
        row = []
        for lo, mid, hi in zip(edges, edges[1:], edges[2:]):
            weight = [max(0.0, min((f - lo) / (mid - lo), (hi - f) / (hi - mid))) for f in np.arange(129) * rate / 256]
            row.append(max(10 * np.log10(np.dot(weight, spectrum) + 1e-8), -80.0))
        out.append(row)
        power.append(10 * np.log10(np.mean(frame**2) + 1e-8))
    return np.array(out), np.array(power)


def test_log_mel_by_definition():
    r = np.random.default_rng(8)
    for raw in (b"\0" * 64, bytes(r.integers(0, 256, 64, dtype=np.uint8)), b"a few plain words " * 90, bytes(r.integers(100, 156, 3001, dtype=np.uint8))):
        for got, want in zip(A.log_mel(raw), plain_log_mel(raw), strict=True):
            assert got.shape == want.shape and np.abs(got - want).max() < 0.011


def test_segments_against_a_state_machine():
    r = np.random.default_rng(3)
    for _ in range(200):
        power = np.round(r.normal(-60, 4, r.integers(1, 60)), 2).astype(np.float32)
        floor, on, spans = np.sort(power)[len(power) // 10], False, []
        for i, p in enumerate([*power, -np.inf]):
            if not on and p >= floor + A.ON:
                on, begin = True, i
            elif on and p < floor + A.OFF:
                on = False
                spans += [(begin, i)] * (i - begin >= A.LEAST)
        assert A.segments(power) == spans


def test_the_digest_of_stored_features(spark):
    texts = ["one line of text", "x" * 5000 + "quiet" + " " * 9000 + "loud !@#$" * 500]
    for r in A.audio_digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        mel, power = plain_log_mel(A.payload(texts[r.doc_id]))
        part = dict(x.split("=") for x in r.feature.split(";"))
        n = -(-len(mel) // A.FRAMES)
        assert part["tensors"] == f"{n}x{A.FRAMES}x{A.MELS}"
        assert abs(float(part["end"]) - ((len(mel) - 1) * 128 + 256) / (16000 / 3)) < 1e-3
        loud = A.segments(np.round(power, 2).astype(np.float32))
        assert int(part["segments"]) == len(loud)
        assert abs(float(part["loud"]) - sum(((b - 1 - a) * 128 + 256) / (16000 / 3) for a, b in loud)) < 1e-3


def test_feature_columns(spark):
    media = A.to_wav(bytes(np.random.default_rng(2).integers(0, 256, 20_000, dtype=np.uint8)))
    rows = [(7, bytearray(media), "x"), (8, None, "x"), (9, bytearray(b"not audio"), "x"), (10, bytearray(A.to_wav(b"")), "x"), (7, bytearray(media), "x")]
    df = A.audio_features(spark.createDataFrame(rows, "clip int, media binary, Segments string").repartition(2))
    assert df.columns == ["clip", "media", "tensors", "segments", "problem"]
    by = {r.clip: r for r in df.collect()}
    assert df.count() == 5 and bytes(by[7].media) == media and by[7].problem is None
    t, spans = A.load(bytes(by[7].tensors))
    assert t.shape == (len(spans), A.FRAMES, A.MELS) and abs(spans[-1][1] - 20_000 / 8000) < 0.06
    mel = A.log_mel(A.from_wav(media)[1])[0]
    assert np.array_equal(t.reshape(-1, A.MELS)[: len(mel)], mel) and (t.reshape(-1, A.MELS)[len(mel) :] == A.FLOOR).all()
    kind = pa.ipc.open_stream(bytes(by[7].tensors)).schema.field("tensor").type
    assert isinstance(kind, pa.FixedShapeTensorType) and kind.shape == [A.FRAMES, A.MELS]
    assert by[8][2:] == (None, None, None) and by[9].tensors is None and by[9].problem == "not a WAV file"
    assert A.load(bytes(by[10].tensors))[0].shape == (1, A.FRAMES, A.MELS) and by[10].segments == []
    assert A.audio_features(df.limit(0)).count() == 0
