"""Boundaries to models and media tools, each with a deterministic stand-in.

An adapter is made on the executor from a picklable factory, once for each task, and sees batches. A stand-in depends
on its input alone, so that pipelines can be tested without a model.
"""

from __future__ import annotations

import hashlib
import io
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from klankwerk.schemas import CHANNELS, CODEBOOK

Texts = Callable[[list[bytes]], list[str]]


def _draw(blob: bytes, salt: str, n: int) -> np.ndarray:
    seed = int.from_bytes(hashlib.blake2b(blob, digest_size=8, key=salt.encode()).digest(), "little")
    return np.random.default_rng(seed).random(n)


def diarise(files: DataFrame, factory: Callable[[], Callable[[bytes], list[tuple[float, float, str]]]] | None = None) -> DataFrame:
    """``file, seq, start, end, speaker`` of files ``file, content``: 1 to n rows, sorted by start. Failing files give none."""
    kind = files.schema["file"].dataType.simpleString()

    def stand_in(blob: bytes) -> list[tuple[float, float, str]]:
        u = _draw(blob, "turns", 24)
        at, out = 0.0, []
        for k in range(8):
            at += 2 * u[3 * k]
            out.append((round(at, 3), round(at + 1 + 9 * u[3 * k + 1], 3), f"SPEAKER_{int(3 * u[3 * k + 2]):02d}"))
            at = out[-1][1]
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory() if factory else stand_in
        for batch in batches:
            rows = []
            for file, blob in zip(batch["file"], batch["content"]):
                try:
                    turns = sorted(model(bytes(blob)), key=lambda t: t[0])
                except Exception:  # one bad file does not end the task
                    turns = []
                rows += [(file, k, *t) for k, t in enumerate(turns)]
            yield pd.DataFrame(rows, columns=["file", "seq", "start", "end", "speaker"])

    return files.select("file", "content").mapInPandas(run, f"file {kind}, seq bigint, start double, end double, speaker string")


def embed(content: Column, factory: Callable[[], Callable[[bytes], np.ndarray | None]] | None = None, dim: int = 512) -> Column:
    """The voice of a segment as ``array<float>``; null where the model has none."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory() if factory else (lambda blob: _draw(blob, "voice", dim) - 0.5)
        for batch in batches:
            found = [None if b is None else model(bytes(b)) for b in batch]
            yield pd.Series([None if v is None else np.asarray(v, dtype=np.float32).tolist() for v in found], dtype=object)

    return run(content)


def transcribe(content: Column, factory: Callable[[], Texts] | None = None, batch_size: int = 4) -> Column:
    """Text of each segment; a batch that fails gives '' for each of its segments."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory() if factory else (lambda blobs: [f"[S1] fragment {hashlib.blake2b(b, digest_size=4).hexdigest()}" for b in blobs])
        for batch in batches:
            blobs, out = [bytes(b) if b is not None else b"" for b in batch], []
            for lo in range(0, len(blobs), batch_size):
                part = blobs[lo : lo + batch_size]
                try:
                    out += model(part)
                except Exception:  # as the contract says
                    out += [""] * len(part)
            yield pd.Series(out, dtype=object)

    return run(content)


def encode_audio(content: Column, factory: Callable[[], Callable[[bytes], np.ndarray]] | None = None) -> Column:
    """Codec codes, ``array<array<int>>`` with a frame of ``CHANNELS`` codes for each step."""

    @F.pandas_udf("array<array<int>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def stand_in(blob: bytes) -> np.ndarray:
            steps = 1 + len(blob) % 64
            return (_draw(blob, "codes", steps * CHANNELS) * CODEBOOK).astype(int).reshape(steps, CHANNELS)

        model = factory() if factory else stand_in
        for batch in batches:
            yield pd.Series([None if b is None else np.asarray(model(bytes(b)), dtype=np.int32).tolist() for b in batch], dtype=object)

    return run(content)


def decode_audio(codes: Column, factory: Callable[[], Callable[[np.ndarray], np.ndarray]] | None = None, hop: int = 512) -> Column:
    """Samples of codec codes, ``array<float>``; null where the decoder fails. The stand-in holds each frame's mean for a hop."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory() if factory else (lambda x: np.repeat(x.mean(axis=1) / CODEBOOK * 2 - 1, hop))
        for batch in batches:
            out = []
            for frames in batch:
                try:
                    out.append(np.asarray(model(np.array([list(f) for f in frames])), dtype=np.float32).tolist())
                except Exception:  # told by the null
                    out.append(None)
            yield pd.Series(out, dtype=object)

    return run(codes)


def generate(text: Column, prompt: Column | None = None, factory: Callable[[], Callable[[list[int], list | None], np.ndarray]] | None = None) -> Column:
    """Codes a model says for text tokens and a prompt of codes; null where it fails. The stand-in draws from the text."""

    @F.pandas_udf("array<array<int>>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        def stand_in(tokens: list[int], start: list | None) -> np.ndarray:
            said = (_draw(bytes(t % 256 for t in tokens), "speech", (1 + sum(t > 0 for t in tokens)) * CHANNELS) * CODEBOOK).astype(int).reshape(-1, CHANNELS)
            return np.concatenate([np.array([list(f) for f in start]), said]) if start is not None and len(start) else said

        model = factory() if factory else stand_in
        for texts, prompts in batches:
            out = []
            for tokens, start in zip(texts, prompts):
                try:
                    out.append(np.asarray(model(list(tokens), start), dtype=np.int32).tolist())
                except Exception:  # told by the null
                    out.append(None)
            yield pd.Series(out, dtype=object)

    return run(text, prompt if prompt is not None else F.lit(None).cast("array<array<int>>"))


# ---- waveforms ----

WAVE = "rate int, channels int, samples array<float>"


def resampled(samples: np.ndarray, rate: int, wanted: int) -> np.ndarray:
    """The band-limited waveform at another rate, by its spectrum; frequencies the new rate cannot hold are cut off."""
    n = len(samples)
    m = int(round(n * wanted / rate))
    if n == 0 or m == 0 or m == n:
        return samples[:m]
    spectrum, kept = np.fft.rfft(samples), np.zeros(m // 2 + 1, dtype=complex)
    k = min(len(spectrum), len(kept))
    kept[:k] = spectrum[:k]
    return np.fft.irfft(kept, m) * (m / n)


def load_wave(content: Column, rate: int = 44_100) -> Column:
    """``rate, channels, samples`` of PCM waves of 1 to 4 bytes a sample, mixed to mono at ``rate``; null for anything else.

    ``channels`` is that of the file. Samples are in -1 to 1.
    """

    @F.pandas_udf(WAVE)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for blob in batch:
                try:
                    with wave.open(io.BytesIO(bytes(blob))) as w:
                        width, channels, own, raw = w.getsampwidth(), w.getnchannels(), w.getframerate(), w.readframes(w.getnframes())
                    if width == 1:
                        x = np.frombuffer(raw, np.uint8).astype(np.float64) - 128
                    elif width == 3:
                        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
                        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8).astype(np.float64)
                    else:
                        x = np.frombuffer(raw, {2: np.int16, 4: np.int32}[width]).astype(np.float64)
                    mono = (x / float(1 << (8 * width - 1))).reshape(-1, channels).mean(axis=1)
                    out.append((rate, channels, resampled(mono, own, rate).astype(np.float32).tolist()))
                except Exception:  # told by the null
                    out.append((None, None, None))
            yield pd.DataFrame(out, columns=["rate", "channels", "samples"]).astype({"rate": "Int32", "channels": "Int32"})

    return run(content)


def save_wave(samples: Column, rate: int = 44_100) -> Column:
    """A mono wave of 16 bits of samples in -1 to 1, clipped to that; null samples give null."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for x in batch:
                if x is None:
                    out.append(None)
                    continue
                file = io.BytesIO()
                with wave.open(file, "wb") as w:
                    w.setnchannels(1)
                    w.setsampwidth(2)
                    w.setframerate(rate)
                    w.writeframes((np.clip(np.asarray(x, dtype=np.float64), -1, 1) * 32767).round().astype("<i2").tobytes())
                out.append(file.getvalue())
            yield pd.Series(out, dtype=object)

    return run(samples)


def convert_wave(content: Column, rate: int = 16_000) -> Column:
    """A wave as a mono one of 16 bits at ``rate``; null for what is no wave."""
    return save_wave(load_wave(content, rate)["samples"], rate)


def cut_wave(content: Column, start: Column, end: Column, rate: int = 16_000) -> Column:
    """The part of a wave from ``start`` to ``end`` seconds as a mono one at ``rate``; null for what is no wave."""
    at = lambda t: F.round(F.greatest(t, F.lit(0.0)) * rate).cast("int")
    samples = load_wave(content, rate)["samples"]
    return save_wave(F.slice(samples, at(start) + 1, F.greatest(at(end) - at(start), F.lit(0))), rate)


def wave_seconds(content: Column) -> Column:
    """The duration of a wave by its header, null for what is no wave."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for blob in batch:
                try:
                    with wave.open(io.BytesIO(bytes(blob))) as w:
                        out.append(w.getnframes() / w.getframerate())
                except Exception:  # told by the null
                    out.append(None)
            yield pd.Series(out, dtype=float)

    return run(content)


def is_readable(content: Column, factory: Callable[[], Callable[[bytes], bool]] | None = None) -> Column:
    """Whether a probe takes the file for audio; the stand-in asks for any content. False where the probe fails."""

    @F.pandas_udf("boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        probe = factory() if factory else bool
        for batch in batches:
            out = []
            for b in batch:
                try:
                    out.append(b is not None and bool(probe(bytes(b))))
                except Exception:  # an unreadable file is the case asked about
                    out.append(False)
            yield pd.Series(out)

    return run(content)


def cut_segments(chunks: DataFrame, cutter: Callable[[], Callable[[bytes, float, float], bytes]] | None = None) -> DataFrame:
    """Chunks ``content, start, end`` (seconds) with ``segment``; null where the cut fails, the others go on."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        cut = cutter() if cutter else (lambda blob, a, b: hashlib.blake2b(blob + f"{a:.3f}-{b:.3f}".encode()).digest())
        for blobs, starts, ends in batches:
            out = []
            for blob, a, b in zip(blobs, starts, ends):
                try:
                    out.append(cut(bytes(blob), float(a), float(b)))
                except Exception:  # logged by the null
                    out.append(None)
            yield pd.Series(out, dtype=object)

    return chunks.withColumn("segment", run("content", "start", "end"))
