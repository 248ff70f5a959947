"""Token sequences as arrays: frames of ``channels`` codes, framing, delay pattern, shift.

A frame sequence is ``array<array<int>>``, time first. Everything is element access in array functions, no join.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from klankwerk.schemas import AUDIO_LENGTH, BOS, CHANNELS, CODEBOOK, DELAY, EOS, PAD


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """``body(x)`` with x worked out once, however often the body refers to it from inside its own functions."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def flat(frames: Column) -> Column:
    """All codes in row-major order."""
    return F.flatten(frames)


def shape(frames: Column, channels: int = CHANNELS) -> Column:
    return F.array(F.size(frames).cast("bigint"), F.lit(channels).cast("bigint"))


def _steps(n: Column) -> Column:
    """0 .. n - 1; empty where n is 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def unflat(codes: Column, channels: int = CHANNELS) -> Column:
    """The inverse of ``flat``; a last part of a frame is left out."""
    return let(codes, lambda x: F.transform(_steps(F.floor(F.size(x) / channels).cast("int")), lambda t: F.slice(x, t * channels + 1, channels)))


def framed(frames: Column, length: int = AUDIO_LENGTH, channels: int = CHANNELS) -> Column:
    """A frame of BOS, at most ``length - 2`` frames, one of EOS, and frames of PAD up to ``length``."""
    row = lambda v: F.array_repeat(F.lit(v), channels)
    body = F.slice(frames, 1, length - 2)
    return F.slice(F.concat(F.array(row(BOS)), body, F.array(row(EOS)), F.array_repeat(row(PAD), length)), 1, length)


def delayed(frames: Column, delay: Sequence[int] = DELAY, bos: int = BOS, pad: int = PAD) -> Column:
    """Channel c shifted ``delay[c]`` steps later; BOS before its first code. The length stays."""

    def moved(x: Column) -> Column:
        cell = lambda t, c, d: F.when(t < d, F.lit(bos)).when(t - d >= F.size(x), F.lit(pad)).otherwise(F.get(F.get(x, t - d), F.lit(c)))
        return F.transform(_steps(F.size(x)), lambda t: F.array(*[cell(t, c, d) for c, d in enumerate(delay)]))

    return let(frames, moved)


def reverted(frames: Column, delay: Sequence[int] = DELAY, pad: int = PAD) -> Column:
    """Channel c shifted ``delay[c]`` steps earlier; PAD where that reaches past the end. The length stays."""

    def moved(x: Column) -> Column:
        cell = lambda t, c, d: F.when(t + d >= F.size(x), F.lit(pad)).otherwise(F.get(F.get(x, t + d), F.lit(c)))
        return F.transform(_steps(F.size(x)), lambda t: F.array(*[cell(t, c, d) for c, d in enumerate(delay)]))

    return let(frames, moved)


def codes_only(frames: Column, delay: Sequence[int] = DELAY) -> Column:
    """Reverted frames ready for decoding: the last ``max(delay)`` dropped, codes out of range made 0."""
    body = let(frames, lambda x: F.slice(x, 1, F.greatest(F.size(x) - max(delay), F.lit(0))))
    return F.transform(body, lambda row: F.transform(row, lambda v: F.when((v < 0) | (v >= CODEBOOK), 0).otherwise(v)))


def shifted(frames: Column, pad: int = PAD, channels: int = CHANNELS) -> Column:
    """Targets of frames as inputs: each step is the next, the last is PAD."""
    last = F.array(F.array_repeat(F.lit(pad), channels))
    return let(frames, lambda x: F.when(F.size(x) > 0, F.concat(F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0))), last)).otherwise(x))


def prefilled(prompt: Column, length: int, delay: Sequence[int] = DELAY, channels: int = CHANNELS) -> Column:
    """A generation buffer: a frame of BOS, the prompt, and -1 (not set) for max(delay) more steps, then delayed, cut to ``length``."""
    row = lambda v: F.array_repeat(F.lit(v), channels)
    body = F.concat(F.array(row(BOS)), F.coalesce(prompt, F.array().cast("array<array<int>>")), F.array_repeat(row(-1), max(delay)))
    return F.slice(delayed(body, delay, BOS, -1), 1, length)


def guidance_pair(tokens: Column) -> Column:
    """The unconditional and the conditional input of guided generation: zeros of the same length, then the tokens."""
    return F.array(F.transform(tokens, lambda _: F.lit(0)), F.transform(tokens, lambda x: x.cast("int")))


def repeated(frames: Column, times: int = 2) -> Column:
    """``times`` copies of an array side by side, a batch of equal rows."""
    return F.array_repeat(frames, times)


def first_steps(frames: Column, length: Column | int) -> Column:
    """The first ``length`` steps of a sequence; all of a shorter one."""
    return F.slice(frames, F.lit(1), F.lit(length) if isinstance(length, int) else length)
